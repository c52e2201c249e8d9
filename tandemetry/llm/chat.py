"""Chat formatting by schema fingerprints, DataFrame functions only.

Records are VARIANT values of any layout.  The nested field paths of a record,
without the types of its leaves, are hashed; the hash selects one of a table of
declarative mappings, which yields canonical turns (turn, role, text).  Turns are
then written by a template,

    <s> ( [INST] role [/INST] text </s> ) ...

with a backslash after each `<`, `[` and backslash of roles and texts.  So no
control string can stand inside them, and dropping those backslashes restores
them.  The loss mask holds a span (turn, start, length) for each assistant text.

Defined results: a null role or text is empty; turns sort by turn, role and
text, null turns first; repeated rows are repeated turns; a null conv_id is one
conversation; a record of an unknown layout ends the run with its paths, unless
strict is off, when `unmapped` lists it; a null record and a
conversation without turns have no turns and are not returned.  Empty tables give
empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<turn:bigint,role:string,text:string>>"
BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
LEAVES = r"(?<=[:<] ?)(STRING|TINYINT|SMALLINT|INT|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|DATE|BINARY|VARIANT|UUID|TIMESTAMP_NTZ|TIMESTAMP|DECIMAL\(\d+,\d+\))(?=[,>]|$)"


def paths(record: Column) -> Column:
    """The record's nested field paths in canonical order, without the types of leaves."""
    return F.regexp_replace(F.schema_of_variant(record), LEAVES, "_")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(paths(record))


def _get(record: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(record, path, kind)


def _turn(k: int | Column, role: str | Column, text: Column) -> Column:
    k, role = (F.lit(x) if isinstance(x, int | str) else x for x in (k, role))
    return F.struct(k.cast("bigint").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _listed(path: str, role: str, text: str, names: dict[str, str] | None = None) -> Callable[[Column], Column]:
    """A list of messages under path; names renames roles."""

    def turns(record: Column) -> Column:
        got = _get(record, path, f"array<struct<{role}:string,{text}:string>>")

        def one(m: Column, k: Column) -> Column:
            who = m[role]
            for a, b in (names or {}).items():
                who = F.when(m[role] == a, F.lit(b)).otherwise(who)
            return _turn(k, who, m[text])

        return F.transform(F.filter(got, lambda m: m.isNotNull()), one)

    return turns


def _fixed(*fields: tuple[str, str]) -> Callable[[Column], Column]:
    """One turn a field: (role, path)."""
    return lambda record: F.array(*(_turn(k, role, _get(record, path, "string")) for k, (role, path) in enumerate(fields)))


def _instructed(record: Column) -> Column:
    """instruction, input and output: the input follows the instruction after an empty line, unless it is empty."""
    given = F.coalesce(_get(record, "$.input", "string"), F.lit(""))
    return F.array(_turn(0, "user", F.concat(F.coalesce(_get(record, "$.instruction", "string"), F.lit("")), F.when(given != "", F.concat(F.lit("\n\n"), given)).otherwise(""))), _turn(1, "assistant", _get(record, "$.output", "string")))


def _row(record: Column) -> Column:
    """One turn a record."""
    return F.array(_turn(_get(record, "$.turn", "bigint"), _get(record, "$.role", "string"), _get(record, "$.text", "string")))


SHARED = {"human": "user", "gpt": "assistant"}
#: name: (nested field paths, mapping).
LAYOUTS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "turn_row": ("OBJECT<role: _, text: _, turn: _>", _row),
    "messages": ("OBJECT<messages: ARRAY<OBJECT<content: _, role: _>>>", _listed("$.messages", "role", "content")),
    "conversation": ("OBJECT<conversations: ARRAY<OBJECT<from: _, value: _>>>", _listed("$.conversations", "from", "value", SHARED)),
    "turns": ("OBJECT<turns: ARRAY<OBJECT<role: _, text: _>>>", _listed("$.turns", "role", "text")),
    "bare_messages": ("ARRAY<OBJECT<content: _, role: _>>", _listed("$", "role", "content")),
    "prompt": ("OBJECT<completion: _, prompt: _>", _fixed(("user", "$.prompt"), ("assistant", "$.completion"))),
    "prompt_response": ("OBJECT<prompt: _, response: _>", _fixed(("user", "$.prompt"), ("assistant", "$.response"))),
    "system_prompt": ("OBJECT<prompt: _, response: _, system: _>", _fixed(("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response"))),
    "question": ("OBJECT<answer: _, question: _>", _fixed(("user", "$.question"), ("assistant", "$.answer"))),
    "instruction": ("OBJECT<input: _, instruction: _, output: _>", _instructed),
    "bare_instruction": ("OBJECT<instruction: _, output: _>", _fixed(("user", "$.instruction"), ("assistant", "$.output"))),
}


def _layout(record: Column, by: Callable[[str], Column], unknown: Column | None = None) -> Column:
    print_ = fingerprint(record)
    out = F.lit(None) if unknown is None else F.when(record.isNotNull(), unknown)
    for name, (known, _) in LAYOUTS.items():
        out = F.when(print_ == F.xxhash64(F.lit(known)), by(name)).otherwise(out)
    return out


def canonical(records: DataFrame, strict: bool = True) -> DataFrame:
    """conv_id, turn, role, text from rows of conv_id and record (VARIANT)."""
    stop = F.raise_error(F.concat(F.lit("no mapping for the layout "), paths(F.col("record")))).cast(TURNS) if strict else None
    turns = _layout(F.col("record"), lambda name: LAYOUTS[name][1](F.col("record")).cast(TURNS), stop)
    return records.select("conv_id", F.explode(turns).alias("t")).select("conv_id", "t.turn", "t.role", "t.text")


def unmapped(records: DataFrame) -> DataFrame:
    """paths, fingerprint and rows of layouts without a mapping."""
    known = _layout(F.col("record"), F.lit)
    return records.where(F.col("record").isNotNull() & known.isNull()).groupBy(paths(F.col("record")).alias("paths"), fingerprint(F.col("record")).alias("fingerprint")).agg(F.count("*").alias("n_rows"))


def from_rows(conversations: DataFrame) -> DataFrame:
    """Records of a table with one turn a row."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.to_variant_object(F.struct(F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.col("turn").cast("long").alias("turn"))).alias("record"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def formatted(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, formatted and loss (array of turn, start, length in code points of the turn's part, which ends before </s>)."""
    gathered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))

    def part(x: Column) -> Column:
        body = escape(x["text"])
        head = F.concat(F.lit(OPEN), escape(x["role"]), F.lit(CLOSE))
        return F.struct(F.concat(head, body).alias("part"), F.char_length(head).alias("start"), F.char_length(body).alias("length"), (x["role"] == trained).alias("trained"))

    made = gathered.select("conv_id", F.transform("t", part).alias("p"))
    spans = F.transform("p", lambda x, k: F.when(x["trained"], F.struct(k.alias("turn"), x["start"], x["length"])))
    return made.select(
        "conv_id",
        F.concat(F.lit(BEGIN), F.array_join(F.transform("p", lambda x: F.concat(x["part"], F.lit(END))), "")).alias("formatted"),
        F.filter(spans, lambda s: s.isNotNull()).alias("loss"),
    )


def _parts(text: Column) -> Column:
    parts = F.split(F.substring(text, len(BEGIN) + 1, 2**31 - 1), END, -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def parsed(chats: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), loss_texts, formatted_chars, read back from formatted and loss."""
    split = chats.select("conv_id", _parts(F.col("formatted")).alias("parts"), "loss", F.char_length("formatted").cast("long").alias("formatted_chars"))

    def turn(part: Column) -> Column:
        two = F.split(F.substring(part, len(OPEN) + 1, 2**31 - 1), r"\[/INST\]", 2)
        return F.struct(unescape(two[0]).alias("role"), unescape(two[1]).alias("text"))

    texts = F.transform("loss", lambda s: unescape(F.get("parts", s["turn"]).substr(s["start"] + 1, s["length"])))
    return split.select("conv_id", F.transform("parts", turn).alias("turns"), texts.alias("loss_texts"), "formatted_chars")


def digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    back = parsed(chats)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length(trained).cast("long").alias("loss_chars"), F.sha2(trained, 256).alias("loss_sha256"), "formatted_chars")
