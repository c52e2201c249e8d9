"""One statement for two engines: what differs between Spark SQL and the oracle's SQL is written as a mark."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: mark: (Spark, DuckDB), with {0}, {1} for arguments.
MARKS = {
    "@seconds": ("(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {0}) / 1e6)", "(epoch_us({0}) / 1e6)"),
    "@pct": ("percentile({0}, {1})", "quantile_cont({0}, {1})"),
    "@series": ("explode(sequence({0}, {1}))", "unnest(range({0}, {1} + 1))"),
    "@draw": ("cast(conv(substr(md5({0}), 1, 8), 16, 10) as bigint)", "('0x' || substr(md5({0}), 1, 8))::bigint"),
    "@match": ("({0} rlike {1})", "regexp_matches({0}, {1})"),
    "@group": ("regexp_extract({0}, {1}, {2})", "regexp_extract({0}, {1}, {2})"),
    "@joined": ("array_join(array_sort(collect_list({0})), '|')", "string_agg({0}, '|' order by {0})"),
    "@str": ("cast({0} as string)", "cast({0} as varchar)"),
    "@div": ("cast(floor({0} / {1}) as bigint)", "cast(floor({0} / {1}) as bigint)"),
    "@lastof": ("last_value({0}) ignore nulls", "last_value({0} ignore nulls)"),
    "@hash": ("aggregate(split({0}, ''), 0L, (h, c) -> (h * 131 + ascii(c)) % 1000003)", "list_reduce(list_prepend(0::bigint, list_transform(string_split({0}, ''), lambda c: ascii(c)::bigint)), lambda h, c: (h * 131 + c) % 1000003)"),
    "@lastby": ("max_by({0}, struct({1}, {0}))", "max_by({0}, row({1}, {0}))"),
    # a sum of doubles depends on its order: rows in the order of an id, as one pass over the table adds them
    "@mean": ("try_divide(aggregate(array_sort(collect_list(case when {0} is not null then struct({1} as i, {0} as v) end)), 0e0, (s, r) -> s + r.v), count({0}))", "avg({0})"),
    "@at": ("element_at({0}, {1})", "{0}[{1}]"),
}


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """Arguments of the call whose parenthesis opens at `at`, and the place after it."""
    depth, start, out, quoted = 0, at + 1, [], False
    for i in range(at, len(text)):
        c = text[i]
        if c == "'":
            quoted = not quoted
        if quoted:
            continue
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if not depth:
                return [*out, text[start:i].strip()], i + 1
        elif c == "," and depth == 1:
            out.append(text[start:i].strip())
            start = i + 1
    raise ValueError("a mark's parenthesis is not closed")


def rendered(text: str, engine: int) -> str:
    while m := list(re.finditer(r"@\w+(?=\()", text)):
        last = m[-1]  # the innermost calls come last
        arguments, end = _arguments(text, last.end())
        text = text[: last.start()] + MARKS[last[0]][engine].format(*arguments) + text[end:]
    return text


def spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a statement over the tables that it names, given as DataFrames, so no view outlives it."""
    text = rendered(text, 0)
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark_sql(spark, sf_dir, text)


def oracle(text: str) -> str:
    return rendered(text, 1)
