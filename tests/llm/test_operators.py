import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tandemetry.llm import bagminhash, chat, decontaminate, html_paths, packing, quality_forest, queries, recompression, splitters, viterbi, warc_chunks
from tandemetry.llm import kernels as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, class_id string"
ODD = [(None, None, "s", "x"), (None, "a b", None, "x"), (1, "", "s", None), (2, None, "s", "x"), (3, "a b", "s", "x"), (3, "a b", "s", "x"), (4, " \t\n", "s", "x"), (5, "é " * 3000, "s", "x"), (6, "<s> [INST] \\ </s>", "s", "x")]
CHAT, PAGES = "conv_id long, turn long, role string, text string, record string, t long", "page_id long, url string, html string, digest long"
WORDS_FILE, PIECES_FILE = queries.tokenizer_path("word_bpe_49k.json"), queries.tokenizer_path("piece_bpe_32k.model")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_oracle(name, same_as_oracle):
    same_as_oracle(queries.QUERIES[name], queries.ORACLES[name])


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def made_texts(seed=0, n=40):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(400)}" for _ in range(4000)]
    out = []
    for _ in range(n):
        a = rng.randrange(3000)
        out.append(" ".join(words[a : a + rng.randrange(10, 200)] + [f"x{rng.randrange(9)}" for _ in range(rng.randrange(20))]))
    return out


def test_rule_statistics_equal_a_plain_count():
    texts = [*made_texts(1, 20), "", "a", "a\na\nb\n\na b c a b c", "né | né # né", "one two three " * 40]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    got = np.concatenate([quality_forest.statistics(d, o) for _, _, d, o in K.text_slices(batch, "text")])
    for text, row in zip(texts, got, strict=True):
        w = WORD.findall(text)
        seen, again = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        three = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k in range(len(w) - 2) if three[tuple(w[k : k + 3])] > 1 for j in range(3)}
        assert list(row[:5]) == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)]


def test_forest_tells_junk_from_prose_held_out(spark):
    rng = np.random.default_rng(0)
    good = rng.poisson(5, (600, len(quality_forest.COUNTS))) + 60
    good[:, 1], good[:, 2:5], good[:, 7] = good[:, 0] * 5, 0, 0
    junk = good[:60].copy()
    junk[:, 2] = junk[:, 0] * 2
    forest = quality_forest.fit_labelled(np.concatenate([good[:300], junk[:30]]), np.arange(330) >= 300)
    score = forest.score(quality_forest.features(np.concatenate([good[300:], junk[30:]])))
    assert (score[:300] > forest.threshold).mean() < 0.02 and (score[300:] > forest.threshold).mean() > 0.9


def test_odd_rows_and_empty_tables(spark):
    docs, none = frame(spark, ODD), frame(spark, [])
    labels = spark.createDataFrame([(3, 0), (5, 1), (None, 1)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "é é é é é é é é é é é"), (2, None), (3, "a b"), (3, "a b"), (None, "a b")], "item_id long, text string")
    forest = quality_forest.fit(docs, labels)
    assert quality_forest.rate(docs, forest).count() == len(ODD) and quality_forest.keep(docs, forest).columns == docs.columns
    classes = {(r.doc_id, r.class_id) for r in bagminhash.classes(docs).collect()}
    assert {(1, 1), (2, 1), (4, 1), (3, 3), (5, 5), (6, 6), (None, 3), (None, 1)} == classes
    rated = sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality_forest.rate(docs, forest).collect())
    assert rated == [(0, 0, 0, 0, 0, 0, True, False), (0, 2, 2, 0, 0, 0, True, False), (1, 0, 0, 0, 0, 0, True, False), (2, 0, 0, 0, 0, 0, True, False), (3, 2, 2, 0, 0, 0, True, False), (3, 2, 2, 0, 0, 0, True, False), (4, 0, 0, 0, 0, 0, True, False), (5, 3000, 3000, 0, 0, 3000, True, False), (6, 4, 14, 4, 0, 0, True, False)]
    cut = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in recompression.deduplicate(docs).collect()}
    assert cut == {(d, len(w), 0, hashlib.sha256(" ".join(w).encode()).hexdigest()) for d, t, *_ in ODD for w in [WORD.findall(t or "")]}
    plain = viterbi.Counter(viterbi.vocabulary(PIECES_FILE))
    assert sorted((r.doc_id or 0, r.n_tokens) for r in viterbi.count_tokens(docs, PIECES_FILE).collect()) == sorted((d or 0, plain.count(t or "")[1]) for d, t, *_ in ODD)
    hits = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.decontaminate(docs, bench).collect()}
    assert hits[3] == (2, 1) and hits[5] == (3000, 1) and hits[6] == (0, 0) and hits[None] == (2, 1)
    for result in (bagminhash.classes(none), chat.canonical(chat.from_rows(spark.createDataFrame([], CHAT))), warc_chunks.records(warc_chunks.read_chunks(*warc_chunks.write_archives(warc_chunks.planned(spark.createDataFrame([], PAGES))))), recompression.deduplicate(none), recompression.removed_from(none), decontaminate.decontaminate(none, bench), splitters.shard(none, 4), viterbi.count_tokens(none, PIECES_FILE), packing.pack(none, WORDS_FILE)):
        assert result.count() == 0
    assert quality_forest.rate(none, quality_forest.fit(none, labels)).count() == 0


def test_passages_go_but_the_first_document_keeps_them(spark):
    texts = made_texts(2, 30)
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(i, t + (" " + passage if i % 3 == 0 else "") + " end", "s", "c") for i, t in enumerate(texts)]
    rows += [(100, "go " * 120, "s", "c"), (101, "go " * 70, "s", "c"), (102, rows[0][1], "s", "c")]
    first: dict[tuple, int] = {}
    words = {i: WORD.findall(t) for i, t, *_ in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    want = {}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(50)}
        want[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompression.deduplicate(frame(spark, rows)).collect()} == want
    cut = {r.doc_id: r.text for r in recompression.removed_from(frame(spark, rows)).collect()}
    assert passage in cut[0] and passage not in cut[3] and 102 not in cut


def test_windows_repeated_inside_a_document_and_in_most_documents(spark):
    rng = random.Random(8)
    hot = " ".join(f"h{k % 55}" for k in range(170))  # windows come again every 55 words
    rows = [(d, " ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) + " " + hot, "s", "c") for d in range(60)]
    rows += [(None, hot + " tail", "s", "c"), (7, rows[7][1], "s", "c"), (90, "z " * 60 + "end", "s", "c"), (91, "front " + "z " * 55, "s", "c")]
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in recompression.deduplicate(frame(spark, rows)).collect())
    assert got == Counter([(0, 200, 0), *((d, 200, 170) for d in [*range(1, 60), 7]), (None, 171, 170), (90, 61, 0), (91, 56, 55)])


def test_anchors_are_a_function_of_the_window():
    rng = np.random.default_rng(3)
    h = K.mix(rng.integers(0, 3, 6000).astype(np.uint64))
    starts, keys = recompression.anchors(h, np.array([0, 2500, 2600, 6000]))
    seen: dict[bytes, int] = {}
    for s, k in zip(starts, keys, strict=True):
        assert seen.setdefault(h[s : s + 50].tobytes(), int(k)) == int(k)
    h[1000:1400] = h[3000:3400]
    starts, keys = recompression.anchors(h, np.array([0, 2500, 2600, 6000]))
    by = dict(zip(starts.tolist(), keys.tolist(), strict=True))
    assert all(by[1000 + k] == by[3000 + k] for k in range(350))


def test_signatures_estimate_weighted_jaccard():
    rng, errors = np.random.default_rng(5), []
    for _ in range(60):
        base = K.mix(rng.integers(0, 10**9, 200).astype(np.uint64))
        a = np.repeat(base, rng.integers(1, 6, 200))
        b = np.repeat(base, rng.integers(1, 6, 200))
        doc = np.repeat([0, 1], [len(a), len(b)])
        times = bagminhash.signatures(*bagminhash.multiset(doc, np.concatenate([a, b])), 2)
        errors.append((times[0] == times[1]).mean() - bagminhash.similarity(bagminhash.bag(a), bagminhash.bag(b)))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06


def test_a_chain_in_one_bucket_is_one_class():
    size = bagminhash.M
    bags = [np.arange(k * 8, k * 8 + 100, dtype=np.uint64) for k in range(4)]
    rows = [(False, k, k, bytes(size), b.tobytes()) for k, b in enumerate(bags)]
    assert len(bagminhash._links(rows, 0.8, 0.6)) == 3


@pytest.mark.parametrize(("stretch", "broadcast"), [(1 << 28, 1_000_000), (3000, 1_000_000), (3000, 0)])
def test_shards_are_gapless_and_near_equal(spark, monkeypatch, stretch, broadcast):
    monkeypatch.setattr(splitters, "STRETCH_BYTES", stretch)
    monkeypatch.setattr(splitters, "BROADCAST_ROWS", broadcast)
    rng = random.Random(1)
    rows = [(i, "same" * 50 if i % 3 == 0 else "x" * rng.randrange(400), "s", "c") for i in range(3000)]
    got = splitters.shard(frame(spark, rows), 8).toPandas()
    assert sorted(got.doc_id) == list(range(3000))
    by = got.groupby("shard")
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in by) and by["size"].sum().max() < 1.05 * by["size"].sum().min()
    assert got.set_index("doc_id").text_crc32[0] == zlib.crc32(b"same" * 50)


def test_shards_of_odd_rows(spark):
    rows = [(None, None, "s", "c"), (1, None, "s", "c"), (1, None, "s", "c"), (2, "x" * 200_000, "s", "c"), (3, "é", "s", "c")] + [(i, "y" * (i % 7), "s", "c") for i in range(4, 400)]
    got = splitters.shard(frame(spark, rows), 5).toPandas()
    want = Counter((i if i is not None else -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter(zip(got.doc_id.fillna(-1).astype(int), got["size"], got.text_crc32, strict=True)) == want
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard")) and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    # one row fills more than a shard; the others share what is left about evenly
    rest = got[got.doc_id != 2].groupby("shard")["size"].sum()
    assert rest.max() <= (rest.sum() + 200_016) / 5 + 100


def test_packing_of_repeated_rows(spark):
    rows = [(1, "some words here", "s", "c")] * 3 + [(None, "some words here", "s", "c")] * 2
    got = packing.pack(frame(spark, rows), WORDS_FILE).toPandas()
    assert len(got) == 5 and got.sequence_id.nunique() == 1 and sorted(got.offset) == [0, *np.cumsum(got.length)[:-1]]


def test_counts_equal_the_unigram_tokenizer():
    from tokenizers import Tokenizer, models

    vocabulary = viterbi.vocabulary(PIECES_FILE)
    every = [("<unk>", 0.0), *vocabulary, *((f"<0x{b:02X}>", 0.0) for b in range(256))]
    unigram = Tokenizer(models.Unigram(every, 0, byte_fallback=True))
    counter = viterbi.Counter(vocabulary)
    for text in ["a", " x  y ", "the cat\tsat\non 猫猫 mats", *made_texts(4, 10), "Überall häßlich œuvre"]:
        marked = "▁" + text.replace(" ", "▁")
        assert counter.count(text)[1] == len(unigram.encode(marked).ids) == counter.solve(marked)[1]


def test_archives_round_trip(spark):
    big = "ß" * 400_000
    rows = [(1, "u", big, 0), (2, "v v", big, 0), (2, "v v", big, 0), (None, None, big, 0), (3, "w\r\nX: y", None, 0), (4, "z", "a\r\n\r\nb", 0), (5, "z", "q" * 999, 0), (6, "z", "q" * 999, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest long")
    chunks = warc_chunks.read_chunks(*warc_chunks.write_archives(warc_chunks.planned(pages)))
    got = sorted((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.n_chunks) for r in warc_chunks.records(chunks).collect())
    sha = hashlib.sha1(big.encode()).hexdigest()
    assert got[0][:5] == (-1, "revisit", 2, 800_000, sha) and got[1][:5] == (1, "revisit", 2, 800_000, sha)
    assert got[2] == got[3] == (2, "response", None, 800_000, sha, 4)
    assert [g[1] for g in got[4:]] == ["response"] * 4 and got[4][3] == 0
    body = b"".join(bytes(r.chunk) for r in chunks.where("page_id = 2 and record_type = 'response'").orderBy("archive", "record", "chunk_no").limit(4).collect())
    assert body == big.encode()


def test_packing_is_whole_and_as_tight_as_the_bound(spark):
    rows = [(i, t, "s", "c") for i, t in enumerate(made_texts(6, 60))] + [(99, "long words " * 3000, "s", "c"), (100, None, "s", "c"), (101, "", "s", "c"), (102, "naïve ２ <|endoftext|> ½", "s", "c")]
    got = packing.pack(frame(spark, rows), WORDS_FILE).toPandas()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORDS_FILE)
    for doc_id, text, *_ in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        mine = got[got.doc_id == doc_id].sort_values("piece")
        assert list(mine.start) == list(range(0, len(ids), 2048)) and mine.length.sum() == len(ids)
        assert list(mine.ids_crc32) == [zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes()) for a in range(0, len(ids), 2048)]
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert got.sequence_id.nunique() == -(-got.length.sum() // 2048)


def test_ids_of_a_slice_equal_the_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORDS_FILE)
    every = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC, 0x300, 0x2028, 0x3000, 0x1F600]]
    texts = [t for c in every for t in (c, f"a{c}b {c}'s{c}", f"'{c}' I'{c}5{c}{c}")]
    rng = random.Random(5)
    signs = ["'", "'", "s", "t", "re", "ve", "ll", "m", "d", "S", "é", "É", "Ⱥ", "5", "½", '"', "-", "€", "…", " ", "\n", "\x85", "\xa0", "word", "Words"]
    texts += ["".join(rng.choices(signs, k=rng.randrange(30))) for _ in range(3000)]
    texts += [None, "", " ", "<|endoftext|>", "a <|startoftext|>b", " ".join(made_texts(8, 3))]
    want = [np.array(plain.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    bpe = packing.WordBPE(WORDS_FILE)
    for size in (1 << 20, 500, 7):  # the last cut most texts
        monkeypatch.setattr(packing, "SLICE", size)
        got = list(bpe.encode(pa.array(texts, pa.string())))
        assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []
    assert list(bpe.encode(pa.array([], pa.string()))) == []


def test_words_of_a_slice_are_tokenized_once(monkeypatch):
    """Time goes to words that are tokenized again: of more than the memo holds, and beside other signs."""
    bpe, seen = packing.WordBPE(WORDS_FILE), Counter()

    class Model:
        def tokenize(self, word, model=bpe.model):
            seen[word] += 1
            return model.tokenize(word)

    bpe.model = Model()
    monkeypatch.setattr(packing, "MEMO", 10)
    words = ["".join(p) for p in itertools.product("bdfg", "aeiou", "klmn")]
    texts = [f"{a} {a}{sign} ({a} {b}" for sign in ",.;:!" for a, b in itertools.pairwise(words)]
    assert sum(map(len, bpe.encode(pa.array(texts)))) > 0
    assert set(words) <= set(seen) and set(seen.values()) == {1}


def test_bin_completion_finds_what_best_fit_misses():
    for seed in range(30):
        rng = random.Random(seed)
        histogram = Counter(rng.randrange(10, 60) for _ in range(12))
        counts = np.zeros(101, np.int64)
        for k, n in histogram.items():
            counts[k] = n
        found = packing.plan(histogram, 100)
        used = Counter()
        for pattern, times in found:
            assert sum(pattern) <= 100
            for x in pattern:
                used[x] += times
        assert used == histogram and sum(t for _, t in found) <= sum(t for _, t in packing.best_fit(counts, 100))


def test_layouts_become_the_same_turns(spark):
    records = spark.sql("""select 1L as conv_id, parse_json('{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"<s>"}]}') as record
        union all select 2L, parse_json('{"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":"<s>"}]}')
        union all select 3L, parse_json('{"prompt":"hi","completion":"<s>"}') union all select 4L, parse_json('{"instruction":"hi","input":"","output":"<s>"}')
        union all select 5L, parse_json('{"x":1}') union all select 6L, parse_json('{"question":"hi","answer":"<s>"}')""")
    got = {r.conv_id: (r.turns_sha256, r.loss_chars) for r in chat.digests(chat.formatted(chat.canonical(records, strict=False))).collect()}
    assert set(got) == {1, 2, 3, 4, 6} and len(set(got.values())) == 1 and got[1][1] == 3
    assert [r.paths for r in chat.unmapped(records).collect()] == ["OBJECT<x: _>"]
    with pytest.raises(Exception, match="OBJECT<x: _>"):
        chat.canonical(records).collect()


def test_chats_of_odd_rows(spark):
    rows = [(1, 0, "user", "hi", "x", 5), (1, 0, "user", "hi", "x", 5), (1, 0, "assistant", None, None, None), (1, None, None, "<s>[INST]\\</s>", "x", 1), (2, 3, "assistant", "b", "x", 1), (2, 3, "assistant", "a", "x", 1), (None, 1, "assistant", "é\\[" * 9000, "x", 1)]
    turns = chat.canonical(chat.from_rows(spark.createDataFrame(rows, CHAT)))
    got = {r.conv_id: r for r in chat.digests(chat.formatted(turns)).collect()}
    for conv in (1, 2, None):
        mine = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x, *_ in rows if c == conv))
        said, trained = "".join(f"{r}\n{x}\n" for _, r, x in mine), "".join(x for _, r, x in mine if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(mine), hashlib.sha256(said.encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(trained), hashlib.sha256(trained.encode()).hexdigest())


def test_main_text_leaves_boilerplate_out():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><a href=/>Home</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
    <div class="cookie-notice">We use cookies, always.</div><main><h1>The &amp; title</h1><p>First <b>bold</b>,&nbsp;then<br>more text, with commas, and stops.
    <p>Short.<script>var t="</p>";</script><form><input value=x>Name</form><blockquote>Quoted words, at some length, here.</blockquote></main>
    <aside>Related reading</aside><section id="comments"><p>Great post, thanks!</p></section><div class="ad">Buy now</div><footer>&copy; me</footer></body></html>"""
    assert html_paths.main_text(page) == "The & title\n\nFirst bold, then more text, with commas, and stops.\n\nShort.\n\nQuoted words, at some length, here."
    assert html_paths.main_text(None) == "" and html_paths.main_text("just text") == "just text"


@pytest.mark.parametrize("block", [256, 4, 1])
def test_classes_of_a_hot_group_at_any_block_size(spark, monkeypatch, block):
    rng, rows = random.Random(3), []
    for i in range(90):
        words = [f"w{k}" for k in range(120)]
        for _ in range(rng.randrange(4)):
            words[rng.randrange(120)] = f"x{rng.random()}"
        rows.append((i, words))
    bags = [Counter(zip(*(w[k:] for k in range(5)), strict=False)) for _, w in rows]
    want = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if bags[a] != bags[b] and (s := (bags[a] & bags[b]).total()) < 0.8 * (232 - s) - 1e-9:
                continue
            x, y = sorted((want[a], want[b]))
            want = [x if c == y else c for c in want]
    monkeypatch.setattr(bagminhash, "BLOCK", block)
    docs = frame(spark, [(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert {(r.doc_id, r.class_id) for r in bagminhash.classes(docs).collect()} == set(enumerate(want))


def fewest_sequences(pieces, capacity):
    """Optimum by trying every sequence for every piece, largest first."""

    def fits(k, rooms):
        if k == len(pieces):
            return True
        for at in {room: i for i, room in enumerate(rooms)}.values():
            if rooms[at] >= pieces[k] and fits(k + 1, [r - pieces[k] * (i == at) for i, r in enumerate(rooms)]):
                return True
        return False

    pieces = sorted(pieces, reverse=True)
    return next(n for n in range(len(pieces) + 1) if fits(0, [capacity] * n))


def test_bin_completion_tries_every_undominated_filling():
    hot = packing.plan({1000: 7, 318: 7, 280: 7, 250: 7, 200: 7})
    assert hot == [((1000, 318, 280, 250, 200), 7)]
    for seed in range(150):
        rng = random.Random(seed)
        lengths = [rng.randrange(8, 60) for _ in range(rng.randrange(3, 6))]
        pieces = [rng.choice(lengths) for _ in range(12)]
        found = packing.plan(Counter(pieces), 100, 10**6)
        assert Counter(x for pattern, times in found for x in pattern * times) == Counter(pieces) and all(sum(pattern) <= 100 for pattern, _ in found)
        assert sum(times for _, times in found) == fewest_sequences(pieces, 100)
