"""Near-duplicates by BagMinHash signatures of shingle multisets.

A text is the multiset of its five-word shingles.  For a shingle of weight w the
integer weights [0, w) are covered by dyadic blocks [0, 1), [1, 2), [2, 4), ...;
each block is a Poisson process in time, whose points carry a signature
component and a weight position, and only points below w count.  A component's
minimum time is equal for two texts with the probability of their weighted
Jaccard similarity.  Points are drawn in time order and a document stops when
its next points lie beyond its largest minimum, so heavy weights cost little.

Texts with equal word sequences are one class from the start, represented by the
smallest doc_id.  Signatures are cut into BANDS bands of ROWS components; in
each bucket of a band, members are linked with the bucket's smallest document
where the exact weighted Jaccard reaches the threshold.  Buckets whose members
are then still in different components are searched block by block, leaving out
what lies inside the bucket's largest component: where the
signatures of members of different components are within reach of the threshold,
the exact similarity is computed, and a link that joins two components is kept.
So no link that a class depends on is lost, and no bucket's pairs are emitted.  A pair at similarity 0.8 shares no bucket
with probability (1 - 0.8**5)**25 < 5e-5.

Defined results: null and wordless texts have the empty multiset and are one
class; a text of one to four words is one shingle, and a text of any length is
read whole.  Different texts that share a doc_id, and texts without one, take part
under names of their own; class_id is the smallest doc_id of the class, null where
none has one.  Repeated rows give repeated results.  An empty table gives an empty
result.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandemetry.llm import kernels as K
from tandemetry.llm.common import by_ids, drop_staged, staged, tidied
from tandemetry.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
M = BANDS * ROWS
#: Members of a bucket that one block of the second search holds.
BLOCK = 256
#: Standard errors of the signature estimate below the threshold at which a pair of blocks is no longer verified.
ERRORS = 5.0
_ONE = 1.0 / (1 << 53)


def multiset(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) and their weights; document numbers below 65536, shingles by 48 bits."""
    key = np.sort((doc.astype(np.uint64) << K.U64(48)) | (h >> K.U64(16)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(key)))
    key = key[at]
    return (key >> K.U64(48)).astype(np.int64), key & K.U64((1 << 48) - 1), weight


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """Minimum times [n, m]; rows of documents without shingles stay infinite."""
    levels = np.ones(len(weight), np.int64)
    heavy = weight > 1
    levels[heavy] += np.ceil(np.log2(weight[heavy])).astype(np.int64)
    element = np.repeat(np.arange(len(weight)), levels)
    level = np.arange(len(element)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    size = np.where(level > 0, np.maximum(low, 1), 1)
    d, top = doc[element], weight[element]
    flat = np.full(n * m, np.inf)
    with np.errstate(over="ignore"):
        seed = K.mix(shingle[element] * K.U64(0x9E3779B97F4A7C15) + level.astype(np.uint64))
        time = np.zeros(len(seed))
        step = 0
        while len(seed):
            many = int(np.clip(8192 // len(seed), 1, 512))  # points drawn for each block at once
            counter = np.arange(step + 1, step + many + 1, dtype=np.uint64) * K.U64(0xD1342543DE82EF95)
            x = K.mix(seed[:, None] + counter)
            y = K.mix(x ^ K.U64(0xA0761D6478BD642F))
            gaps = -np.log(((x >> K.U64(11)).astype(float) + 0.5) * _ONE) / size[:, None]
            gaps[:, 0] += time
            times = np.cumsum(gaps, axis=1)
            component = ((y >> K.U64(32)) * K.U64(m) >> K.U64(32)).astype(np.int64)
            position = low[:, None] + ((y & K.U64(0xFFFFFFFF)) * size[:, None].astype(np.uint64) >> K.U64(32)).astype(np.int64)
            inside = position < top[:, None]
            np.minimum.at(flat, (d[:, None] * m + component)[inside], times[inside])
            limit = flat.reshape(n, m).max(axis=1)
            time = times[:, -1]
            go = time < limit[d]
            seed, d, low, size, top, time = seed[go], d[go], low[go], size[go], top[go], time[go]
            step += many
    return flat.reshape(n, m)


def bands(times: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key of each band."""
    bits = np.ascontiguousarray(times).view(np.uint64).reshape(len(times), n_bands, rows)
    with np.errstate(over="ignore"):
        x = np.broadcast_to(np.arange(1, n_bands + 1, dtype=np.uint64) * K.U64(0x9E3779B97F4A7C15), (len(times), n_bands)).copy()
        for k in range(rows):
            x = K.mix(x + bits[:, :, k])
    return x.view(np.int64)


def _slices(batch: pa.RecordBatch):
    """Words of each slice of at most 65536 documents."""
    for a, b, data, offs in K.text_slices(batch, "text"):
        for c in range(0, b - a, 1 << 16):
            o = offs[c : min(c + (1 << 16), b - a) + 1]
            part = data[o[0] : o[-1]]
            starts, ends, first = K.word_spans(part, o - o[0])
            yield a + c, len(o) - 1, K.span_hashes(part, starts, ends), first


def _column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


def _sign(batches):
    for batch in batches:
        for a, n, h, first in _slices(batch):
            doc, s = K.shingles(h, first, SHINGLE)
            times = signatures(*multiset(doc, s), n)
            full = np.diff(first) > 0
            k1, k2 = K.sequence_key(h, first)
            keys = bands(times)
            short = (K.mix(times.view(np.uint64)) >> K.U64(56)).astype(np.uint8)
            flat = pa.array(keys[full].ravel())
            ends = np.concatenate([[0], np.cumsum(np.where(full, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [_column(batch, "doc_id").slice(a, n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array([x.tobytes() for x in short], pa.binary())],
                ["doc_id", "k1", "k2", "bands", "sig"],
            )


def keyed(docs: DataFrame) -> DataFrame:
    """Every row with k1 and k2, which are equal for equal word sequences."""

    def run(batches):
        for batch in batches:
            for a, n, h, first in _slices(batch):
                keys = (pa.array(k.view(np.int64)) for k in K.sequence_key(h, first))
                yield pa.RecordBatch.from_arrays([*(_column(batch, c).slice(a, n) for c in batch.schema.names), *keys], [*batch.schema.names, "k1", "k2"])

    return docs.mapInArrow(tidied(run), T.StructType([*docs.schema.fields, T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())]))


def bag(h: np.ndarray) -> np.ndarray:
    """A multiset of shingles as a sorted set: the k-th copy of a shingle is an entry of its own."""
    h = np.sort(h)
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(first)
    copy = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))
    with np.errstate(over="ignore"):
        return np.sort(K.mix(h + copy.astype(np.uint64) * K.U64(0xE7037ED1A0B428DB)))


def _bags(batches):
    for batch in batches:
        for a, n, h, first in _slices(batch):
            doc, s = K.shingles(h, first, SHINGLE)
            cut = np.searchsorted(doc, np.arange(n + 1))
            got = [bag(s[cut[i] : cut[i + 1]]).tobytes() for i in range(n)]
            yield pa.RecordBatch.from_arrays([_column(batch, "doc_id").slice(a, n), pa.array(got, pa.binary())], ["doc_id", "bag"])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two bags."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(a) + len(b) - shared)


def _verify(threshold):
    def run(batches):
        for batch in batches:
            x, y = batch.column("bag_a"), batch.column("bag_b")
            keep = [similarity(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)) >= threshold for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def bags_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id and bag of the given documents."""
    ids = staged(ids.distinct(), "bag-ids")
    texts = by_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids, "doc_id", "left_semi")
    out = staged(texts.mapInArrow(tidied(_bags), "doc_id long, bag binary").dropDuplicates(["doc_id"]), "bags")
    drop_staged(ids)
    return out


def verified(pairs: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) of doc_ids whose texts reach the threshold exactly."""
    bags = bags_of(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b"))), docs)
    a = bags.select(F.col("doc_id").alias("a"), F.col("bag").alias("bag_a"))
    b = bags.select(F.col("doc_id").alias("b"), F.col("bag").alias("bag_b"))
    out = staged(pairs.join(a, "a").join(b, "b").select("a", "b", "bag_a", "bag_b").mapInArrow(tidied(_verify(threshold)), "a long, b long"), "verified")
    drop_staged(bags)
    return out


def _links(rows: list[tuple], threshold: float, least: float) -> list[tuple[int, int]]:
    """Verified links of one block with itself or another that join different components, at most one fewer than components.

    rows: (second block, rep, component, sig, bag), each rep once.
    """
    roots: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := roots.get(x, x)) != x:
            roots[x] = x = roots.get(up, up)
        return x

    right = [r for r in rows if r[0]]
    left = [r for r in rows if not r[0]]
    both = right or left
    sigs = np.frombuffer(b"".join(r[3] for r in both), np.uint8).reshape(len(both), M)
    sizes = np.array([len(r[4]) for r in both])
    out = []
    for i, (_, rep, component, sig, own) in enumerate(left):
        match = (sigs == np.frombuffer(sig, np.uint8)).mean(axis=1)
        near = np.flatnonzero((match >= least) & (np.minimum(sizes, len(own)) >= threshold * np.maximum(sizes, len(own)) - 1e-9))
        for j in near[np.argsort(-match[near], kind="stable")]:
            _, other, far, _, bag_ = both[j]
            if (right or j > i) and find(component) != find(far) and similarity(np.frombuffer(own, np.uint64), np.frombuffer(bag_, np.uint64)) >= threshold:
                roots[find(component)] = find(far)
                out.append((rep, other))
    return out


def _search(threshold: float):
    """Blocks arrive sorted by (bucket, x, y); one is held at a time."""
    least = threshold - ERRORS * (threshold * (1 - threshold) / M) ** 0.5
    names = ["bucket", "x", "y", "second", "rep", "component", "sig", "bag"]

    def table(links):
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

    def run(batches):
        key, rows, links = None, [], []
        for batch in batches:
            for bucket, x, y, *row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if (bucket, x, y) != key:
                    links += _links(rows, threshold, least) if len(rows) > 1 else []
                    key, rows = (bucket, x, y), []
                rows.append(row)
            yield table(links)
            links = []
        yield table(_links(rows, threshold, least) if len(rows) > 1 else [])

    return run


def residual_links(buckets: DataFrame, labels: DataFrame, sigs: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Verified links (a, b) in buckets whose members are in different components, enough of them to join all that belong together."""
    named = buckets.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    parts = named.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    open_ = parts.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("core"), F.sum("n").alias("n")).where("core.n < n").select("bucket", F.col("core.component").alias("core"), F.col("core.n").alias("n_core"), "n")
    members = staged(named.join(open_, "bucket"), "members")
    bags = bags_of(members.select(F.col("rep").alias("doc_id")), docs).withColumnRenamed("doc_id", "rep")
    # a bucket of at most one block is that block; a larger one has blocks of its largest component, the core, after those of the rest
    whole, inside = F.col("n") <= BLOCK, F.col("component") == F.col("core")
    k_core, k_rest = F.ceil(F.col("n_core") / BLOCK).cast("int"), F.ceil((F.col("n") - F.col("n_core")) / BLOCK).cast("int")
    place = F.when(whole, 0).when(inside, k_rest + F.pmod(F.xxhash64("rep"), k_core).cast("int")).otherwise(F.pmod(F.xxhash64("rep"), k_rest).cast("int"))
    # members of the core need no comparison with each other, so core blocks meet those of the rest alone
    last = F.when(whole, 0).when(inside, k_rest - 1).otherwise(k_rest + k_core - 1)
    pairs = members.select("bucket", "rep", "component", place.alias("i"), F.explode(F.sequence(F.lit(0), last)).alias("j"))
    keyed = pairs.select("bucket", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), (F.col("i") > F.col("j")).alias("second"), "rep", "component")
    # signatures and bags meet once a document, before they are dealt to its block pairs
    filled = keyed.join(bags.join(sigs, "rep"), "rep").select("bucket", "x", "y", "second", "rep", "component", "sig", "bag")
    dealt = filled.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    out = staged(dealt.mapInArrow(tidied(_search(threshold)), "a long, b long").distinct(), "residual")
    drop_staged(members, bags)
    return out


def _own_names(signed: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """signed and rows with `node`, a name that one text alone has: its doc_id, or a negative hash where the id is null or another text's too."""
    odd = signed.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("least"), F.max(F.struct("k1", "k2")).alias("most")).where("doc_id is null or least <> most")
    odd = staged(odd.select("doc_id"), "odd-ids")
    if not odd.limit(1).count():
        drop_staged(odd)
        return signed.withColumn("node", F.col("doc_id")), rows.withColumn("node", F.col("doc_id")), False

    def named(df: DataFrame) -> DataFrame:
        marked = df.join(odd.select(F.col("doc_id").alias("odd"), F.lit(True).alias("is_odd")), F.col("doc_id").eqNullSafe(F.col("odd")), "left")
        own = -F.lit(1 << 62) - F.pmod(F.xxhash64("doc_id", "k1", "k2"), F.lit(1 << 61))
        return marked.withColumn("node", F.when(F.col("is_odd"), own).otherwise(F.col("doc_id"))).drop("odd", "is_odd")

    return named(signed), named(keyed(rows)), True


def labelled(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, k1, k2 (equal for equal word sequences) and class, a name of the class, of every row; class_id is its smallest doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = staged(rows.mapInArrow(tidied(_sign), "doc_id long, k1 long, k2 long, bands array<long>, sig binary"), "signatures")
    signed_, rows_, odd = _own_names(signed, rows)
    rows_ = rows_.select(F.col("node").alias("doc_id"), "text")
    reps = staged(signed_.groupBy("k1", "k2").agg(F.min("node").alias("rep"), F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "representatives")
    keys = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.min("rep").alias("leader"), F.max("rep").alias("hi")).where("leader <> hi").select("bucket", "leader")
    buckets = staged(keys.join(shared, "bucket"), "buckets")
    stars = buckets.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    first = verified(stars, rows_, threshold)
    labels = components(first)
    rest = residual_links(buckets.select("bucket", "rep"), labels, reps.select("rep", "sig"), rows_, threshold)
    if rest.limit(1).count():
        drop_staged(labels)
        labels = components(first.union(rest))
    named = reps.join(labels, reps.rep == labels.node, "left").select("k1", "k2", "id", F.coalesce("component", "rep").alias("class"))
    if odd:
        named = staged(named, "named")
        named = named.join(named.groupBy("class").agg(F.min("id").alias("class_id")), "class").select("k1", "k2", "class", "class_id")
    else:
        named = named.select("k1", "k2", "class", F.col("class").alias("class_id"))
    named = staged(named, "classes")
    out = staged(signed.select("doc_id", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", "k1", "k2", "class", "class_id"), "classed")
    drop_staged(signed, reps, buckets, first, labels, rest, named)
    return out


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of the class) of every row."""
    return labelled(docs, threshold).select("doc_id", "class_id")
