"""Sharding by sampled splitters, DataFrame functions only.

Records are ordered by a key: a hash of the text, then the doc_id.  A
size-weighted sample of keys gives quantile boundaries; records are
range-partitioned by them, each range into stretches of about STRETCH_BYTES, so their
number grows with the input; as keys are hashes, a stretch is a part of the range's
keys.  Stretches that turn out overfull (a hot group of copies) are subdivided by a
hash of the doc_id.  Exact sums of the stretches then place each record on one line
of cumulated bytes, which shard ends cut into equal parts.

The law that holds is `bytes`: the sizes of any two shards differ by about one
record, or one small group of copies.  Rows with equal texts go to one shard
unless their group is larger than GROUP_SHARE of a shard.

Defined results: a null text has no bytes, size 16 and the CRC of nothing; a
null doc_id sorts first; repeated rows are placed one after another.  An empty
table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemetry.llm.common import drop_staged, staged

#: Bytes that each record costs besides its text.
OVERHEAD = 16
#: Ranges for each shard, and sampled keys for each range.
RANGES_A_SHARD, SAMPLES_A_RANGE = 8, 100
#: Bytes that one stretch of a range, which one task sorts, holds about.
STRETCH_BYTES = 1 << 28
#: Rows of the table of stretches that may be broadcast.
BROADCAST_ROWS = 1_000_000
#: A group of equal texts of at most this share of a shard is not divided.
GROUP_SHARE = 0.01


def sized(docs: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("h"))


def splitters(records: DataFrame, shards: int, total: int) -> list[int]:
    """Quantile boundaries of a size-weighted sample of keys.

    A key is drawn as often as its size holds sampling steps, with a hashed
    remainder, so the sample has about shards * RANGES_A_SHARD * SAMPLES_A_RANGE
    draws at any input size.  The quantiles are a mergeable aggregate.
    """
    ranges = shards * RANGES_A_SHARD
    step = max(1.0, total / (ranges * SAMPLES_A_RANGE))
    u = F.pmod(F.xxhash64(F.lit("draw"), "h", "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    draws = F.floor(F.col("size") / step + u).cast("int")
    sample = records.where(draws > 0).select("h", draws.alias("draws"))
    points = [i / ranges for i in range(1, ranges)]
    # percentile_approx has no frequency argument: each draw is one row, so the sum of draws stays near the fixed sample size
    row = sample.select("h", F.explode(F.sequence(F.lit(1), "draws"))).agg(F.percentile_approx("h", points, 20 * ranges).alias("q")).head()
    return sorted(set(row.q or []))


def _range_of(h: Column, bounds: list[int]) -> Column:
    """Number of boundaries at or below the key, by a search that halves."""

    def search(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(h < bounds[m], search(a, m)).otherwise(search(m + 1, b))

    return search(0, len(bounds))


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    records = staged(sized(docs), "sized")
    total = records.agg(F.sum("size")).head()[0] or 0
    target = max(1.0, total / shards)
    bounds = splitters(records, shards, total)
    share = max(1.0, target / RANGES_A_SHARD)
    ends = [-(1 << 63), *bounds, 1 << 63]
    low, high = (F.element_at(F.array(*(F.lit(float(e)) for e in part)), F.col("r") + 1) for part in (ends[:-1], ends[1:]))
    ranged = records.withColumn("r", _range_of(F.col("h"), bounds))
    pieces = ranged.groupBy("r").agg(F.ceil(F.sum("size") / STRETCH_BYTES).cast("long").alias("pieces"))
    # the table of ranges is bounded by shards * RANGES_A_SHARD
    cut = ranged.join(F.broadcast(pieces), "r").withColumn("s", F.least(F.col("pieces") - 1, F.floor((F.col("h") - low) / (high - low) * F.col("pieces"))).cast("long")).drop("pieces")
    sizes = staged(cut.groupBy("r", "s").agg(F.sum("size").alias("piece_size")), "stretches")
    few = sizes.count() <= BROADCAST_ROWS
    some = F.broadcast if few else (lambda df: df.hint("merge"))
    most = min(share, float(STRETCH_BYTES))
    parts = F.when(F.col("piece_size") > 2 * most, F.ceil(F.col("piece_size") / most)).otherwise(1).cast("int")
    split = cut.join(some(sizes.select("r", "s", parts.alias("parts"))), ["r", "s"]).withColumn("sub", F.when(F.col("parts") > 1, F.pmod(F.xxhash64(F.lit("sub"), "doc_id"), F.col("parts"))).otherwise(0).cast("int"))
    line = ["r", "s", "sub"]
    sums = split.groupBy(*line).agg(F.sum("size").alias("bytes"))
    # cumulated within ranges, then over the ranges, so no task sees all stretches
    of_range = sums.groupBy("r").agg(F.sum("bytes").alias("range_bytes")).withColumn("range_base", F.coalesce(F.sum("range_bytes").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = sums.withColumn("inside", F.coalesce(F.sum("bytes").over(Window.partitionBy("r").orderBy("s", "sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    base = inside.join(F.broadcast(of_range), "r").select(*line, (F.col("inside") + F.col("range_base")).alias("base"))
    split = split.join(some(base), line)
    ordered = Window.partitionBy(*line).orderBy("h", "doc_id", "size", "text_crc32")
    before = F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    of_group = Window.partitionBy(*line, "h")
    placed = (
        split.withColumn("at", F.col("base") + before)
        .withColumn("group_size", F.sum("size").over(of_group))
        .withColumn("group_at", F.min("at").over(of_group))
    )
    whole = (F.col("group_size") <= GROUP_SHARE * target) & (F.col("parts") == 1)
    middle = F.when(whole, F.col("group_at") + F.col("group_size") / 2).otherwise(F.col("at") + F.col("size") / 2)
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle / target)).cast("int"))
    placed = staged(placed.select("doc_id", "size", "text_crc32", "h", "shard", *line), "placed")
    drop_staged(records)
    own = Window.partitionBy(*line, "shard").orderBy("h", "doc_id", "size", "text_crc32")
    ahead = (
        placed.groupBy("shard", *line).agg(F.count("*").alias("n"))
        .withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy(*line).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )
    return (
        placed.withColumn("rn", F.row_number().over(own))
        .join(some(ahead.select("shard", *line, "ahead")), ["shard", *line])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("ahead") + F.col("rn") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
