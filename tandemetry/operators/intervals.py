"""Interval operators: unions, lengths, joins and runs, keyed so that no join is without an equality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-6


def union_spans(df: DataFrame, keys: list[str], a: str = "a", b: str = "b", epsilon: float = EPSILON) -> DataFrame:
    """Disjoint spans (keys, a, b) that cover the same time; degenerate spans are dropped, gaps of at most epsilon are joined."""
    spans = df.where(F.col(b) > F.col(a)).select(*keys, F.col(a).alias("a"), F.col(b).alias("b"))
    order = Window.partitionBy(*keys).orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("a") > reach + epsilon), 1).otherwise(0)
    islands = spans.withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return islands.groupBy(*keys, "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("island")


def union_length(df: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """keys, total (covered time) and n_spans."""
    return union_spans(df, keys, a, b, 0.0).groupBy(*keys).agg(F.sum(F.col("b") - F.col("a")).alias("total"), F.count("*").alias("n_spans"))


def points_in_spans(points: DataFrame, spans: DataFrame, keys: list[str], t: str = "t", bucket: float = 86400.0) -> DataFrame:
    """Points with the span (a, b) that holds them, a <= t < b.  Spans are dealt to time buckets, so long keys are split and the join has an equality besides the keys."""
    cut = spans.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("a") / bucket), F.floor(F.col("b") / bucket))))
    return points.withColumn("__bucket", F.floor(F.col(t) / bucket)).join(cut, [*keys, "__bucket"]).where((F.col(t) >= F.col("a")) & (F.col(t) < F.col("b"))).drop("__bucket")


def nearest(points: DataFrame, others: DataFrame, keys: list[str], item: str, t: str = "t") -> DataFrame:
    """Each point with the nearest of the others of its keys (item) and the gap; of equal gaps the earlier, then the least item.

    Both go on one line a key, where the last other before a point and the first one after it are all that can be nearest.
    """
    mine = points.select("*", F.lit(None).cast(others.schema[item].dataType).alias("__item"), F.lit(True).alias("__point"))
    rest = others.select(*keys, t, F.col(item).alias("__item"), F.lit(False).alias("__point"))
    line = mine.unionByName(rest, allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy(t, F.col("__point"), F.col("__item").desc())
    after = Window.partitionBy(*keys).orderBy(F.col(t).desc(), F.col("__point"), F.col("__item").desc())
    last = lambda w: F.last(F.when(~F.col("__point"), F.struct(F.col(t).alias("t"), F.col("__item").alias("item"))), ignorenulls=True).over(w)
    both = line.withColumn("__b", last(before)).withColumn("__a", last(after)).where("__point")
    to = lambda c: F.abs(F.col(f"{c}.t") - F.col(t))
    first = F.col("__b").isNotNull() & (F.col("__a").isNull() | (to("__b") <= to("__a")))
    chosen = F.when(first, F.col("__b")).otherwise(F.col("__a"))
    return both.withColumn("__c", chosen).where("__c is not null").select(*points.columns, F.col("__c.item").alias(item), F.abs(F.col("__c.t") - F.col(t)).alias("gap"))


def contiguous_runs(df: DataFrame, keys: list[str], slot: str, flag: str, least: int = 1) -> DataFrame:
    """keys, first, last and length of maximal runs of consecutive slots where the flag holds."""
    on = df.where(F.col(flag))
    island = F.col(slot) - F.row_number().over(Window.partitionBy(*keys).orderBy(slot))
    return on.withColumn("__island", island).groupBy(*keys, "__island").agg(F.min(slot).alias("first"), F.max(slot).alias("last"), F.count("*").alias("length")).where(F.col("length") >= least).drop("__island")
