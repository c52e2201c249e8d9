"""Selections, lookups and bins that the reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemetry.functions.stats import avg_rank, safe_corr
from tandemetry.operators import intervals


def longest_runs(df: DataFrame, keys: list[str], slot: str, flag: str, most: int, least: int = 1) -> DataFrame:
    """The `most` longest runs of each key with their place, longest first, then earliest."""
    runs = intervals.contiguous_runs(df, keys, slot, flag, least)
    return runs.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("length").desc(), "first"))).where(F.col("place") <= most)


def strongest(df: DataFrame, keys: list[str], value: str, passes: Column, order: str) -> DataFrame:
    """keys, the row of largest |value| among those that pass, else among all; `stage` tells which; the first by `order` of equals."""
    known = df.where(F.col(value).isNotNull()).withColumn("__pass", F.coalesce(passes, F.lit(False)))
    by = Window.partitionBy(*keys).orderBy(F.col("__pass").desc(), F.abs(F.col(value)).desc(), order)
    return known.withColumn("__k", F.row_number().over(by)).where("__k = 1").withColumn("stage", F.when(F.col("__pass"), "stage").otherwise("fallback")).drop("__k", "__pass")


def most_common(df: DataFrame, keys: list[str], item: str, seen: str, most: int) -> DataFrame:
    """keys, item, n, place: the commonest items, of equals the one seen first."""
    counted = df.groupBy(*keys, item).agg(F.count("*").alias("n"), F.min(seen).alias("__first"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), "__first"))).where(F.col("place") <= most).drop("__first")


def quantile_bins(df: DataFrame, x: str, parts: int = 4) -> DataFrame:
    """Adds bin, from 1: intervals between the distinct quantile edges, closed above, the lowest closed below too."""
    edges = df.agg(F.array_distinct(F.percentile(x, F.array(*(F.lit(k / parts) for k in range(parts + 1))))).alias("__edges"))
    inner = F.slice("__edges", 2, F.size("__edges") - 2)
    return df.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter(inner, lambda e: e < F.col(x))) + 1).drop("__edges")


def reranked(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, pooled, again: correlation of the mean of two columns' ranks with y's rank, as it is and ranked anew.  Columns xa, xb, y."""
    ranked = df.select(*keys, avg_rank("xa", *keys).alias("ra"), avg_rank("xb", *keys).alias("rb"), avg_rank("y", *keys).alias("ry")).withColumn("z", (F.col("ra") + F.col("rb")) / 2)
    return ranked.withColumn("rz", avg_rank("z", *keys)).groupBy(*keys).agg(F.count("*").alias("n"), safe_corr("z", "ry").alias("pooled"), safe_corr("rz", "ry").alias("again"))


def part_of(points: DataFrame, parts: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Points with the recording part (a, b, offset and others) that holds them and `local`, the time within it."""
    return intervals.points_in_spans(points, parts, keys, t).withColumn("local", F.col(t) - F.col("a"))


def initiated(chains: DataFrame, seconds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, initiator, n, ge4, ge4_per_min, any: chains that each person began, rows of none included.  chains: keys, initiator, length; seconds: keys, seconds."""
    every = seconds.select(*keys, "seconds", F.explode(F.array(F.lit("child"), F.lit("examiner"))).alias("initiator"))
    counted = chains.groupBy(*keys, "initiator").agg(F.count("*").alias("n"), F.count_if(F.col("length") >= 4).alias("ge4"))
    rows = every.join(counted, [*keys, "initiator"], "left").fillna(0, ["n", "ge4"])
    return rows.select(*keys, "initiator", "n", "ge4", F.try_divide(F.col("ge4"), F.col("seconds") / 60).alias("ge4_per_min"), (F.col("n") > 0).alias("any"))


def top_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows."""
    return df.orderBy(*order).limit(n)
