"""Long rows of features (keys, feature, value) and the statistic bundles that they are made of."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ("pid", "task", "half")


def five(x: Column, least: int = 4) -> dict[str, Column]:
    """Mean, root mean square, median, 90 % point and interquartile range as aggregates; null for fewer than `least` values."""
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(0.9)))
    got = {"mean": F.avg(x), "rms": F.sqrt(F.avg(x * x)), "med": q[1], "p90": q[3], "iqr": q[2] - q[0]}
    return {k: F.when(F.count(x) >= least, v) for k, v in got.items()}


def four(x: Column, least: int = 3) -> dict[str, Column]:
    """Median, mean, interquartile range and 90 % point."""
    return {k: v for k, v in five(x, least).items() if k != "rms"}


def named(prefix: str, bundle: dict[str, Column]) -> dict[str, Column]:
    return {f"{prefix}_{k}" if prefix else k: v for k, v in bundle.items()}


def grouped(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*(v.alias(k) for k, v in values.items()))


def long(df: DataFrame, columns: list[str], prefix: Column | None = None, keys: tuple[str, ...] = CELL) -> DataFrame:
    """keys, feature, value of the given columns; a feature is the column's name behind the prefix; nulls are left out."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns)))
    name = F.col("f.feature") if prefix is None else F.concat_ws("_", prefix, F.col("f.feature"))
    return df.withColumn("f", each).select(*keys, name.alias("feature"), F.col("f.value").alias("value")).where("value is not null and not isnan(value)")


def runs(df: DataFrame, keys: list[str], columns: list[str], least: int, most: int | None = None) -> DataFrame:
    """keys, runs: arrays of the columns over stretches of consecutive slots, `most` longest, in order of length, then time."""
    island = F.col("slot") - F.row_number().over(Window.partitionBy(*keys).orderBy("slot"))
    each = df.withColumn("__i", island).groupBy(*keys, "__i").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("slot", *(c for c in columns if c != "slot")))).alias("r")).where(F.col("n") >= least)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.element_at("r", 1)["slot"].alias("first"), F.struct(*(_part(c).alias(c) for c in columns)).alias("run"))))
    chosen = ordered if most is None else F.slice(ordered, 1, most)
    return each.groupBy(*keys).agg(chosen.alias("runs")).withColumn("runs", F.transform("runs", lambda x: x["run"]))


def _part(column: str) -> Column:
    return F.transform("r", lambda x: x[column])


def by_kernel(df: DataFrame, column: str, kernel: Callable[[list], dict[str, float]]) -> DataFrame:
    """Adds `values`, a map of what the kernel makes of each row's runs; through Arrow, whole batches at a time."""

    @F.pandas_udf("map<string, double>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: {k: float(v) for k, v in kernel(x).items() if v == v})

    return df.withColumn("values", run(column))


def from_map(df: DataFrame, prefix: Column, keys: tuple[str, ...] = CELL) -> DataFrame:
    """Long rows of a map column `values`."""
    return df.select(*keys, prefix.alias("__p"), F.explode("values").alias("k", "value")).select(*keys, F.concat_ws("_", "__p", "k").alias("feature"), "value")


def wide(rows: DataFrame, names: list[str], keys: tuple[str, ...] = CELL) -> DataFrame:
    """One row of features a cell, in the given order; a feature that a cell lacks is null."""
    return rows.groupBy(*keys).pivot("feature", names).agg(F.first("value"))
