"""Sinks for result tables, thresholds and run records."""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def finite(value: Any) -> Any:
    """A value that JSON can hold: what is not finite is null, paths and the like are text."""
    if isinstance(value, dict):
        return {str(k): finite(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set):
        return [finite(v) for v in value]
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return value if value is None or isinstance(value, bool | int | str) else str(value)


def table(df: DataFrame, path: str) -> None:
    """A result table as CSV with a header; part files, written by all tasks."""
    df.write.mode("overwrite").option("header", True).csv(path)


def record(spark: SparkSession, value: dict, path: str) -> None:
    """A run's record as one JSON document."""
    spark.createDataFrame([(json.dumps(finite(value), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def thresholds(spark: SparkSession, values: dict[str, float], path: str) -> None:
    """Thresholds, once: a second write to the same path fails, so observed statistics cannot move them."""
    spark.createDataFrame([(json.dumps(finite(values), sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def reused(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path if it is complete there, else make() written to it and read again."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
