"""Regular grids and differences that respect gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def regularise(frames: DataFrame, keys: list[str], step: float, t: str = "t", tie: str = "tie", x: str = "x") -> DataFrame:
    """keys, slot, x on a complete grid from each key's first frame; the last frame of a slot wins, empty slots are null."""
    origin = frames.groupBy(*keys).agg(F.min(t).alias("t0"), F.max(t).alias("t1"))
    n = F.rint((F.col("t1") - F.col("t0")) / step).cast("int") + 1
    slots = origin.select(*keys, F.explode(F.sequence(F.lit(0), n - 1)).alias("slot"))
    placed = frames.join(origin, keys).withColumn("slot", F.rint((F.col(t) - F.col("t0")) / step).cast("int")).where(F.col("slot") < n)
    last = placed.groupBy(*keys, "slot").agg(F.max_by(x, F.struct(t, tie)).alias("x"))
    return slots.join(last, [*keys, "slot"], "left")


def rolling_median(grid: DataFrame, keys: list[str], half: int, least: int = 3) -> DataFrame:
    """Adds med: the median of the slots within `half`, of at least `least` values, else of all."""
    near = Window.partitionBy(*keys).orderBy("slot").rowsBetween(-half, half)
    every = Window.partitionBy(*keys)
    return grid.withColumn("med", F.when(F.count("x").over(near) >= least, F.percentile("x", F.lit(0.5)).over(near)).otherwise(F.percentile("x", F.lit(0.5)).over(every)))


def blanked(grid: DataFrame, keys: list[str], most: float) -> DataFrame:
    """Values whose change from the slot before exceeds `most` become null; `jump` marks them."""
    order = Window.partitionBy(*keys).orderBy("slot")
    marked = grid.withColumn("jump", F.coalesce(F.abs(F.col("x") - F.lag("x").over(order)) > most, F.lit(False)))
    return marked.withColumn("x", F.when(~F.col("jump"), F.col("x")))


def masked(grid: DataFrame, inside: str, columns: list[str]) -> DataFrame:
    """Values outside the mask become null."""
    return grid.withColumns({c: F.when(F.col(inside), F.col(c)) for c in columns})


def differenced(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Adds d (difference to the slot before, null beside a gap) and dd (of d)."""
    order = Window.partitionBy(*keys).orderBy("slot")
    first = grid.withColumn("d", F.col("x") - F.lag("x").over(order))
    return first.withColumn("dd", F.col("d") - F.lag("d").over(order))
