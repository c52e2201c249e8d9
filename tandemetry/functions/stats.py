"""Column expressions of the rank statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def avg_rank(x: str, *keys: str) -> Column:
    """Average rank of x among the rows of the keys; ties share their mean rank."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, x))
    return F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (ties - 1) / 2


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation as an aggregate, null where a side has no variance.  Both sides must be complete."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def rounded(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits) + F.lit(0.0)


def spearman(df: DataFrame, keys: list[str], x: str = "x", y: str = "y", least: int = 3) -> DataFrame:
    """keys, n and rho; incomplete pairs are dropped before ranking."""
    full = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = full.select(*keys, avg_rank(x, *keys).alias("rx"), avg_rank(y, *keys).alias("ry"))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), safe_corr("rx", "ry").alias("r")).select(*keys, "n", F.when(F.col("n") >= least, F.col("r")).alias("rho"))


def average_ranks(df: DataFrame, keys: list[str], x: str, name: str, ranges: int | None = None) -> DataFrame:
    """Adds the average rank of x within the keys without gathering a key in one task.

    Each key's values are cut at approximate quantiles into ranges; ranks are exact, as ranges only decide where rows are
    counted: a rank is the rows of the ranges below plus the place inside the row's own.  Equal values share a range.
    """
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    points = [k / ranges for k in range(1, ranges)]
    if not points:
        return df.withColumn(name, avg_rank(x, *keys))
    bounds = df.groupBy(*keys).agg(F.percentile_approx(x, points, 20 * ranges).alias("__bounds"))
    placed = df.join(bounds, keys).withColumn("__range", F.size(F.filter("__bounds", lambda b: b < F.col(x)))).drop("__bounds")
    # equal values are one row from here on, so a value that a third of the rows share weighs no more than any other
    counts = placed.groupBy(*keys, "__range", x).agg(F.count("*").alias("__ties"))
    totals = counts.groupBy(*keys, "__range").agg(F.sum("__ties").alias("__total"))
    below = totals.withColumn("__below", F.coalesce(F.sum("__total").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.sum("__ties").over(Window.partitionBy(*keys, "__range").orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranks = counts.withColumn("__upto", inside).join(below, [*keys, "__range"]).select(*keys, x, (F.col("__below") + F.col("__upto") - (F.col("__ties") - 1) / 2).alias(name))
    return df.join(ranks, [*keys, x], "left")


def leave_one_out(df: DataFrame, keys: list[str], item: str, x: str = "x", y: str = "y") -> DataFrame:
    """keys, item, rho: rank correlation of the others, for each item, without pairing items with each other.

    Leaving out value v lowers the rank of what is above it by one and of its equals by a half, so the sums of the changed
    ranks and of their products follow from cumulated sums in the order of x, of y, and of both.
    """
    full = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, item, F.col(x).alias("__x"), F.col(y).alias("__y"))
    rows = full.withColumn("rx", avg_rank("__x", *keys)).withColumn("ry", avg_rank("__y", *keys))
    every = Window.partitionBy(*keys)

    def above(by: str, what: Column) -> Column:
        """Sum of `what` over greater values and half of that over equal ones."""
        least = every.orderBy(F.col(by).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        same = Window.partitionBy(*keys, by)
        return F.sum(what).over(least) - F.sum(what).over(same) / 2

    rows = rows.withColumn("__n", F.count("*").over(every))
    for c in ("rx", "ry"):
        rows = rows.withColumn(f"__s{c}", F.sum(c).over(every)).withColumn(f"__q{c}", F.sum(F.col(c) * F.col(c)).over(every))
    rows = rows.withColumn("__p", F.sum(F.col("rx") * F.col("ry")).over(every))
    # cross terms: ry above in x, rx above in y, and the number above in both (equals count a half a side)
    rows = rows.withColumn("__yx", above("rx", F.col("ry"))).withColumn("__xy", above("ry", F.col("rx")))
    rows = rows.withColumn("__xx", above("rx", F.col("rx"))).withColumn("__yy", above("ry", F.col("ry")))
    rows = rows.withColumn("__nx", above("rx", F.lit(1.0))).withColumn("__ny", above("ry", F.lit(1.0)))
    rows = rows.withColumn("__ex", F.count("*").over(Window.partitionBy(*keys, "rx"))).withColumn("__ey", F.count("*").over(Window.partitionBy(*keys, "ry")))
    both = _above_both(rows, keys, item)
    rows = rows.join(both, [*keys, item])
    n = F.col("__n") - 1
    a, b = F.col("rx"), F.col("ry")
    # of the others: sum of ranks less the lowering, of squares, of products
    sx = F.col("__srx") - a - (F.col("__nx") - 0.5)
    sy = F.col("__sry") - b - (F.col("__ny") - 0.5)
    lx = F.col("__nx") - 0.25 * F.col("__ex") - 0.25  # sum of squared lowerings: 1 above, a quarter for each equal other
    ly = F.col("__ny") - 0.25 * F.col("__ey") - 0.25
    qx = F.col("__qrx") - a * a - 2 * (F.col("__xx") - a / 2) + lx
    qy = F.col("__qry") - b * b - 2 * (F.col("__yy") - b / 2) + ly
    p = F.col("__p") - a * b - (F.col("__yx") - b / 2) - (F.col("__xy") - a / 2) + F.col("__both") - 0.25
    vx, vy = qx - sx * sx / n, qy - sy * sy / n
    return rows.select(*keys, item, F.when((F.col("__n") > 3) & (vx > 1e-9) & (vy > 1e-9), (p - sx * sy / n) / F.sqrt(F.nullif(F.greatest(vx * vy, F.lit(0.0)), F.lit(0.0)))).alias("rho"))


def _above_both(rows: DataFrame, keys: list[str], item: str) -> DataFrame:
    """keys, item, __both: the others' weights above in x times above in y (1 greater, a half equal), itself a quarter.

    Counted over a grid with about the square root of the cohort a side: whole cells by cumulated counts, a row's own strips
    pair by pair, so the work is n**1.5, not n**2.
    """
    side = F.ceil(F.sqrt(F.col("__n")))
    placed = rows.select(*keys, item, "rx", "ry", F.floor(F.col("rx") / side).alias("cx"), F.floor(F.col("ry") / side).alias("cy"))
    cells = placed.groupBy(*keys, "cx", "cy").agg(F.count("*").alias("n"))
    ends = placed.groupBy(*keys).agg(F.max("cx").alias("tx"), F.max("cy").alias("ty"))
    grid = ends.withColumn("cx", F.explode(F.sequence(F.lit(0).cast("long"), "tx"))).withColumn("cy", F.explode(F.sequence(F.lit(0).cast("long"), "ty"))).join(cells, [*keys, "cx", "cy"], "left")
    upto = (Window.unboundedPreceding, -1)
    grid = grid.withColumn("up", F.coalesce(F.sum("n").over(Window.partitionBy(*keys, "cx").orderBy(F.col("cy").desc()).rowsBetween(*upto)), F.lit(0)))
    grid = grid.withColumn("far", F.coalesce(F.sum("up").over(Window.partitionBy(*keys, "cy").orderBy(F.col("cx").desc()).rowsBetween(*upto)), F.lit(0)))
    mine = placed.join(grid.select(*keys, "cx", "cy", "far"), [*keys, "cx", "cy"]).select(*keys, item, "far")
    others = placed.select(*(F.col(k).alias(f"__o{k}") for k in keys), F.col("rx").alias("ox_"), F.col("ry").alias("oy_"), F.col("cx").alias("dx"), F.col("cy").alias("dy"))
    same = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"__o{k}") for k in keys))
    weight = lambda v, w: F.when(F.col(w) > F.col(v), 1.0).when(F.col(w) == F.col(v), 0.5).otherwise(0.0)
    w = weight("rx", "ox_") * weight("ry", "oy_")
    strip_x = placed.join(others, same & (F.col("cx") == F.col("dx")) & (F.col("dy") >= F.col("cy"))).groupBy(*keys, item).agg(F.sum(w).alias("near"))
    strip_y = placed.join(others, same & (F.col("cy") == F.col("dy")) & (F.col("dx") > F.col("cx"))).groupBy(*keys, item).agg(F.sum(w).alias("next"))
    out = placed.select(*keys, item).join(mine, [*keys, item], "left").join(strip_x, [*keys, item], "left").join(strip_y, [*keys, item], "left")
    return out.select(*keys, item, (F.coalesce("far", F.lit(0)) + F.coalesce("near", F.lit(0.0)) + F.coalesce("next", F.lit(0.0))).alias("__both"))


def partial_spearman(df: DataFrame, keys: list[str], x: str = "x", y: str = "y", z: str = "z", least: int = 8) -> DataFrame:
    """keys, n, rho, rho_<z> (of z with y) and partial, the rank correlation of x and y given z; complete rows only."""
    full = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    ranked = full.select(*keys, avg_rank(x, *keys).alias("rx"), avg_rank(y, *keys).alias("ry"), avg_rank(z, *keys).alias("rz"))
    got = ranked.groupBy(*keys).agg(F.count("*").alias("n"), safe_corr("rx", "ry").alias("xy"), safe_corr("rx", "rz").alias("xz"), safe_corr("ry", "rz").alias("yz"))
    size = (1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz"))
    part = F.when((F.col("n") >= least) & (size > 1e-12), (F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt(F.nullif(F.greatest(size, F.lit(0.0)), F.lit(0.0))))
    return got.select(*keys, "n", F.col("xy").alias("rho"), F.col("yz").alias("rho_duration" if z == "seconds" else f"rho_{z}"), part.alias("partial"))


def benjamini_hochberg(df: DataFrame, keys: list[str], p: str, order: list[str]) -> DataFrame:
    """Adds q and m: p * m / rank, cumulated from the largest p down, at most 1; null p stay null and do not count."""
    by = Window.partitionBy(*keys, F.col(p).isNull())
    ranked = df.withColumn("m", F.count(p).over(Window.partitionBy(*keys))).withColumn("__rank", F.row_number().over(by.orderBy(p, *order)))
    down = by.orderBy(p, *order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("m") / F.col("__rank")).over(down))
    return ranked.withColumn("q", F.when(F.col(p).isNotNull(), q)).drop("__rank")


def permuted(df: DataFrame, keys: list[str], item: str, replicates: int) -> DataFrame:
    """df once a replicate, with `slot`, the item's place in a hash-ordered permutation of the keys' items."""
    reps = df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    draw = F.md5(F.concat_ws(":", F.col("rep").cast("string"), F.col(item).cast("string")))
    return reps.withColumn("slot", F.row_number().over(Window.partitionBy(*keys, "rep").orderBy(draw, item)))
