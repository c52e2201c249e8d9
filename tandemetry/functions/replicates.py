"""Kernels over the arrays of cells, through Arrow: cells and parts of their replicates are dealt over all tasks.

A cell's row holds arrays of a number a participant, so it is bounded by the cohort; its replicates are not gathered
anywhere, a task makes those of its part and gives back what it finds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: Array elements that one part of a cell's replicates goes through, and the most parts of a cell.
PART_ELEMENTS = 50_000_000
MOST_PARTS = 64


class Rows:
    """The items of a cell: an Arrow array of structs, whose fields are read as arrays of numbers without a Python object an item."""

    def __init__(self, structs: pa.StructArray):
        self.structs = structs

    def __len__(self) -> int:
        return len(self.structs)

    def values(self, name: str) -> np.ndarray:
        return self.structs.field(name).to_numpy(zero_copy_only=False)

    def matrix(self, name: str) -> np.ndarray:
        """A field of lists of one length: a row an item."""
        return self.structs.field(name).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(self), -1)


def decoded(column: pa.Array, k: int):
    """A cell's value: Rows for a list of structs, an array for a list, else a plain value."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        values = column[k].values
        return Rows(values) if pa.types.is_struct(values.type) else values.to_numpy(zero_copy_only=False)
    return column[k].as_py()


def parallelism(df: DataFrame) -> int:
    """Partitions that keep all cores busy to the end, whatever the number of cells."""
    spark = df.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def dealt(df: DataFrame) -> DataFrame:
    """Rows in turn over all tasks; a given number, so that adaptive plans do not put the few large rows together again."""
    return df.repartition(parallelism(df))


def parts(df: DataFrame, times: int, elements: Column, most: int = MOST_PARTS) -> DataFrame:
    """Each row once for each part of its replicates, with `first` and `end` of the part; elements: array elements of one replicate."""
    if not times:
        return df.withColumn("first", F.lit(0)).withColumn("end", F.lit(0))
    n = F.least(F.lit(min(most, times)), F.greatest(F.lit(1), F.ceil(elements.cast("double") * times / PART_ELEMENTS))).cast("int")
    each = df.withColumn("__n", n).withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    cut = lambda k: F.floor(k * times / F.col("__n")).cast("int")
    return each.withColumn("first", cut(F.col("__k"))).withColumn("end", cut(F.col("__k") + 1)).drop("__n", "__k")


def mapped(df: DataFrame, kernel: Callable[..., dict | list[dict]], inputs: tuple[str, ...], added: str) -> DataFrame:
    """df without those `inputs` that are lists, with the columns `added` (DDL) that the kernel gives for each row: a dict, or a list of dicts for as many rows."""
    heavy = {f.name for f in df.schema if isinstance(f.dataType, ArrayType) and f.name in inputs}
    kept = [f for f in df.schema if f.name not in heavy]
    new = StructType.fromDDL(added)
    schema = StructType(kept + list(new))
    names, fresh = [f.name for f in kept], [f.name for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = {f.name: f.type for f in to_arrow_schema(new)}
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in inputs]
            found, at = [], []
            for k in range(batch.num_rows):
                got = kernel(*(decoded(c, k) for c in columns))
                got = got if isinstance(got, list) else [got]
                found += got
                at += [k] * len(got)
            index = pa.array(at, pa.int64())
            old = [batch.column(batch.schema.get_field_index(c)).take(index) for c in names]
            yield pa.RecordBatch.from_arrays([*old, *(pa.array([g[c] for g in found], types[c]) for c in fresh)], names=[*names, *fresh])

    return df.mapInArrow(run, schema)
