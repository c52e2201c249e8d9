"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that a checked broadcast may hold: 8 bytes each, so about 32 MB in a hash relation.
BROADCAST_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, on one machine alone, a folder of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tandemetry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop_staged(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path:
            jvm = df.sparkSession._jvm
            hpath = jvm.org.apache.hadoop.fs.Path(path)
            hpath.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(hpath, True)


def by_ids(df: DataFrame, ids: DataFrame, column: str, how: str, n_ids: int | None = None, null_safe: bool = False) -> DataFrame:
    """Semi or anti join on one id column.  The ids are broadcast only while a count proves them few; beyond that both sides shuffle."""
    n = ids.count() if n_ids is None else n_ids
    few = n <= BROADCAST_IDS
    if null_safe:
        ids = ids.select(F.col(column).alias(f"__{column}"))
    return df.join(F.broadcast(ids) if few else ids.hint("merge"), F.col(column).eqNullSafe(F.col(f"__{column}")) if null_safe else column, how)


def shards(spark: SparkSession) -> int:
    """Shuffle partitions of the session, as a salt count for hot groups."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def tidied(function):
    """A mapInArrow function that returns its worker's free memory to the system when a task ends; workers outlive stages."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
            if trim:
                trim(0)

    return run
