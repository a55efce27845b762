"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of one Arrow batch on its way to a Python worker: rows may be of any length.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches end at so many bytes, not only at a number of rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only in local mode, and where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A written table ends the lineage, so a lost executor never forces the work
    behind it to run again, and several consumers read one result.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Remove the files behind a table that ``cut`` wrote and nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def trim_memory() -> None:
    """Give back what a worker has freed: workers outlive their tasks, and an executor's memory holds them all."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def fold_crc(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id falls in no fold."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")) if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def join_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Left join of ``rows`` (a written table) with one row per ``key`` of ``groups``.

    ``groups`` is written first.  Both sides of the join are then plain
    exchanges, so that where it isn't a broadcast, adaptive execution can split
    the partition of a hot key; an aggregate right below the join would forbid it.
    """
    return rows.join(cut(groups, "groups"), key, "left")
