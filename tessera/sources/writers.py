"""Sinks: keyed tables, JSON lines, submissions, and the fingerprint that guards an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.facts import format_answer
from tessera.sources.readers import exists


def latest(rows: DataFrame, key: str | list[str], version: Column) -> DataFrame:
    """One row per key: that of the highest version."""
    keys = [key] if isinstance(key, str) else key
    window = Window.partitionBy(*keys).orderBy(version.desc())
    return rows.withColumn("__n", F.row_number().over(window)).filter("__n = 1").drop("__n")


def upsert(rows: DataFrame, root: str, name: str, key: str) -> None:
    """Replace the stored rows of the same keys and add the others.

    The table has two generations; the one not in use is written, then named in
    a marker, so a job that dies leaves the old table as it was.
    """
    old = keyed(rows.sparkSession, root, name)
    # Of rows with equal keys in one call the choice depends on their content alone, not on where they were computed.
    fresh = latest(rows, key, F.struct(*[F.col(c).cast("string") for c in rows.columns]))
    replace(fresh if old is None else old.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True), root, name)


def replace(rows: DataFrame, root: str, name: str) -> None:
    """Write a new generation of a table, name it in the marker, and remove those before the last."""
    spark = rows.sparkSession
    at = current(spark, root, name)
    merged = rows
    generation = 0 if at is None else int(at.rsplit("-", 1)[1]) + 1
    merged.write.mode("overwrite").parquet(f"{root}/{name}/generation-{generation}")
    spark.createDataFrame([(generation,)], "generation int").coalesce(1).write.mode("overwrite").json(f"{root}/{name}/current")
    # The last one stays for those who read it.
    if generation > 1:
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/generation-{generation - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


def current(spark: SparkSession, root: str, name: str) -> str | None:
    """The folder of a keyed table's present generation."""
    marker = f"{root}/{name}/current"
    if not exists(spark, marker):
        return None
    return f"{root}/{name}/generation-{spark.read.schema('generation int').json(marker).first()[0]}"


def keyed(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    at = current(spark, root, name)
    return spark.read.parquet(at) if at else None


def write_jsonl(rows: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines, in one folder per value of ``by`` where it is given."""
    writer = rows.repartition(F.col(by)).write.partitionBy(by) if by else rows.write
    writer.mode("overwrite").json(path)


def write_submission(answers: DataFrame, path: str) -> None:
    """question_id, answer of (question_id, value, answer_type): one small CSV, unresolved answers as 0."""
    answers.select("question_id", format_answer(F.col("value"), F.col("answer_type")).alias("answer")).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_report(counts: DataFrame, path: str) -> None:
    counts.coalesce(1).write.mode("overwrite").json(path)


def fingerprint(files: DataFrame) -> DataFrame:
    """One digest of a set of (path, checksum), whatever their order: what an index was built from."""
    return files.select(F.sha2(F.concat_ws(":", "path", F.coalesce("checksum", F.lit("<missing>"))).cast("binary"), 256).alias("h")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "").cast("binary"), 256).alias("fingerprint"))
