"""Sources: files, extraction results, tables of a document world, questions, submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.schema import EXTRACTION, QUESTION, schema

#: Extensions that are read.
EXTENSIONS = ("pdf", "xlsx", "xlsm", "xltx", "xltm")


def exists(spark: SparkSession, path: str) -> bool:
    """Is there anything at a path of any store that Spark reads?"""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path, extension, length, checksum and content of the readable files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return found.select("path", extension.alias("extension"), "length", F.sha2("content", 256).alias("checksum"), "content").filter(F.col("extension").isin(*extensions))


def extraction(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The documents and the failures of an extraction result."""
    raw = spark.read.schema(EXTRACTION).json(path, multiLine=True)
    return raw.select(F.explode("success").alias("d")).select("d.*"), raw.select(F.explode("failures").alias("f")).select("f.*")


def jsonl(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of a document world from JSON lines; empty where there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema(name))
    return spark.read.schema(schema(name)).json(path)


def stored(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table that ``upsert`` keeps under ``root``; empty where there is none."""
    path = f"{root}/{name}"
    return spark.read.schema(schema(name)).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema(name))


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """(key, doc_type) from an index CSV, keyed by id and by file name; an id wins over a name."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8")
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    by_id = raw.select(F.col("doc_id").alias("key"), "doc_type", F.lit(0).alias("rank"))
    by_name = raw.select(F.regexp_extract("filename", r"([^/\\]+)$", 1).alias("key"), "doc_type", F.lit(1).alias("rank"))
    return by_id.union(by_name).filter("key is not null and key <> ''").groupBy("key").agg(F.min_by("doc_type", "rank").alias("doc_type"))


def with_document_type(documents: DataFrame, index: DataFrame) -> DataFrame:
    """``documents`` with the type from the index: by id, else by file name, else as it was."""
    a = index.select(F.col("key").alias("document_id"), F.col("doc_type").alias("by_id"))
    b = index.select(F.col("key").alias("filename"), F.col("doc_type").alias("by_name"))
    return documents.join(a, "document_id", "left").join(b, "filename", "left").withColumn("document_type", F.coalesce("by_id", "by_name", "document_type")).drop("by_id", "by_name").select(*documents.columns)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions from {questions: [...]}, {answers: [...]} or a bare list."""
    both = spark.read.schema(f"questions array<struct<{_struct(QUESTION)}>>, answers array<struct<{_struct(QUESTION)}>>, {QUESTION}").json(path, multiLine=True)
    nested = both.filter("questions is not null or answers is not null").select(F.explode(F.coalesce("questions", "answers")).alias("q")).select("q.*")
    return nested.unionByName(both.filter("questions is null and answers is null and qid is not null").drop("questions", "answers"))


def _struct(ddl: str) -> str:
    return ", ".join(":".join(part.split(" ", 1)) for part in ddl.split(", "))


def submission(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, answer) from a CSV with or without a header; commas, rupee signs and "INR" are dropped."""
    raw = spark.read.csv(path, header=False)
    first = [str(x or "").strip().lower() for x in (raw.first() or [])]
    q = next((first.index(n) for n in ("question_id", "qid") if n in first), 0)
    a = first.index("answer") if "answer" in first else min(1, len(raw.columns) - 1)
    rows = raw.select(F.trim(raw.columns[q]).alias("question_id"), F.trim(F.regexp_replace(raw.columns[a], r",|₹|INR", "")).try_cast("double").alias("answer"))
    heads = "question_id is not null and question_id <> '' and lower(question_id) not in ('question_id', 'qid')"
    return rows.filter(heads)
