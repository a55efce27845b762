"""A stored vector index: texts are embedded once and kept beside the digest of their text.

An embedder is any function from a text column to an array of doubles, so a model
behind a Pandas or Arrow function fits as well as the hash embedding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import hash_embedding
from tessera.operators.search import query_vector, semantic
from tessera.sources import writers

Embedder = Callable[[Column], Column]
NAME = "vectors"


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def refresh(rows: DataFrame, root: str, embed: Embedder = hash_embedding) -> int:
    """Bring the index under ``root`` up to ``rows`` (source_id, source, document_id, text); the number of texts embedded.

    Only texts that the index doesn't hold under their id are embedded; those that are gone leave it.
    """
    spark = rows.sparkSession
    wanted = rows.select("source_id", "source", "document_id", "text", digest(F.col("text")).alias("digest"))
    old = writers.keyed(spark, root, NAME)
    fresh = wanted if old is None else wanted.join(old.select("source_id", "digest"), ["source_id", "digest"], "left_anti")
    gone = None if old is None else old.join(wanted.select("source_id", "digest"), ["source_id", "digest"], "left_anti")
    new = fresh.count()
    if old is not None and not new and not gone.limit(1).count():
        return 0
    made = fresh.withColumn("embedding", embed(F.col("text")))
    kept = None if old is None else old.join(wanted.select("source_id", "digest"), ["source_id", "digest"], "left_semi")
    writers.replace(made if kept is None else kept.unionByName(made), root, NAME)
    return new


def stored(spark: SparkSession, root: str | None) -> DataFrame | None:
    """The index under a folder, or None."""
    return writers.keyed(spark, root, NAME) if root else None


def nearest(index: DataFrame, query: str, k: int = 10, embed: Embedder = hash_embedding) -> DataFrame:
    """The k rows of an index that are nearest to a query; only the query is embedded."""
    return semantic(index, query_vector(index.sparkSession, embed(F.lit(query))), k)
