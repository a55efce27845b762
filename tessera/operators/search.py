"""Lexical, vector and hybrid retrieval.

A query is a value, not a table, so every search is one scan with a projection,
a prefilter and a top-k; nothing is shuffled but the k rows of each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import indel_ratio, normalize_text, ratio_bound, token_sort_key
from tessera.functions.vectors import cosine, hash_embedding

CUTOFF = 30.0


def candidates(evidence: DataFrame, facts: DataFrame | None) -> DataFrame:
    """What can be found: non-empty evidence texts, and facts as "predicate: raw value"."""
    texts = evidence.filter("text is not null and text <> ''").select(F.col("evidence_id").alias("source_id"), F.lit("evidence").alias("source"), "document_id", "text")
    if facts is None:
        return texts
    rows = facts.select(F.col("fact_id").alias("source_id"), F.lit("fact").alias("source"), "document_id", F.concat_ws(": ", "predicate", "raw_value").alias("text"))
    return texts.union(rows)


def exact(rows: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Rows whose normalized text equals the query's."""
    return rows.filter(normalize_text(F.col(text)) == normalize_text(F.lit(query))).withColumn("score", F.lit(100.0))


def with_ratio(rows: DataFrame, query: Column, cutoff: float = CUTOFF, text: str = "text") -> DataFrame:
    """Rows with their token-sort ratio to the query, where it reaches the cutoff; lengths alone rule most out."""
    keyed = rows.withColumn("__key", token_sort_key(F.col(text))).withColumn("__query", token_sort_key(query))
    near = keyed.filter(ratio_bound(F.col("__key"), F.col("__query")) >= cutoff)
    return near.withColumn("score", indel_ratio(F.col("__key"), F.col("__query"))).filter(F.col("score") >= cutoff).drop("__key", "__query")


def fuzzy(rows: DataFrame, query: str, k: int = 10, cutoff: float = CUTOFF, text: str = "text", tie: str = "source_id") -> DataFrame:
    """The k rows of highest token-sort ratio; ties by id.

    Equal texts are scored once: the ratio is quadratic in the length.
    """
    distinct = with_ratio(rows.select(text).distinct(), F.lit(query), cutoff, text)
    return rows.join(distinct, text).orderBy(F.desc("score"), tie).limit(k)


def semantic(rows: DataFrame, query: Column, k: int = 10, vector: str = "embedding", tie: str = "source_id") -> DataFrame:
    """The k rows of highest cosine to a query vector; brute force over all rows."""
    return rows.withColumn("score", cosine(F.col(vector), query)).orderBy(F.desc("score"), tie).limit(k)


def query_vector(spark: SparkSession, vector: Column) -> Column:
    """The value of a query's vector as a literal: computed once, not for every row."""
    return F.lit([float(x) for x in spark.range(1).select(vector.alias("v")).first()["v"]])


def embedded(rows: DataFrame, text: str = "text", dimension: int = 384) -> DataFrame:
    """``rows`` with the hash embedding of their text."""
    return rows.withColumn("embedding", hash_embedding(F.col(text), dimension))


def hybrid(rows: DataFrame, query: str, k: int = 10, mode: str = "normalized", dimension: int = 384, nodes: DataFrame | None = None) -> DataFrame:
    """Lexical, semantic and (given nodes) graph hits in one list of k.

    ``mode="raw"`` compares ratios of 0 to 100 with cosines as they are;
    "normalized" puts both on 0 to 1.  Each source is listed once, with its best score.
    """
    raw = mode == "raw"
    columns = ("source_id", "source", "document_id", "text")
    lexical = fuzzy(rows, query, k).select(*columns, (F.col("score") if raw else F.col("score") / 100).alias("score"), F.lit("lexical").alias("by"))
    vectors = semantic(embedded(rows, dimension=dimension), query_vector(rows.sparkSession, hash_embedding(F.lit(query), dimension)), k)
    near = vectors.select(*columns, (F.col("score") if raw else (F.col("score") + 1) / 2).alias("score"), F.lit("semantic").alias("by"))
    hits = lexical.union(near)
    if nodes is not None:
        found = fuzzy(nodes, query, k, 1e-9, "name", "entity_id")
        hits = hits.union(found.select(F.col("entity_id").alias("source_id"), F.lit("graph").alias("source"), F.lit(None).cast("string").alias("document_id"), F.col("name").alias("text"), (F.col("score") if raw else F.col("score") / 100).alias("score"), F.lit("graph").alias("by")))
    best = hits.groupBy("source_id", "source").agg(F.max(F.struct("score", "by")).alias("best"), F.first("document_id").alias("document_id"), F.first("text").alias("text"))
    return best.select("source_id", "source", "document_id", "text", "best.score", "best.by").orderBy(F.desc("score"), "source_id").limit(k)


def discover(hits: DataFrame, limit: int = 15) -> DataFrame:
    """The documents of hits in rank order: (document_id, score), each by its best hit."""
    return hits.filter("document_id is not null").groupBy("document_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "document_id").limit(limit)


def supports(hits: DataFrame, evidence_id: str, k: int = 5) -> DataFrame:
    """(supported): is a piece of evidence among the k best lexical hits?"""
    return hits.orderBy(F.desc("score"), "source_id").limit(k).agg(F.coalesce(F.bool_or(F.col("source_id") == evidence_id), F.lit(False)).alias("supported"))


def name_ratio(a: str, b: str) -> float:
    """``text.token_sort_ratio`` of two short names, without a job."""
    a, b = (" ".join(sorted("".join(c if c.isalnum() else " " for c in x.lower()).split())) for x in (a, b))
    if a == b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[-1]))
    return 200.0 * row[-1] / (len(a) + len(b))


def matching_names(names: tuple[str, ...], target: str, cutoff: float = 60.0) -> list[str]:
    """Those of a dictionary of names that are close to a target.

    They become literals of a filter, so that it reaches the scan, and whole
    tables whose predicate is another are never read.
    """
    return sorted(n for n in names if name_ratio(n, target) >= cutoff)
