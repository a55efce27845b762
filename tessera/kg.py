"""A document world over the relational tables: entities, edges, attributes, facts.

Ids are "<type>:<key>".  All views are lazy projections; a plan that touches one
type reads one table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = "decimal(38,6)"


@dataclass(frozen=True)
class World:
    """The tables that plans run over."""

    entities: DataFrame
    relationships: DataFrame
    attributes: DataFrame
    evidence: DataFrame
    facts: DataFrame | None = None
    mentions: DataFrame | None = None
    vectors: DataFrame | None = None
    #: The names of all predicates, where they are known; else they are looked up.
    edge_names: tuple[str, ...] | None = None
    attribute_names: tuple[str, ...] | None = None

    def names(self, table: str) -> tuple[str, ...]:
        """The distinct predicates of a table: a dictionary, whatever the table's size."""
        known = {"relationships": self.edge_names, "attributes": self.attribute_names}.get(table)
        if known is not None:
            return known
        rows = getattr(self, table)
        return () if rows is None else tuple(sorted(r["predicate"] for r in rows.select("predicate").distinct().collect() if r["predicate"] is not None))


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


#: (table, type, key, name, predicates of numeric attributes, predicates of dates, of texts)
TYPES = (
    ("region", "region", "r_regionkey", "r_name", {}, {}, {}),
    ("nation", "nation", "n_nationkey", "n_name", {}, {}, {}),
    ("customer", "customer", "c_custkey", "c_name", {"account_balance": "c_acctbal"}, {}, {"segment": "c_mktsegment"}),
    ("supplier", "supplier", "s_suppkey", "s_name", {"account_balance": "s_acctbal"}, {}, {}),
    ("part", "part", "p_partkey", "p_name", {"retail_price": "p_retailprice", "size": "p_size"}, {}, {"brand": "p_brand"}),
    ("orders", "order", "o_orderkey", None, {"total_price": "o_totalprice"}, {"order_date": "o_orderdate"}, {"priority": "o_orderpriority", "order_status": "o_orderstatus"}),
)
#: (table, predicate, subject, object), each as (type, key)
EDGES = (
    ("orders", "placed_by", ("order", "o_orderkey"), ("customer", "o_custkey")),
    ("customer", "located_in", ("customer", "c_custkey"), ("nation", "c_nationkey")),
    ("supplier", "located_in", ("supplier", "s_suppkey"), ("nation", "s_nationkey")),
    ("nation", "part_of", ("nation", "n_nationkey"), ("region", "n_regionkey")),
    ("lineitem", "contains", ("order", "l_orderkey"), ("part", "l_partkey")),
    ("lineitem", "supplied_by", ("order", "l_orderkey"), ("supplier", "l_suppkey")),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def world(spark: SparkSession, sf_dir: str, types: tuple[str, ...] | None = None) -> World:
    """The world of the tables under ``sf_dir``, of some types only where given."""
    chosen = [t for t in TYPES if types is None or t[1] in types]
    entities, attributes = [], []
    for name, kind, key, label, numbers, dates, texts in chosen:
        rows = table(spark, sf_dir, name)
        title = F.col(label) if label else F.concat(F.lit(f"{kind} "), F.col(key).cast("string"))
        entities.append(rows.select(_id(kind, key).alias("entity_id"), F.lit(kind).alias("entity_type"), title.alias("name"), F.array(title).alias("aliases"), F.array(_id(kind, key)).alias("mention_ids"), F.lit(1.0).alias("confidence"), F.lit("resolved").alias("status")))
        of = lambda predicate, value, number, day: (_id(kind, key).alias("entity_id"), F.lit(predicate).alias("predicate"), value.cast("string").alias("value"), number.cast(NUMBER).alias("value_number"), day.cast("date").alias("value_date"), F.concat(F.lit("ev:"), _id(kind, key)).alias("evidence_id"))  # noqa: E731, B023
        null = F.lit(None)
        attributes += [rows.select(*of(p, F.col(c), F.col(c), null)) for p, c in numbers.items()]
        attributes += [rows.select(*of(p, F.col(c).cast("date"), null, F.col(c))) for p, c in dates.items()]
        attributes += [rows.select(*of(p, F.col(c), null, null)) for p, c in texts.items()]
    kinds = {t[1] for t in chosen}
    edges = []
    for name, predicate, (a, ka), (b, kb) in EDGES:
        if a in kinds and b in kinds:
            edges.append(table(spark, sf_dir, name).select(_id(a, ka).alias("subject_id"), F.lit(predicate).alias("predicate"), _id(b, kb).alias("object_id"), F.concat(F.lit("ev:"), _id(a, ka)).alias("evidence_id")))
    empty = lambda ddl: spark.createDataFrame([], ddl)
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("ev:document:"), F.col("doc_id").cast("string")).alias("evidence_id"), F.concat(F.lit("document:"), F.col("doc_id").cast("string")).alias("document_id"), "text")
    vectors = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("vector:"), F.col("vec_id").cast("string")).alias("evidence_id"), "embedding")
    return World(
        entities=_union(entities),
        relationships=_union(edges) if edges else empty("subject_id string, predicate string, object_id string, evidence_id string"),
        attributes=_union(attributes) if attributes else empty(f"entity_id string, predicate string, value string, value_number {NUMBER}, value_date date, evidence_id string"),
        evidence=docs,
        vectors=vectors,
        edge_names=tuple(sorted({e[1] for e in EDGES if e[2][0] in kinds and e[3][0] in kinds})),
        attribute_names=tuple(sorted({p for t in chosen for part in t[4:] for p in part})),
    )
