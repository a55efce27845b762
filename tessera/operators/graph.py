"""Property graph operators over (subject_id, predicate, object_id) edges.

Traversals are rounds of joins.  Each round's frontier is cut off from its
lineage, so a lost executor repeats one round at most.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.facts import stable_hex
from tessera.functions.text import normalize_text
from tessera.sources.scratch import cut


def entity_nodes(rows: DataFrame) -> DataFrame:
    """``rows`` (entity_type, name) with a stable id."""
    return rows.withColumn("entity_id", stable_hex(F.lit("entity"), F.col("entity_type"), F.col("name"))).dropDuplicates(["entity_id"])


def edge_ids(edges: DataFrame) -> DataFrame:
    return edges.withColumn("relationship_id", stable_hex(F.col("subject_id"), F.col("object_id"), F.col("predicate"), F.col("evidence_id")))


def coarse_edges(facts: DataFrame) -> DataFrame:
    """What facts say without any resolution: document to value, and subject, where there is one, to value."""
    value = F.coalesce("normalized_value", "raw_value")
    rows = [facts.select(F.concat(F.lit("document:"), "document_id").alias("subject_id"), "predicate", F.concat(F.lit("value:"), value).alias("object_id"), "evidence_id"), facts.filter("subject_mention is not null").select(F.concat(F.lit("mention:"), normalize_text(F.col("subject_mention"))).alias("subject_id"), "predicate", F.concat(F.lit("value:"), value).alias("object_id"), "evidence_id")]
    return rows[0].union(rows[1]).dropDuplicates(["subject_id", "predicate", "object_id", "evidence_id"])


#: Evidence ids that a neighbour shows; ``hop_edges`` has all of them.
SHOWN = 10


def hop_edges(edges: DataFrame, start: DataFrame, direction: str = "out", predicates: list[str] | None = None) -> DataFrame:
    """Every edge that leads from ``start`` (entity_id) to a neighbour: from_id, entity_id, and the edge's other columns.

    An edge is oriented by the side that matched; inside the set it counts both ways.
    """
    if direction not in ("in", "out", "both"):
        raise ValueError(f"direction is in, out or both, not {direction}")
    if predicates is not None:
        edges = edges.filter(F.col("predicate").isin(*predicates) if predicates else F.lit(False))
    sides = [(a, b) for a, b, d in (("subject_id", "object_id", "out"), ("object_id", "subject_id", "in")) if direction in (d, "both")]
    ids = start.select("entity_id").distinct()
    more = [c for c in edges.columns if c not in ("subject_id", "object_id")]
    hops = [edges.join(ids.withColumnRenamed("entity_id", a), a, "left_semi").select(F.col(a).alias("from_id"), F.col(b).alias("entity_id"), *more) for a, b in sides]
    return hops[0] if len(hops) == 1 else hops[0].union(hops[1])


def one_hop(edges: DataFrame, start: DataFrame, direction: str = "out", predicates: list[str] | None = None) -> DataFrame:
    """(entity_id, evidence_ids) of the neighbours of ``start`` (entity_id): each with the ``SHOWN`` least of its evidence ids.

    The window keeps that many rows of a neighbour in each task before anything is shuffled, so a hub is never gathered.
    """
    hops = hop_edges(edges, start, direction, predicates).select("entity_id", "evidence_id").distinct()
    least = hops.withColumn("n", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.asc_nulls_last("evidence_id")))).filter(F.col("n") <= SHOWN)
    return least.groupBy("entity_id").agg(F.sort_array(F.collect_list("evidence_id")).alias("evidence_ids"))


def k_hop(edges: DataFrame, start: DataFrame, hops: int = 2) -> DataFrame:
    """(entity_id, depth) of all nodes within some hops along the edges, the start included."""
    step = edges.select("subject_id", "object_id").distinct()
    seen = start.select("entity_id").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for depth in range(1, hops + 1):
        reached = frontier.join(step, frontier["entity_id"] == step["subject_id"]).select(F.col("object_id").alias("entity_id")).distinct()
        frontier = cut(reached.join(seen, "entity_id", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        seen = seen.union(frontier)
    return seen


def shortest_path(edges: DataFrame, start: str, end: str, most: int | None = None) -> DataFrame:
    """(path, length) of a shortest directed path, the smallest of equals; no row where there is none.

    Each round keeps one path per node, so it grows with the nodes, not with the paths.
    It ends when no new node is found, or after ``most`` edges where that is given.
    """
    spark = edges.sparkSession
    step = edges.select("subject_id", "object_id").distinct()
    front = spark.createDataFrame([(start, [start])], "node string, path array<string>")
    seen = front.select("node")
    for _ in itertools.count() if most is None else range(most + 1):
        hit = front.filter(F.col("node") == end)
        if hit.limit(1).count():
            return hit.select("path", (F.size("path") - 1).alias("length"))
        found = front.join(step, F.col("node") == F.col("subject_id")).groupBy("object_id").agg(F.min(F.concat("path", F.array("object_id"))).alias("path"))
        front = cut(found.select(F.col("object_id").alias("node"), "path").join(seen, "node", "left_anti"), "front")
        if not front.limit(1).count():
            break
        # Written again, or its plan would grow with every round.
        seen = cut(seen.union(front.select("node")), "seen")
    return spark.createDataFrame([], "path array<string>, length int")


def counts(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges."""
    return entities.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))
