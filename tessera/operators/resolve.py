"""Entity resolution: scored candidates, thresholds with a margin, and batch resolve-or-create."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.bind import let
from tessera.functions.facts import stable_hex
from tessera.functions.text import indel_ratio, normalize_text, token_sort_key
from tessera.functions.vectors import cosine, hash_embedding
from tessera.operators.relational import of_type
from tessera.operators.search import fuzzy


@dataclass(frozen=True)
class Config:
    """The weights of the signals, and the thresholds of a score."""

    lexical: float = 0.4
    semantic: float = 0.4
    graph: float = 0.1
    type: float = 0.1
    resolved: float = 0.8
    ambiguous: float = 0.55
    margin: float = 0.1
    dimension: int = 384

    def __post_init__(self) -> None:
        if abs(self.lexical + self.semantic + self.graph + self.type - 1) > 1e-6:
            raise ValueError("weights must sum to 1")


DEFAULT = Config()
#: Parts of the mentions of one type, so that a common type is compared by several tasks.
SALTS = 16
#: Nodes of a graph that a mention's text is close to.
GRAPH_HITS = 5


def scored(pairs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``pairs`` (mention_text, mention_type, name, aliases, entity_type) with a score of 0 to 1.

    An exact name scores 1; only the others pay for similarity.
    """
    names = F.array_distinct(F.array_compact(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))))
    mention = normalize_text(F.col("mention_text"))
    exact = F.exists(names, lambda n: normalize_text(n) == mention)
    lexical = let(token_sort_key(F.col("mention_text")), lambda key: F.array_max(F.transform(names, lambda n: indel_ratio(key, token_sort_key(n)))) / 100)
    semantic = let(hash_embedding(F.col("mention_text"), config.dimension), lambda vector: F.array_max(F.transform(names, lambda n: (cosine(vector, hash_embedding(n, config.dimension)) + 1) / 2)))
    kind = F.when(F.col("mention_type").eqNullSafe(F.col("entity_type")), 1.0).otherwise(0.5)
    graph = F.coalesce(F.col("graph_score"), F.lit(0.0)) if "graph_score" in pairs.columns else F.lit(0.0)
    score = F.lit(config.lexical) * lexical + F.lit(config.semantic) * semantic + F.lit(config.graph) * graph + F.lit(config.type) * kind
    return pairs.withColumn("score", F.when(exact, 1.0).otherwise(score))


def decision(best: Column, second: Column, config: Config = DEFAULT) -> Column:
    """resolved, ambiguous or unresolved from the two highest scores."""
    clear = (best >= config.resolved) & (best - F.coalesce(second, F.lit(0.0)) >= config.margin - 1e-12)
    return F.when(clear, "resolved").when(best >= config.ambiguous, "ambiguous").otherwise("unresolved")


def finalize(candidates: DataFrame, by: list[str], config: Config = DEFAULT, keep: int = 5) -> DataFrame:
    """The best candidates of each group with its status; one where it is resolved, none where it isn't found."""
    window = Window.partitionBy(*by).orderBy(F.desc("score"), "entity_id")
    top = candidates.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= keep)
    top = top.withColumn("second", F.lead("score").over(window))
    first = F.first(F.struct("score", "second")).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    status = decision(first["score"], first["second"], config)
    return top.withColumn("status", status).filter((F.col("status") == "ambiguous") | ((F.col("status") == "resolved") & (F.col("rank") == 1))).drop("second")


def resolve_text(entities: DataFrame, query: str, entity_type: str | None = None, config: Config = DEFAULT, keep: int = 5, nodes: DataFrame | None = None) -> DataFrame:
    """(entity_id, name, score, status) for one mention: the top of one scan, then five rows.

    With ``nodes`` (entity_id, name) of a graph, those among the ``GRAPH_HITS`` closest to the mention bring their closeness as the graph's signal.
    """
    some = of_type(entities, entity_type)
    pairs = some.select("entity_id", "name", "aliases", "entity_type", F.lit(query).alias("mention_text"), F.lit(entity_type).cast("string").alias("mention_type"))
    if nodes is not None:
        # At most GRAPH_HITS rows.
        hits = fuzzy(nodes, query, GRAPH_HITS, 1e-9, "name", "entity_id").groupBy("entity_id").agg((F.max("score") / 100).alias("graph_score"))
        pairs = pairs.join(F.broadcast(hits), "entity_id", "left")
    top = scored(pairs, config).select("entity_id", "name", "score").orderBy(F.desc("score"), "entity_id").limit(keep)
    return finalize(top.withColumn("mention", F.lit(query)), ["mention"], config, keep).select("entity_id", "name", "score", "status")


def resolve_mentions(mentions: DataFrame, entities: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The candidates of every mention (mention_id, mention_text, entity_type), of its type; a blank type fits all.

    Every fitting pair is compared. The semantic part alone may be worth as much as the lexical one, so no shared word or
    n-gram is sure; pairs are left out only where their lexical part can't lift the score to what a status depends on.
    """
    kind = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit("t:"), normalize_text(F.col(c))))
    asked = mentions.select("mention_id", "mention_text", F.col("entity_type").alias("mention_type"))
    # Each fitting pair meets under one key: "all" for a blank mention, else the type or a blank entity.
    block = kind("mention_type")
    asked = asked.withColumn("block", F.explode(F.when(block.isNull(), F.array(F.lit("all"))).otherwise(F.array(block, F.lit("blank")))))
    names = entities.select("entity_id", "name", "aliases", "entity_type")
    names = names.withColumn("block", F.explode(F.array(F.lit("all"), F.coalesce(kind("entity_type"), F.lit("blank")))))
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("mention_id"), F.lit(SALTS)))
    names = names.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    pairs = asked.join(names, ["block", "salt"]).drop("block", "salt")
    needed = (min(config.ambiguous, config.resolved - config.margin) - config.semantic - config.graph - config.type) / config.lexical if config.lexical else 0.0
    every = F.array_compact(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    lexical = let(token_sort_key(F.col("mention_text")), lambda key: F.array_max(F.transform(every, lambda n: indel_ratio(key, token_sort_key(n)))) / 100)
    near = pairs.filter(lexical >= needed - 1e-9)
    return scored(near, config).select("mention_id", "entity_id", "score")


def resolve_or_create(mentions: DataFrame) -> DataFrame:
    """Mentions grouped into entities: one per type and normalized name.

    Equal names are one entity whatever the order of arrival; a stable id makes
    a second run give the same.  Corroborated entities (two mentions or more) are resolved.
    """
    key = F.struct(normalize_text(F.col("entity_type")).alias("block"), normalize_text(F.col("mention_text")).alias("key"))
    grouped = mentions.withColumn("k", key).groupBy("k").agg(
        F.min_by("mention_text", "mention_id").alias("name"),
        F.min_by("entity_type", "mention_id").alias("entity_type"),
        F.sort_array(F.collect_set("mention_text")).alias("aliases"),
        F.sort_array(F.collect_set("mention_id")).alias("mention_ids"),
        F.max("confidence").alias("confidence"),
    )
    status = F.when(F.size("mention_ids") > 1, "resolved").otherwise("unresolved")
    return grouped.select(stable_hex(F.lit("entity"), F.col("k.block"), F.col("k.key")).alias("entity_id"), "entity_type", "name", "aliases", "mention_ids", "confidence", status.alias("status"))
