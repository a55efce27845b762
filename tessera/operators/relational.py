"""The relational opcodes of a plan as DataFrame transformations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import normalize_text
from tessera.kg import World
from tessera.operators import graph, search
from tessera.sources.scratch import cut

NUMBER = "decimal(38,6)"
ROW = ("entity_id", "predicate", "value", "value_number", "value_date", "evidence_ids", "source")
#: Fields of an entity, for filters.
ENTITY_FIELDS = ("entity_type", "name", "confidence", "status")


def of_type(entities: DataFrame, entity_type: str | None) -> DataFrame:
    """Entities of a type, compared as normalized text; all for none.  A literal on both sides folds to a pushed filter."""
    return entities if not entity_type else entities.filter(normalize_text(F.col("entity_type")) == normalize_text(F.lit(entity_type)))


def enumerate_population(world: World, entity_type: str | None, predicate: str | None = None, anchors: DataFrame | None = None, direction: str = "in") -> DataFrame:
    """Distinct entities of a type, those connected to any anchor where anchors are given.

    Without anchors the predicate is not used.  Anchors that are empty give nothing.
    """
    found = of_type(world.entities, entity_type).select("entity_id").dropDuplicates(["entity_id"])
    if anchors is None:
        return found
    names = near_names(world, "relationships", predicate)
    near = graph.one_hop(world.relationships, anchors, direction, names)
    return found.join(near.select("entity_id"), "entity_id", "left_semi")


def near_names(world: World, table: str, predicate: str | None) -> list[str] | None:
    """The predicates of a table that are close to a name; none for no name: all match."""
    return search.matching_names(world.names(table), predicate) if predicate else None


def get_attribute(world: World, entities: DataFrame, predicate: str, subject_scoped: bool = False) -> DataFrame:
    """Values of a predicate for entities: of documents' facts where there are any, else of attributes.

    A fact belongs to every entity mentioned in its document; scoped, only to
    entities whose mention is the fact's subject.
    """
    ids = entities.select("entity_id").distinct()
    wanted = lambda table: F.col("predicate").isin(*names) if (names := near_names(world, table, predicate)) else F.lit(names is None)
    rows = world.attributes.filter(wanted("attributes")).select("entity_id", "predicate", "value", "value_number", "value_date", F.array("evidence_id").alias("evidence_ids"), F.lit("attributes").alias("source"))
    if world.facts is None or world.mentions is None:
        return rows.join(ids, "entity_id", "left_semi")
    facts = world.facts.filter("validation_status = 'valid'").filter(wanted("facts"))
    mentions = world.mentions.select("entity_id", "document_id", *(["mention_text"] if subject_scoped else [])).distinct()
    if subject_scoped:
        facts = facts.withColumn("__subject", normalize_text(F.col("subject_mention")))
        keys = facts.join(mentions.withColumn("__subject", normalize_text(F.col("mention_text"))), ["document_id", "__subject"])
    else:
        keys = facts.join(mentions, "document_id")
    found = keys.select("entity_id", "predicate", F.coalesce(F.col("value_number").cast("string"), F.col("value_date").cast("string"), F.col("raw_value")).alias("value"), "value_number", "value_date", F.array("evidence_id").alias("evidence_ids"), F.lit("facts").alias("source")).dropDuplicates(["entity_id", "predicate", "value", "evidence_ids"])
    # The facts-first choice is made before the entities are picked, so these appear in the plan once.
    both = found.union(rows.join(found.select("entity_id").distinct(), "entity_id", "left_anti"))
    return both.join(ids, "entity_id", "left_semi")


def comparison(left: Column, left_number: Column, left_date: Column, op: str, value: object) -> Column:
    """A field against a value: eq and neq as they are, null-safe; orders as numbers, or dates where the value is one."""
    literal = F.lit(value)
    if op in ("eq", "neq"):
        same = left_number.eqNullSafe(literal.cast(NUMBER)) if isinstance(value, (int, float)) and not isinstance(value, bool) else left.eqNullSafe(literal.cast("string"))
        return same if op == "eq" else ~same
    if op == "contains":
        return F.coalesce(F.lower(left), F.lit("")).contains(F.lower(literal.cast("string")))
    if op == "in":
        if not isinstance(value, (list, tuple, set)):
            raise ValueError("in takes a list")
        texts, numbers = [v for v in value if isinstance(v, str)], [v for v in value if not isinstance(v, str)]
        return F.coalesce(left.isin(*texts) if texts else F.lit(False), F.lit(False)) | F.coalesce(left_number.isin(*[F.lit(n).cast(NUMBER) for n in numbers]) if numbers else F.lit(False), F.lit(False))
    compare = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}.get(op)
    if compare is None:
        raise ValueError(f"no comparison {op}")
    number, day = literal.cast("string").try_cast(NUMBER), literal.cast("string").try_cast("date")
    return F.coalesce(F.when(number.isNotNull(), compare(left_number, number)).when(day.isNotNull(), compare(left_date, day)), F.lit(False))


def filter_rows(world: World, rows: DataFrame, field: str, op: str, value: object) -> DataFrame:
    """Rows whose field passes; a field of the entity is looked up, others are of the row ("value" of attribute rows)."""
    null = F.lit(None)
    if field in ENTITY_FIELDS and field not in rows.columns:
        looked = world.entities.select("entity_id", F.col(field).alias("__field"))
        joined = rows.join(looked, "entity_id", "left")
        text = F.col("__field").cast("string")
        return joined.filter(comparison(text, text.try_cast(NUMBER), text.try_cast("date"), op, value)).drop("__field")
    if field == "value":
        return rows.filter(comparison(F.col("value"), F.col("value_number"), F.col("value_date"), op, value))
    text = F.col(field).cast("string") if field in rows.columns else null.cast("string")
    return rows.filter(comparison(text, text.try_cast(NUMBER), text.try_cast("date"), op, value))


def difference(left: DataFrame, right: DataFrame, key: str = "entity_id") -> DataFrame:
    """Rows of ``left`` whose key isn't in ``right``, duplicates kept; a null key equals a null key."""
    other = right.select(F.col(key).alias("__key")).distinct()
    return left.join(other, left[key].eqNullSafe(other["__key"]), "left_anti")


def _x(column: str) -> Column:
    return F.col(column)


#: Aggregates of a numeric column: nulls are dropped; what an empty input gives.
AGGREGATES = {
    "sum": lambda x: F.coalesce(F.sum(x), F.lit(0).cast(NUMBER)).cast("double"),
    "avg": lambda x: F.coalesce(F.avg(x).cast("double"), F.lit(0.0)),
    "min": lambda x: F.min(x).cast("double"),
    "max": lambda x: F.max(x).cast("double"),
    "count": lambda x: F.count(x).cast("double"),
    "count_distinct": lambda x: F.count_distinct(x).cast("double"),
    "median": lambda x: F.median(x).cast("double"),
}
AGGREGATES |= {"average": AGGREGATES["avg"], "mean": AGGREGATES["avg"]}


def aggregate(rows: DataFrame, function: str, kind: str = "rows", parity: bool = False) -> DataFrame:
    """One row (value).  Counting anything but attribute rows counts it, unless parity asks for numbers only."""
    if function not in AGGREGATES:
        raise ValueError(f"no aggregate {function}")
    if kind != "rows" and function in ("count", "count_distinct") and not parity:
        key = "document_id" if kind == "documents" else "evidence_id" if kind == "evidence" else "entity_id"
        return rows.agg((F.count("*") if function == "count" else F.count_distinct(key)).cast("double").alias("value"))
    if function == "count_distinct":
        return rows.agg(F.count_distinct("value").cast("double").alias("value"))
    column = _x("value_number") if "value_number" in rows.columns else F.lit(None).cast(NUMBER)
    return rows.agg(AGGREGATES[function](column).alias("value"))


def ranked(rows: DataFrame, k: int | None = None) -> DataFrame:
    """Rows by descending number with their place from 0; nulls aside.

    With k only the first k: each task keeps k rows.  Without, rows are dealt by
    ranges of the order, and each range is numbered on its own after a count of those before it.
    """
    from pyspark.sql import Window

    order = (F.desc("value_number"), F.asc("entity_id"))
    some = rows.filter("value_number is not null")
    if k is not None:
        return some.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)
    dealt = cut(some.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    # One row for each range.
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))).drop("__n")
    numbered = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1)
    return numbered.join(F.broadcast(before), "__range").withColumn("rank", F.col("rank") + F.coalesce("__before", F.lit(0))).drop("__range", "__before")


def compute(operation: str, values: list[Column]) -> Column:
    """An operation on scalars in order; the first two for difference, ratio and percentage difference."""
    if operation in ("diff", "difference", "ratio", "pct_diff", "percentage_difference") and len(values) < 2:
        return F.lit(None).cast("double")
    if operation in ("diff", "difference"):
        return values[0] - values[1]
    if operation == "ratio":
        return F.try_divide(values[0], values[1])
    if operation in ("pct_diff", "percentage_difference"):
        return F.try_divide(values[0] - values[1], values[1]) * 100
    folded = F.filter(F.array(*values), lambda v: v.isNotNull())
    rules = {"sum": F.aggregate(folded, F.lit(0.0), lambda s, x: s + x), "min": F.array_min(folded), "max": F.array_max(folded), "count": F.size(folded).cast("double")}
    rules["avg"] = rules["average"] = rules["mean"] = F.coalesce(F.try_divide(rules["sum"], rules["count"]), F.lit(0.0))
    if operation not in rules:
        raise ValueError(f"no operation {operation}")
    return rules[operation]


def days_between(left: DataFrame, right: DataFrame) -> DataFrame:
    """(entity_id, days) between two date attributes of each entity."""
    a = left.groupBy("entity_id").agg(F.max("value_date").alias("a"))
    b = right.groupBy("entity_id").agg(F.max("value_date").alias("b"))
    return a.join(b, "entity_id").select("entity_id", F.date_diff("a", "b").cast("long").alias("days"))


def completeness(world: World, entity_type: str, expected_min: int | None = None, candidate_documents: DataFrame | None = None) -> DataFrame:
    """One row: count, unresolved, ambiguous, missing documents, complete."""
    some = of_type(world.entities, entity_type)
    counted = some.agg(F.count("*").alias("count"), F.count_if(F.col("status") == "unresolved").alias("unresolved_count"), F.count_if(F.col("status") == "ambiguous").alias("ambiguous_count"))
    if candidate_documents is None:
        counted = counted.withColumn("missing_count", F.lit(0).cast("long"))
    else:
        covered = world.mentions.join(some.select("entity_id"), "entity_id", "left_semi").select("document_id").distinct()
        missing = candidate_documents.select("document_id").join(covered, "document_id", "left_anti")
        counted = counted.crossJoin(missing.agg(F.count("*").alias("missing_count")))
    return counted.withColumn("complete", (F.col("unresolved_count") == 0) & (F.col("ambiguous_count") == 0) & (F.col("missing_count") == 0) & (F.col("count") >= (expected_min or 0)))


def coverage(world: World, documents: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """One row of counts over the world's tables, the documents that have facts or mentions, and the vectors of a stored index."""
    out = documents.agg(F.count("*").alias("documents"))
    for name in ("evidence", "facts", "entities", "relationships", "attributes", "mentions"):
        rows = getattr(world, name)
        out = out.withColumn(name, F.lit(0).cast("long")) if rows is None else out.crossJoin(rows.agg(F.count("*").alias(name)))  # one row each
    covered = [rows.select("document_id") for rows in (world.facts, world.mentions) if rows is not None]
    out = out.crossJoin(reduce(DataFrame.union, covered).agg(F.count_distinct("document_id").alias("documents_covered"))) if covered else out.withColumn("documents_covered", F.lit(0).cast("long"))
    return out.withColumn("vectors", F.lit(0).cast("long")) if index is None else out.crossJoin(index.agg(F.count("*").alias("vectors")))


def provenance(world: World, entity_id: str | None = None, relationship_id: str | None = None, evidence_id: str | None = None, fact_id: str | None = None) -> DataFrame:
    """(via, via_id, evidence_id, document_id, text): what an entity, a relationship, a fact or a piece of evidence rests on.

    An entity rests on its mentions, its attributes and its edges; ``via`` names which.
    """
    if sum(x is not None for x in (entity_id, relationship_id, evidence_id, fact_id)) != 1:
        raise ValueError("provenance is of one entity, relationship, evidence or fact")
    via = lambda rows, kind, key: rows.select(F.lit(kind).alias("via"), (F.col(key) if key in rows.columns else F.lit(None)).cast("string").alias("via_id"), "evidence_id")
    edges = world.relationships
    if entity_id is not None:
        parts = [via(world.attributes.filter(F.col("entity_id") == entity_id), "attribute", "attribute_id"), via(edges.filter((F.col("subject_id") == entity_id) | (F.col("object_id") == entity_id)), "relationship", "relationship_id")]
        if world.mentions is not None and "evidence_id" in world.mentions.columns:
            parts.append(via(world.mentions.filter(F.col("entity_id") == entity_id), "mention", "mention_id"))
        found = reduce(DataFrame.union, parts)
    elif relationship_id is not None:
        found = via(edges.filter(F.col("relationship_id") == relationship_id), "relationship", "relationship_id")
    elif fact_id is not None:
        found = via(world.facts.filter(F.col("fact_id") == fact_id), "fact", "fact_id")
    else:
        found = via(world.evidence.filter(F.col("evidence_id") == evidence_id), "evidence", "evidence_id")
    text = F.col("text") if "raw_value" not in world.evidence.columns else F.coalesce(F.nullif("text", F.lit("")), "raw_value")
    return found.distinct().join(world.evidence.select("evidence_id", "document_id", text.alias("text")), "evidence_id", "left").select("via", "via_id", "evidence_id", "document_id", "text")
