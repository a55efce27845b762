"""From a plan to one lazy DataFrame per result.

Operations that the final result doesn't rest on are never compiled.  Only
names are looked up while compiling (the few candidates of an entity, the
predicates close to a name); these become literals.  All else runs with the final
DataFrame, as one plan that Catalyst sees whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.kg import World
from tessera.operators import graph, relational, resolve, search
from tessera.plans.ir import Operation, PlanError, QueryPlan, kinds


@dataclass(frozen=True)
class Binding:
    kind: str
    df: DataFrame
    warnings: tuple[str, ...] = ()


#: The key of each kind of result.
KEY = {"entities": "entity_id", "rows": "entity_id", "evidence": "evidence_id", "documents": "document_id"}


def compile_plan(plan: QueryPlan, world: World, everything: bool = False, parity: bool = False) -> dict[str, Binding]:
    """The results a plan's final one rests on, by name; all of them if asked."""
    kinds(plan)
    wanted = {op.output_var for op in plan.operations} if everything else plan.ancestors()
    bound: dict[str, Binding] = {}
    for op in plan.operations:
        if op.output_var in wanted:
            bound[op.output_var] = _compile(op, bound, world, parity)
    return bound


def final(plan: QueryPlan, world: World, parity: bool = False) -> DataFrame:
    return compile_plan(plan, world, parity=parity)[plan.final].df


def _number(binding: Binding) -> DataFrame:
    """One row (value) of a scalar; the sum of attribute rows."""
    return binding.df.select("value") if binding.kind == "scalar" else relational.aggregate(binding.df, "sum")


def _compile(op: Operation, bound: dict[str, Binding], world: World, parity: bool) -> Binding:
    p: dict[str, Any] = op.params
    get = lambda name: bound[str(p[name]).lstrip("$")]
    match op.op_type:
        case "RESOLVE_ENTITY":
            # At most five rows: as values they don't repeat the scoring wherever the result is used.
            found = resolve.resolve_text(world.entities, p["query"], p.get("entity_type"))
            return Binding("entities", world.entities.sparkSession.createDataFrame(found.collect(), found.schema))
        case "SEARCH_EVIDENCE":
            rows = search.candidates(world.evidence, world.facts)
            return Binding("evidence", search.hybrid(rows, p["query"], p.get("limit", 10)).withColumnRenamed("source_id", "evidence_id"))
        case "DISCOVER":
            limit = p.get("limit", 15)
            rows = search.candidates(world.evidence, world.facts)
            return Binding("documents", search.discover(search.hybrid(rows, p["query"], max(4 * limit, 40)), limit))
        case "TRAVERSE":
            names = relational.near_names(world, "relationships", p.get("predicate"))
            return Binding("entities", graph.one_hop(world.relationships, get("input_var").df, p.get("direction", "out"), names))
        case "ENUMERATE":
            anchors = get("anchor_var").df if p.get("anchor_var") else None
            warn = ("predicate is not used without an anchor",) if p.get("predicate") and anchors is None else ()
            return Binding("entities", relational.enumerate_population(world, p.get("entity_type"), p.get("predicate"), anchors, p.get("direction", "in")), warn)
        case "GET_ATTRIBUTE":
            return Binding("rows", relational.get_attribute(world, get("input_var").df, p["predicate"]))
        case "FILTER":
            source = get("input_var")
            return Binding(source.kind, relational.filter_rows(world, source.df, p["field"], p["op"], p.get("value")))
        case "DIFFERENCE":
            source, other = get("input_var"), get("exclude_var")
            key = KEY.get(source.kind)
            if key is None or key not in other.df.columns:
                raise PlanError(f"{op.output_var}: {source.kind} and {other.kind} have no key in common")
            return Binding(source.kind, relational.difference(source.df, other.df, key))
        case "AGGREGATE":
            source = get("input_var")
            return Binding("scalar", relational.aggregate(source.df, p["function"], source.kind, parity))
        case "COMPARE":
            left, right = _number(get("left_var")), _number(get("right_var"))
            pair = left.select(F.col("value").cast("double").alias("a")).crossJoin(right.select(F.col("value").cast("double").alias("b")))  # one row each
            ops = {"eq": F.col("a") == F.col("b"), "neq": F.col("a") != F.col("b"), "gt": F.col("a") > F.col("b"), "gte": F.col("a") >= F.col("b"), "lt": F.col("a") < F.col("b"), "lte": F.col("a") <= F.col("b")}
            if p["op"] not in ops:
                raise PlanError(f"{op.output_var}: numbers can't be compared by {p['op']}")
            return Binding("scalar", pair.select(ops[p["op"]].alias("value")))
        case "COMPUTE":
            frames = [_number(bound[str(v).lstrip("$")]).select(F.col("value").cast("double").alias(f"v{i}")) for i, v in enumerate(p["input_vars"])]
            joined = frames[0]
            for frame in frames[1:]:
                joined = joined.crossJoin(frame)  # one row each
            return Binding("scalar", joined.select(relational.compute(p["operation"], [F.col(f"v{i}") for i in range(len(frames))]).alias("value")))
        case "CHECK_COMPLETENESS":
            found = None
            if p.get("anchor_query"):
                found = search.discover(search.hybrid(search.candidates(world.evidence, world.facts), p["anchor_query"], 200), 50)
            return Binding("scalar", relational.completeness(world, p["entity_type"], p.get("expected_min"), found).withColumn("value", F.col("complete").cast("double")))
        case "RETURN":
            return get("input_var")
    raise PlanError(f"no operation {op.op_type}")
