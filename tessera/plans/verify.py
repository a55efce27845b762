"""Running a plan, checking what it rests on, and answering."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions.facts import coerce_number
from tessera.kg import World
from tessera.plans.compile import Binding, compile_plan
from tessera.plans.ir import PlanError, QueryPlan, parse

#: Operations whose result must name evidence.
EVIDENCE = ("TRAVERSE", "SEARCH_EVIDENCE", "GET_ATTRIBUTE")
CITATIONS = 10


@dataclass
class Step:
    output_var: str
    op_type: str
    status: str
    count: int = 0
    evidence_ids: list[str] = field(default_factory=list)
    note: str = ""


@dataclass
class Answer:
    value: Any
    status: str
    confidence: float
    issues: list[str]
    steps: list[Step]
    evidence: list[str]
    iterations: int = 1
    #: Rows of a list result, of which ``value`` shows a part.
    count: int | None = None


def _observe(op_type: str, var: str, bound: Binding) -> Step:
    """The status of a step, from all its rows, and a bounded few of its evidence ids."""
    df = bound.df
    evidence = F.lit(None).cast("string")
    if "evidence_ids" in df.columns:
        evidence = F.get("evidence_ids", F.lit(0))
    elif "evidence_id" in df.columns:
        evidence = F.col("evidence_id")
    flags = [F.count("*").alias("n")]
    flags.append(F.coalesce(F.bool_or(F.col("status") == "ambiguous"), F.lit(False)).alias("a") if op_type == "RESOLVE_ENTITY" else F.lit(False).alias("a"))
    row = df.agg(*flags).first()
    cited = []
    if bound.kind != "entities" or op_type in EVIDENCE:
        # One id per row suffices to cite; the least few are taken without gathering the set.
        ids = df.select(evidence.alias("e")).filter("e is not null").distinct()
        cited = [r["e"] for r in ids.orderBy("e").limit(CITATIONS).collect()]
    note, status = "; ".join(bound.warnings), "ok" if row["n"] else "empty"
    if row["a"]:
        status = "ambiguous"
    if bound.kind == "scalar":
        value = df.first()
        status = "ok" if value is not None and value["value"] is not None else "empty"
        if op_type == "CHECK_COMPLETENESS" and value is not None and not value["complete"]:
            status, note = "incomplete", str(value.asDict())
    return Step(var, op_type, status, row["n"], cited, note)


def execute(plan: QueryPlan, world: World) -> tuple[dict[str, Binding], list[Step]]:
    """Compile a plan and look at each step that its answer rests on, and at every completeness check."""
    bound = compile_plan(plan, world, everything=True)
    wanted = plan.ancestors() | {op.output_var for op in plan.operations if op.op_type == "CHECK_COMPLETENESS"}
    steps = []
    for op in plan.operations:
        if op.output_var in wanted:
            try:
                steps.append(_observe(op.op_type, op.output_var, bound[op.output_var]))
            except Exception as error:  # a step that fails is reported with the others
                steps.append(Step(op.output_var, op.op_type, "failed", note=str(error).split("\n")[0][:300]))
    return bound, steps


@dataclass(frozen=True)
class Rule:
    """A way in which a step can weaken an answer: when it holds, of a step and whether it is the final one, and what it says."""

    holds: Callable[[Step, bool], bool]
    says: str


#: Every rule is asked of every step; a step can break several.
RULES = (
    Rule(lambda s, final: s.status == "failed", "{op} for {var} stopped: {note}"),
    Rule(lambda s, final: s.status == "ambiguous", "{var}: several entities fit equally well"),
    Rule(lambda s, final: s.status == "incomplete", "{var}: members are missing, {note}"),
    Rule(lambda s, final: s.status == "empty" and not final, "{var}: {op} found nothing to go on"),
    Rule(lambda s, final: s.status == "empty" and final, "nothing was found for the question"),
    Rule(lambda s, final: s.op_type in EVIDENCE and s.status == "ok" and not s.evidence_ids, "{var}: no source backs what {op} found"),
)


def verify(plan: QueryPlan, steps: list[Step]) -> list[str]:
    """The objections to an answer, by the rules, step by step; none if it holds."""
    objections = [rule.says.format(op=s.op_type, var=s.output_var, note=s.note or "no reason given") for s in steps for rule in RULES if rule.holds(s, s.output_var == plan.final)]
    unseen = plan.ancestors().difference(s.output_var for s in steps)
    return objections + [f"{var}: without a result" for var in sorted(unseen)]


def _value(bound: Binding, limit: int) -> Any:
    if bound.kind == "scalar":
        row = bound.df.first()
        return None if row is None else row["value"]
    return [r.asDict() for r in bound.df.limit(limit).collect()]


def answer(plan: QueryPlan, world: World, evidence_limit: int = 30) -> Answer:
    """The verified, unverified or insufficient answer of one plan."""
    bound, steps = execute(plan, world)
    issues = verify(plan, steps)
    failed = any(s.status == "failed" for s in steps if s.output_var == plan.final)
    value = None if failed else _value(bound[plan.final], evidence_limit)
    evidence = sorted({e for s in steps if s.output_var in plan.ancestors() for e in s.evidence_ids})[:CITATIONS]
    count = bound[plan.final].df.count() if isinstance(value, list) else None
    if value in (None, [], {}):
        return Answer(value, "insufficient_evidence", 0.0, issues, steps, evidence, count=count)
    if issues:
        return Answer(value, "unverified", 0.4, issues, steps, evidence, count=count)
    return Answer(value, "verified", 1.0, issues, steps, evidence, count=count)


#: The fields of an answer with several that hold its number.
NUMBERS = ("value", "result", "total")


def answer_number(spark: SparkSession, value: Any, kind: str) -> float | None:
    """The number that an answer of any shape stands for; a list is its length for a count, else its only item."""
    while True:
        match value:
            case bool() | int() | float() | Decimal():
                return float(value)
            case str():
                return spark.range(1).select(coerce_number(F.lit(value)).alias("x")).first()["x"]
            case list() if kind == "count":
                return float(len(value))
            case [value]:
                pass
            case dict():
                value = next((value[k] for k in (*(("count",) if kind == "count" else ()), *NUMBERS) if k in value), None)
            case _:
                return None


#: A planner: from the question, the schema and the issues so far to a plan, or None.
Planner = Callable[[str, dict[str, list[str]], list[str]], dict | str | None]


def static_planner(*plans: dict | str) -> Planner:
    """Given plans, one after the other; the last again."""
    left = list(plans)
    return lambda question, schema, issues: (left.pop(0) if len(left) > 1 else left[0]) if left else None


def ask(question: str, world: World, planner: Planner | None = None, iterations: int = 3, schema: dict[str, list[str]] | None = None, evidence_limit: int = 30) -> Answer:
    """Plan, run, verify; with issues, plan again, a bounded number of times."""
    schema = schema or {}
    issues: list[str] = []
    last: Answer | None = None
    for i in range(1, iterations + 1):
        source = planner(question, schema, issues) if planner else None
        if source is None:
            return last or Answer(None, "insufficient_evidence", 0.0, ["no plan"], [], [], 0)
        try:
            last = answer(parse(source), world, evidence_limit)
        except PlanError as error:
            last = Answer(None, "insufficient_evidence", 0.0, [str(error)], [], [])
        last.iterations = i
        if last.status == "verified":
            break
        issues = last.issues
    return last
