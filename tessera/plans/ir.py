"""The plan: a list of operations over named results."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

#: Operations, with the parameters each needs, those it may have, and the kind of its result ("input": that of its input).
OPCODES: dict[str, tuple[tuple[str, ...], tuple[str, ...], str]] = {
    "DISCOVER": (("query",), ("limit", "batch_size"), "documents"),
    "RESOLVE_ENTITY": (("query",), ("entity_type",), "entities"),
    "SEARCH_EVIDENCE": (("query",), ("limit",), "evidence"),
    "TRAVERSE": (("input_var",), ("predicate", "direction"), "entities"),
    "ENUMERATE": ((), ("entity_type", "predicate", "anchor_var", "direction"), "entities"),
    "GET_ATTRIBUTE": (("input_var", "predicate"), (), "rows"),
    "FILTER": (("input_var", "field", "op", "value"), (), "input"),
    "DIFFERENCE": (("input_var", "exclude_var"), (), "input"),
    "AGGREGATE": (("input_var", "function"), ("by",), "scalar"),
    "COMPARE": (("left_var", "right_var", "op"), (), "scalar"),
    "COMPUTE": (("operation", "input_vars"), (), "scalar"),
    "CHECK_COMPLETENESS": (("entity_type",), ("expected_min", "anchor_query"), "scalar"),
    "RETURN": (("input_var",), (), "input"),
}
COMPARISONS = ("eq", "neq", "gt", "gte", "lt", "lte", "contains", "in")
REFERENCES = ("input_var", "anchor_var", "exclude_var", "left_var", "right_var")


class PlanError(ValueError):
    """A plan that can't be compiled."""


@dataclass(frozen=True)
class Operation:
    output_var: str
    op_type: str
    params: dict[str, Any] = field(default_factory=dict)
    depends_on: tuple[str, ...] = ()
    description: str = ""

    def references(self) -> list[str]:
        """The results that this operation reads, in order."""
        found = [self.params[p] for p in REFERENCES if self.params.get(p) is not None]
        found += list(self.params.get("input_vars") or ())
        found += [v for k, v in self.params.items() if k not in (*REFERENCES, "input_vars") and isinstance(v, str) and v.startswith("$")]
        return [str(v).lstrip("$") for v in found if isinstance(v, str)]


@dataclass(frozen=True)
class QueryPlan:
    question: str
    operations: tuple[Operation, ...]
    final_var: str = ""
    understanding: str = ""

    @property
    def final(self) -> str:
        if self.final_var:
            return self.final_var.lstrip("$")
        return self.operations[-1].output_var if self.operations else ""

    def ancestors(self) -> set[str]:
        """The results that the final one rests on, itself included."""
        by = {op.output_var: op for op in self.operations}
        todo, seen = [self.final], set()
        while todo:
            var = todo.pop()
            if var not in seen and var in by:
                seen.add(var)
                todo += by[var].references()
        return seen


def parse(source: str | dict) -> QueryPlan:
    """A plan from JSON, checked: known operations, their parameters, references to earlier results, kinds."""
    data = json.loads(source) if isinstance(source, str) else source
    operations = tuple(Operation(o["output_var"], o["op_type"], dict(o.get("params") or {}), tuple(o.get("depends_on") or ()), o.get("description", "")) for o in data.get("operations", []))
    plan = QueryPlan(data.get("question", ""), operations, data.get("final_var") or "", data.get("understanding", ""))
    kinds(plan)
    return plan


def kinds(plan: QueryPlan) -> dict[str, str]:
    """The kind of every result; raises PlanError for a plan that doesn't hold together."""
    found: dict[str, str] = {}
    if not plan.operations:
        raise PlanError("a plan needs an operation")
    for op in plan.operations:
        if op.op_type not in OPCODES:
            raise PlanError(f"{op.output_var}: no operation {op.op_type}")
        needed, optional, kind = OPCODES[op.op_type]
        if missing := [p for p in needed if op.params.get(p) is None and not (op.op_type == "FILTER" and p == "value")]:
            raise PlanError(f"{op.output_var} ({op.op_type}): {', '.join(missing)} missing")
        if unknown := [p for p in op.params if p not in (*needed, *optional)]:
            raise PlanError(f"{op.output_var} ({op.op_type}): {', '.join(unknown)} unknown")
        if dangling := [r for r in op.references() if r not in found]:
            raise PlanError(f"{op.output_var} ({op.op_type}): no earlier result {', '.join(dangling)}")
        if op.op_type in ("FILTER", "COMPARE") and op.params["op"] not in COMPARISONS:
            raise PlanError(f"{op.output_var}: no comparison {op.params['op']}")
        if op.op_type == "FILTER" and op.params["op"] == "in" and not isinstance(op.params.get("value"), (list, tuple)):
            raise PlanError(f"{op.output_var}: in takes a list")
        inputs = [found[r] for r in op.references()]
        if op.op_type in ("TRAVERSE", "GET_ATTRIBUTE") and found[str(op.params["input_var"]).lstrip("$")] not in ("entities", "rows"):
            raise PlanError(f"{op.output_var} ({op.op_type}): takes entities")
        if op.op_type in ("COMPARE", "COMPUTE") and any(k not in ("scalar", "rows") for k in inputs):
            raise PlanError(f"{op.output_var} ({op.op_type}): takes numbers")
        found[op.output_var] = found[str(op.params["input_var"]).lstrip("$")] if kind == "input" else kind
    if plan.final not in found:
        raise PlanError(f"no result {plan.final}")
    return found
