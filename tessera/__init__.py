"""tessera: document analytics and training-data operators on Spark DataFrames."""

from __future__ import annotations

from typing import Any

__version__ = "0.1.0"
#: Names of the package and the modules that hold them; loaded when first used, so that workers load only what they run.
EXPORTS = {
    "Engine": "tessera.engine",
    "World": "tessera.kg",
    "QueryPlan": "tessera.plans.ir",
    "Operation": "tessera.plans.ir",
    "PlanError": "tessera.plans.ir",
    "parse": "tessera.plans.ir",
    "compile_plan": "tessera.plans.compile",
    "Answer": "tessera.plans.verify",
    "ask": "tessera.plans.verify",
    "static_planner": "tessera.plans.verify",
    "NotASelect": "tessera.plans.sql",
}
__all__ = ["__version__", *EXPORTS]


def __getattr__(name: str) -> Any:
    if name not in EXPORTS:
        raise AttributeError(name)
    from importlib import import_module

    return getattr(import_module(EXPORTS[name]), name)
