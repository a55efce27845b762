"""The SQL surface: one SELECT over the world's tables as views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parsed plan nodes that a query may hold; anything else is refused.
NODES = frozenset(
    "Project Filter Aggregate Join LateralJoin AsOfJoin Sort GlobalLimit LocalLimit Offset Tail Distinct Deduplicate Union Intersect Except "
    "UnresolvedRelation SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedWith UnionLoop UnresolvedHaving WithWindowDefinition Window "
    "Generate Expand Pivot Unpivot UnresolvedPivot OneRowRelation UnresolvedInlineTable LocalRelation Range UnresolvedTableValuedFunction "
    "UnresolvedTVFAliases UnresolvedHint Sample UnresolvedStarWithColumns NamedParametrizedQuery PosParameterizedQuery".split()
)
#: Functions of Spark's group "misc_funcs", which also holds calls into the JVM, that a query may use.
MISC = frozenset(("typeof", "monotonically_increasing_id", "uuid", "spark_partition_id", "current_user", "version", "equal_null", "assert_true"))


class NotASelect(ValueError):
    """SQL that is not a single query."""


def _items(seq: Any) -> list[Any]:
    return [seq.apply(i) for i in range(seq.size())]


def _walk(plan: Any, views: set[str], spark: SparkSession) -> None:
    """Raise where the plan holds a node, a relation or a function that isn't allowed; ``views`` are names that stand for tables here."""
    kind = plan.getClass().getSimpleName().rstrip("$")
    if kind not in NODES:
        raise NotASelect(f"only queries are allowed, not {kind}")
    if kind == "UnresolvedRelation":
        name = _items(plan.multipartIdentifier())
        if len(name) != 1 or not (name[0].lower() in views or spark._jsparkSession.sessionState().catalog().getTempView(name[0]).isDefined()):
            raise NotASelect(f"no table {'.'.join(name)}")
    if kind == "UnresolvedTableValuedFunction":
        _known(_items(plan.name())[-1], spark)
    inner = _items(plan.innerChildren())
    if kind == "UnresolvedWith":
        views = views | {x.identifier().name().lower() for x in inner if x.getClass().getSimpleName() == "SubqueryAlias"}
    for child in [*inner, *_items(plan.children())]:
        # Expressions can be among the inner ones.
        (_walk if hasattr(child.getClass(), "getSimpleName") and _is_plan(child, spark) else _look)(child, views, spark)
    for expression in _items(plan.expressions()):
        _look(expression, views, spark)


def _is_plan(node: Any, spark: SparkSession) -> bool:
    from py4j.java_gateway import is_instance_of

    return is_instance_of(spark.sparkContext._gateway, node, "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")


def _look(expression: Any, views: set[str], spark: SparkSession) -> None:
    kind = expression.getClass().getSimpleName()
    if "UnresolvedIdentifier" in kind:
        raise NotASelect("names must be written out")
    if kind == "UnresolvedFunction":
        _known(_items(expression.nameParts())[-1], spark)
    from py4j.java_gateway import is_instance_of

    if is_instance_of(spark.sparkContext._gateway, expression, "org.apache.spark.sql.catalyst.expressions.SubqueryExpression"):
        _walk(expression.plan(), views, spark)
    for child in _items(expression.children()):
        _look(child, views, spark)


def _known(name: str, spark: SparkSession) -> None:
    """Raise unless a function is one of Spark's own that stays within the data."""
    jvm = spark._jvm.org.apache.spark.sql.catalyst
    identifier = jvm.FunctionIdentifier(name.lower())
    for registry in (jvm.analysis.FunctionRegistry.builtin(), jvm.analysis.TableFunctionRegistry.builtin()):
        found = registry.lookupFunction(identifier)
        if found.isDefined():
            if found.get().getGroup() == "misc_funcs" and name.lower() not in MISC:
                break
            return
    raise NotASelect(f"no function {name}")


def check(spark: SparkSession, sql: str) -> None:
    """Raise unless the statement is one query over the session's temporary views, with functions that stay within the data.

    The parsed plan is walked, so that neither case, quoting nor nesting hides a name.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as error:
        raise NotASelect(str(error).split("\n")[0]) from None
    _walk(plan, set(), spark)


def select(spark: SparkSession, sql: str, args: Sequence[Any] | Mapping[str, Any] | None = None) -> DataFrame:
    """The result of a query, with positional (?) or named (:x) parameters."""
    check(spark, sql)
    if args is None:
        return spark.sql(sql)
    return spark.sql(sql, args=dict(args) if isinstance(args, Mapping) else list(args))


def register(spark: SparkSession, sf_dir: str, names: Sequence[str]) -> None:
    """Temporary views of Parquet tables."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """``left`` with the last non-null ``value`` of ``right`` for its key at or before its time.

    Union and a running last: one shuffle on the key, no range join.
    """
    from pyspark.sql import Window

    rows = left.withColumn("__v", F.lit(None).cast(dict(right.dtypes)[value])).withColumn("__side", F.lit(1))
    events = right.select(key, time, F.col(value).alias("__v")).withColumn("__side", F.lit(0))
    both = rows.unionByName(events, allowMissingColumns=True)
    window = Window.partitionBy(key).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(window)).filter("__side = 1").drop("__v", "__side")
