"""Queries that run through plans: the shapes of questions a document world is asked."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.kg import World, world
from tessera.operators import relational
from tessera.plans.compile import compile_plan
from tessera.plans.ir import parse


def op(var: str, kind: str, **params) -> dict:
    return {"output_var": var, "op_type": kind, "params": params}


def run(w: World, *operations: dict) -> DataFrame:
    plan = parse({"question": "", "operations": list(operations)})
    return compile_plan(plan, w)[plan.final].df


#: Customers of one nation and their orders: the start of most shapes.
def _orders_of(nation: str) -> list[dict]:
    return [
        op("n", "RESOLVE_ENTITY", query=nation, entity_type="nation"),
        op("c", "ENUMERATE", entity_type="customer", predicate="located_in", anchor_var="$n"),
        op("o", "ENUMERATE", entity_type="order", predicate="placed_by", anchor_var="$c"),
    ]


_WORLD = ("nation", "customer", "order")
_JOINED = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
_NUM = "CAST(o_totalprice AS DECIMAL(38,6))"


def hop_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(world(spark, sf_dir, _WORLD), *_orders_of("NATION_1"), op("p", "GET_ATTRIBUTE", input_var="$o", predicate="total_price"), op("s", "AGGREGATE", input_var="$p", function="sum"), op("r", "RETURN", input_var="$s"))


def temporal_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = world(spark, sf_dir, _WORLD)
    operations = [*_orders_of("NATION_2"), op("d", "GET_ATTRIBUTE", input_var="$o", predicate="order_date"), op("l", "FILTER", input_var="$d", field="value", op="gte", value="1996-01-01"), op("p", "GET_ATTRIBUTE", input_var="$l", predicate="total_price"), op("s", "AGGREGATE", input_var="$p", function="sum")]
    return run(w, *operations)


def exclusion_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = world(spark, sf_dir, _WORLD)
    return run(w, *_orders_of("NATION_3"), op("t", "GET_ATTRIBUTE", input_var="$o", predicate="order_status"), op("x", "FILTER", input_var="$t", field="value", op="neq", value="F"), op("p", "GET_ATTRIBUTE", input_var="$x", predicate="total_price"), op("s", "AGGREGATE", input_var="$p", function="sum"))


def threshold_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = world(spark, sf_dir, _WORLD)
    return run(w, *_orders_of("NATION_4"), op("p", "GET_ATTRIBUTE", input_var="$o", predicate="total_price"), op("x", "FILTER", input_var="$p", field="value", op="gte", value=200000), op("s", "AGGREGATE", input_var="$x", function="sum"))


def avg_work_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = world(spark, sf_dir, _WORLD)
    return run(w, *_orders_of("NATION_5"), op("p", "GET_ATTRIBUTE", input_var="$o", predicate="total_price"), op("s", "AGGREGATE", input_var="$p", function="avg")).select(F.round("value", 4).alias("value"))


def gap_to_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = hop_aggregate(spark, sf_dir)
    return total.select((F.lit(1e9) - F.col("value")).alias("value"))


def absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that contain nothing."""
    w = world(spark, sf_dir, ("order", "part"))
    return run(w, op("o", "ENUMERATE", entity_type="order"), op("p", "ENUMERATE", entity_type="part"), op("h", "ENUMERATE", entity_type="order", predicate="contains", anchor_var="$p"), op("d", "DIFFERENCE", input_var="$o", exclude_var="$h"))


def absence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = world(spark, sf_dir, ("order", "part"))
    return run(w, op("o", "ENUMERATE", entity_type="order"), op("p", "ENUMERATE", entity_type="part"), op("h", "ENUMERATE", entity_type="order", predicate="contains", anchor_var="$p"), op("d", "DIFFERENCE", input_var="$o", exclude_var="$h"), op("n", "AGGREGATE", input_var="$d", function="count"))


def rank_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap between the two largest orders of a nation."""
    w = world(spark, sf_dir, _WORLD)
    rows = run(w, *_orders_of("NATION_6"), op("p", "GET_ATTRIBUTE", input_var="$o", predicate="total_price"))
    top = relational.ranked(rows, 2)
    return top.agg((F.max("value_number") - F.min("value_number")).cast("double").alias("value"))


def date_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from an order to its last shipment."""
    w = world(spark, sf_dir, ("order",))
    ordered = run(w, op("o", "ENUMERATE", entity_type="order"), op("d", "GET_ATTRIBUTE", input_var="$o", predicate="order_date"))
    shipped = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("entity_id"), F.col("l_shipdate").cast("date").alias("value_date"))
    return relational.days_between(shipped, ordered)


def traverse(direction: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = world(spark, sf_dir, ("region", "nation", "customer"))
        rows = run(w, op("n", "RESOLVE_ENTITY", query="NATION_7", entity_type="nation"), op("t", "TRAVERSE", input_var="$n", direction=direction))
        return rows.select("entity_id")

    return query


def enumerate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(world(spark, sf_dir, ("customer", "nation", "order")), op("c", "ENUMERATE", entity_type="Customer"))


def enumerate_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(world(spark, sf_dir, ("nation", "supplier", "customer")), op("n", "RESOLVE_ENTITY", query="nation 8", entity_type="nation"), op("s", "ENUMERATE", entity_type="supplier", predicate="located in", anchor_var="$n"))


def facts_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines are facts about their order's price; other orders fall back to the attribute."""
    w = world(spark, sf_dir, ("order",))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_returnflag = 'R'")
    document = F.concat(F.lit("doc:"), F.col("l_orderkey").cast("string"))
    price = F.col("l_extendedprice").cast("decimal(38,6)")
    facts = lines.select(F.concat_ws(":", F.lit("fact"), "l_orderkey", "l_linenumber").alias("fact_id"), F.concat_ws(":", F.lit("line"), "l_orderkey", "l_linenumber").alias("evidence_id"), document.alias("document_id"), F.lit("total_price").alias("predicate"), F.col("l_extendedprice").cast("string").alias("raw_value"), price.alias("value_number"), F.lit(None).cast("date").alias("value_date"), F.lit("valid").alias("validation_status"))
    mentions = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("m:"), F.col("o_orderkey").cast("string")).alias("mention_id"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("entity_id"), F.concat(F.lit("doc:"), F.col("o_orderkey").cast("string")).alias("document_id"))
    w = replace(w, facts=facts, mentions=mentions)
    rows = run(w, op("o", "ENUMERATE", entity_type="order"), op("p", "GET_ATTRIBUTE", input_var="$o", predicate="total_price"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("orders"), F.sum("value_number").cast("double").alias("total"))


def compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = world(spark, sf_dir, _WORLD)
    sums = [x for k, n in (("a", "NATION_1"), ("b", "NATION_2")) for x in (op(f"n{k}", "RESOLVE_ENTITY", query=n, entity_type="nation"), op(f"c{k}", "ENUMERATE", entity_type="customer", predicate="located_in", anchor_var=f"$n{k}"), op(f"p{k}", "GET_ATTRIBUTE", input_var=f"$c{k}", predicate="account_balance"), op(f"s{k}", "AGGREGATE", input_var=f"$p{k}", function="sum"))]
    return run(w, *sums, op("x", "COMPARE", left_var="$sa", right_var="$sb", op="gt"))


def compute(operation: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = world(spark, sf_dir, _WORLD)
        sums = [x for k, n in (("a", "NATION_1"), ("b", "NATION_2")) for x in (op(f"n{k}", "RESOLVE_ENTITY", query=n, entity_type="nation"), op(f"c{k}", "ENUMERATE", entity_type="customer", predicate="located_in", anchor_var=f"$n{k}"), op(f"p{k}", "GET_ATTRIBUTE", input_var=f"$c{k}", predicate="account_balance"), op(f"s{k}", "AGGREGATE", input_var=f"$p{k}", function="sum"))]
        return run(w, *sums, op("x", "COMPUTE", operation=operation, input_vars=["$sa", "$sb"])).select(F.round("value", 6).alias("value"))

    return query


def calculate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every aggregate over one attribute, in one pass over it."""
    w = world(spark, sf_dir, ("order",))
    rows = w.attributes.filter("predicate = 'total_price'")
    names = ("sum", "avg", "min", "max", "count", "median")
    return rows.agg(*[F.round(relational.AGGREGATES[n](F.col("value_number")), 4).alias(n) for n in names])


def filters(field: str, operator: str, value: object):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = world(spark, sf_dir, ("part",))
        if field == "name":
            return run(w, op("p", "ENUMERATE", entity_type="part"), op("f", "FILTER", input_var="$p", field="name", op=operator, value=value)).select("entity_id")
        return run(w, op("p", "ENUMERATE", entity_type="part"), op("a", "GET_ATTRIBUTE", input_var="$p", predicate=field), op("f", "FILTER", input_var="$a", field="value", op=operator, value=value)).select("entity_id")

    return query


def completeness_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against those that have a label on file."""
    w = world(spark, sf_dir, ("nation",))
    ids = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.concat(F.lit("document:"), F.col("doc_id").cast("string")).alias("document_id"))
    mentions = ids("labels").withColumn("entity_id", F.lit("record:1")).withColumn("mention_id", F.col("document_id"))
    entities = spark.range(1).select(F.lit("record:1").alias("entity_id"), F.lit("record").alias("entity_type"), F.lit("resolved").alias("status"))
    w = replace(w, entities=entities, mentions=mentions)
    return relational.completeness(w, "record", 1, ids("documents"))


QUERIES = {
    "hop_aggregate": hop_aggregate,
    "temporal_chain": temporal_chain,
    "exclusion_aggregate": exclusion_aggregate,
    "threshold_aggregate": threshold_aggregate,
    "avg_work_size": avg_work_size,
    "gap_to_threshold": gap_to_threshold,
    "absence": absence,
    "absence_count": absence_count,
    "rank_value": rank_value,
    "date_span": date_span,
    "traverse_out": traverse("out"),
    "traverse_in": traverse("in"),
    "traverse_both": traverse("both"),
    "enumerate_all": enumerate_all,
    "enumerate_anchored": enumerate_anchored,
    "get_attribute_facts_first": facts_first,
    "compare": compare,
    "compute_diff": compute("diff"),
    "compute_ratio": compute("ratio"),
    "compute_pct_diff": compute("pct_diff"),
    "compute_sum": compute("sum"),
    "calculate_all": calculate_all,
    "filter_eq": filters("size", "eq", 10),
    "filter_neq": filters("brand", "neq", "Brand#11"),
    "filter_gt": filters("retail_price", "gt", 949.9),
    "filter_gte": filters("retail_price", "gte", 949.9),
    "filter_lt": filters("retail_price", "lt", 949.9),
    "filter_lte": filters("size", "lte", 5),
    "filter_contains": filters("name", "contains", "RE"),
    "filter_in": filters("brand", "in", ["Brand#11", "Brand#22"]),
    "completeness_missing": completeness_missing,
}


def _sum(where: str) -> str:
    return f"SELECT CAST(coalesce(sum({_NUM}), 0) AS DOUBLE) AS value FROM {_JOINED} WHERE {where}"


_PART = "SELECT 'part:' || p_partkey AS entity_id FROM part WHERE "
_BALANCE = "(SELECT CAST(sum(CAST(c_acctbal AS DECIMAL(38,6))) AS DOUBLE) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = '{}')"
_A, _B = _BALANCE.format("NATION_1"), _BALANCE.format("NATION_2")
_NEAR = {
    "out": "SELECT 'region:' || n_regionkey AS entity_id FROM nation WHERE n_name = 'NATION_7'",
    "in": "SELECT 'customer:' || c_custkey AS entity_id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7'",
}
_EMPTY = "SELECT 'order:' || o_orderkey AS entity_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"
ORACLE = {
    "hop_aggregate": _sum("n_name = 'NATION_1'"),
    "temporal_chain": _sum("n_name = 'NATION_2' AND o_orderdate >= DATE '1996-01-01'"),
    "exclusion_aggregate": _sum("n_name = 'NATION_3' AND o_orderstatus <> 'F'"),
    "threshold_aggregate": _sum(f"n_name = 'NATION_4' AND {_NUM} >= 200000"),
    "avg_work_size": f"SELECT round(CAST(sum({_NUM}) AS DOUBLE) / count(*), 4) AS value FROM {_JOINED} WHERE n_name = 'NATION_5'",
    "gap_to_threshold": f"SELECT 1e9 - CAST(coalesce(sum({_NUM}), 0) AS DOUBLE) AS value FROM {_JOINED} WHERE n_name = 'NATION_1'",
    "absence": _EMPTY,
    "absence_count": f"SELECT CAST(count(*) AS DOUBLE) AS value FROM ({_EMPTY})",
    "rank_value": f"SELECT CAST(max(v) - min(v) AS DOUBLE) AS value FROM (SELECT {_NUM} AS v FROM {_JOINED} WHERE n_name = 'NATION_6' ORDER BY v DESC LIMIT 2)",
    "date_span": "SELECT 'order:' || o_orderkey AS entity_id, date_diff('day', CAST(o_orderdate AS DATE), max(CAST(l_shipdate AS DATE)))::BIGINT AS days FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate",
    "traverse_out": _NEAR["out"],
    "traverse_in": _NEAR["in"],
    "traverse_both": f"{_NEAR['out']} UNION {_NEAR['in']}",
    "enumerate_all": "SELECT 'customer:' || c_custkey AS entity_id FROM customer",
    "enumerate_anchored": "SELECT 'supplier:' || s_suppkey AS entity_id FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_8'",
    "get_attribute_facts_first": f"""
WITH f AS (SELECT l_orderkey AS k, CAST(l_extendedprice AS DECIMAL(38,6)) AS v FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders))
SELECT 'facts' AS source, count(*) AS n, count(DISTINCT k) AS orders, CAST(sum(v) AS DOUBLE) AS total FROM f
UNION ALL SELECT 'attributes', count(*), count(DISTINCT o_orderkey), CAST(sum({_NUM}) AS DOUBLE) FROM orders WHERE o_orderkey NOT IN (SELECT k FROM f)""",
    "compare": f"SELECT {_A} > {_B} AS value",
    "compute_diff": f"SELECT round({_A} - {_B}, 6) AS value",
    "compute_ratio": f"SELECT round({_A} / {_B}, 6) AS value",
    "compute_pct_diff": f"SELECT round(({_A} - {_B}) / {_B} * 100, 6) AS value",
    "compute_sum": f"SELECT round({_A} + {_B}, 6) AS value",
    "calculate_all": f"SELECT round(CAST(sum({_NUM}) AS DOUBLE), 4) AS sum, round(CAST(sum({_NUM}) AS DOUBLE) / count(*), 4) AS avg, round(CAST(min({_NUM}) AS DOUBLE), 4) AS min, round(CAST(max({_NUM}) AS DOUBLE), 4) AS max, CAST(count(*) AS DOUBLE) AS count, round(CAST(median({_NUM}) AS DOUBLE), 4) AS median FROM orders",
    "filter_eq": _PART + "p_size = 10",
    "filter_neq": _PART + "p_brand IS DISTINCT FROM 'Brand#11'",
    "filter_gt": _PART + "CAST(p_retailprice AS DECIMAL(18,2)) > 949.9",
    "filter_gte": _PART + "CAST(p_retailprice AS DECIMAL(18,2)) >= 949.9",
    "filter_lt": _PART + "CAST(p_retailprice AS DECIMAL(18,2)) < 949.9",
    "filter_lte": _PART + "p_size <= 5",
    "filter_contains": _PART + "contains(lower(p_name), 're')",
    "filter_in": _PART + "p_brand IN ('Brand#11', 'Brand#22')",
    "completeness_missing": "SELECT 1::BIGINT AS count, 0::BIGINT AS unresolved_count, 0::BIGINT AS ambiguous_count, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing_count, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) = 0 AS complete",
}
