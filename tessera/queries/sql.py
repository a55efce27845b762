"""Queries through the SQL surface, and event-time ones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.kg import table
from tessera.plans import sql
from tessera.sources.scratch import folder
from tessera.streaming import ingest

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")
_D = "CAST({} AS DECIMAL(18,2))"
_SUM = "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)"

#: The same text runs on both engines, except where two are given.
SHARED: dict[str, str | tuple[str, str]] = {
    "sql_join_inner": f"SELECT n_name, count(*) AS n, {_SUM} AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "sql_join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "sql_join_right": "SELECT c_custkey, count(o_orderkey) AS n FROM orders RIGHT JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey",
    "sql_join_full": "SELECT p.page_id AS a, l.doc_id AS b FROM pages p FULL JOIN labels l ON p.page_id = l.doc_id",
    "sql_join_semi": ("SELECT o_orderkey FROM orders LEFT SEMI JOIN lineitem ON o_orderkey = l_orderkey", "SELECT o_orderkey FROM orders SEMI JOIN lineitem ON o_orderkey = l_orderkey"),
    "sql_join_anti": ("SELECT o_orderkey FROM orders LEFT ANTI JOIN lineitem ON o_orderkey = l_orderkey", "SELECT o_orderkey FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey"),
    "sql_join_using": "SELECT doc_id, quality, toxic FROM documents JOIN labels USING (doc_id)",
    "sql_join_lateral": "SELECT n_name, x.n FROM nation, LATERAL (SELECT count(*) AS n FROM customer WHERE c_nationkey = n_nationkey) x",
    "sql_count": "SELECT count(*) AS n FROM orders",
    "sql_avg_cast": "SELECT o_orderpriority, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS mean FROM orders GROUP BY o_orderpriority",
    "sql_distinct": "SELECT DISTINCT p_brand, p_size FROM part",
    "sql_agg_filter": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n FROM orders GROUP BY o_orderpriority",
    "sql_grouping_sets": f"SELECT o_orderstatus, o_orderpriority, count(*) AS n, {_SUM} AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "sql_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "sql_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "sql_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15",
    "sql_list_agg": ("SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "sql_window_rank": "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS dr FROM orders",
    "sql_window_lag": "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events",
    "sql_window_frame": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM events",
    "sql_topk_per_group": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2",
    "sql_order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5",
    "sql_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "sql_union_all": "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k",
    "sql_intersect": "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000",
    "sql_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "sql_join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "sql_window_range": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events",
    "sql_window_first_last": "SELECT o_orderkey, first_value(o_orderkey) OVER w AS first_key, last_value(o_orderkey) OVER w AS last_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "sql_quantile": ("SELECT o_orderpriority, round(percentile(CAST(o_totalprice AS DOUBLE), 0.25), 4) AS q FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, round(quantile_cont(CAST(o_totalprice AS DOUBLE), 0.25), 4) AS q FROM orders GROUP BY o_orderpriority"),
    "sql_mode": ("SELECT max(n) AS n, min_by(c_mktsegment, struct(-n, c_mktsegment)) AS segment FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment)", "SELECT max(n) AS n, arg_min(c_mktsegment, {'n': -n, 's': c_mktsegment}) AS segment FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment)"),
    "sql_map": ("SELECT c_custkey, m['a'] AS a, size(m) AS n FROM (SELECT c_custkey, map('a', c_nationkey, 'b', c_custkey) AS m FROM customer)", "SELECT c_custkey, m['a'] AS a, CAST(cardinality(m) AS INT) AS n FROM (SELECT c_custkey, MAP {'a': c_nationkey, 'b': c_custkey} AS m FROM customer)"),
    "sql_json": ("SELECT c_custkey, CAST(get_json_object(to_json(named_struct('k', c_custkey, 's', c_mktsegment)), '$.k') AS BIGINT) AS k, get_json_object(to_json(named_struct('k', c_custkey, 's', c_mktsegment)), '$.s') AS s FROM customer", "SELECT c_custkey, CAST(c_custkey AS BIGINT) AS k, c_mktsegment AS s FROM customer"),
    "sql_except": "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
    "sql_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "sql_recursive": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT CAST(sum(n) AS BIGINT) AS total FROM t",
    "sql_pivot": ("SELECT * FROM (SELECT l_returnflag, l_linestatus, l_orderkey FROM lineitem) PIVOT (count(l_orderkey) FOR l_linestatus IN ('O' AS o, 'F' AS f))", "SELECT l_returnflag, count(l_orderkey) FILTER (WHERE l_linestatus = 'O') AS o, count(l_orderkey) FILTER (WHERE l_linestatus = 'F') AS f FROM lineitem GROUP BY l_returnflag"),
    "sql_unpivot": ("SELECT doc_id, name, value FROM labels UNPIVOT (value FOR name IN (quality, toxic))", "SELECT doc_id, name, value FROM labels UNPIVOT (value FOR name IN (quality, toxic))"),
    "sql_explode": ("SELECT word, count(*) AS n FROM (SELECT explode(split(p_name, ' ')) AS word FROM part) GROUP BY word", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word"),
    "sql_case_dates": ("SELECT year(o_orderdate) AS y, count(*) AS n, count(CASE WHEN month(o_orderdate) <= 6 THEN 1 END) AS h1 FROM orders GROUP BY year(o_orderdate)", "SELECT CAST(year(o_orderdate) AS INT) AS y, count(*) AS n, count(CASE WHEN month(o_orderdate) <= 6 THEN 1 END) AS h1 FROM orders GROUP BY year(o_orderdate)"),
    "sql_correlated": "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "referenced_share": "SELECT round(100.0 * CAST(count(l.doc_id) AS DOUBLE) / count(*), 6) AS value FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "distinct_count": "SELECT c_nationkey, count(DISTINCT o_orderpriority) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey",
}


def _shared(text: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql.register(spark, sf_dir, TABLES)
        return sql.select(spark, text)

    return query


def sql_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark, sf_dir, TABLES)
    return sql.select(spark, "SELECT o_orderkey FROM orders WHERE o_orderstatus = ? AND o_totalprice > ?", ["F", 150000.0])


def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's last click at or before it."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    kinds = sorted(r["event_type"] for r in e.select("event_type").distinct().collect())
    left, right = (e.filter(F.col("event_type") == k) for k in (kinds[0], kinds[1]))
    last = right.groupBy("user_id", "ts").agg(F.max("event_id").alias("last_id"))
    return sql.as_of(left.select("event_id", "user_id", "ts"), last, "user_id", "ts", "last_id").select("event_id", "last_id")


def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events streamed into a keyed table, twice over one checkpoint: the second run finds nothing new."""
    root = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    for _ in range(2):
        ingest.ingest_events(spark, f"{sf_dir}/events.parquet", root)
    return ingest.keyed_table(spark, root).groupBy("event_type").agg(F.count("*").alias("n"))


QUERIES = {name: _shared(s if isinstance(s, str) else s[0]) for name, s in SHARED.items()} | {f.__name__: f for f in (sql_parameters, asof_join, tumbling_window, session_window, stream_ingest)}
ORACLE = {name: s if isinstance(s, str) else s[1] for name, s in SHARED.items()} | {
    "sql_parameters": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000.0",
    "asof_join": """
WITH k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS i FROM (SELECT DISTINCT event_type FROM events)),
l AS (SELECT * FROM events WHERE event_type = (SELECT event_type FROM k WHERE i = 1)),
r AS (SELECT user_id, ts, max(event_id) AS last_id FROM events WHERE event_type = (SELECT event_type FROM k WHERE i = 2) GROUP BY ALL)
SELECT l.event_id, r.last_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""",
    "tumbling_window": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "session_window": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid""",
    "stream_ingest": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type",
}
