"""Queries over scalar functions, retrieval, resolution and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import facts, normalize, text, vectors
from tessera.kg import table, world
from tessera.operators import evidence as etl
from tessera.operators import graph, relational, resolve, search
from tessera.sources import writers

#: Most names whose pairs are all scored.
DICTIONARY = 20_000
_PRICE = "CAST(o_totalprice AS DECIMAL(18,2))"


def _spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' prices and dates in the spellings that documents use."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("v"), F.to_date("o_orderdate").alias("d"))
    k = F.pmod("o_orderkey", F.lit(6))
    v = F.col("v").cast("string")
    money = F.when(k == 0, F.concat(F.lit("INR "), v)).when(k == 1, F.concat(F.lit("Rs. "), v, F.lit(" Cr"))).when(k == 2, F.concat(F.lit("₹"), v)).when(k == 3, F.concat(v, F.lit(" Lakh"))).when(k == 4, F.concat(F.lit("Rupees "), v, F.lit(" crore"))).otherwise(F.lit("not a sum"))
    day = F.when(k == 0, F.date_format("d", "dd-MM-yyyy")).when(k == 1, F.date_format("d", "yyyy-MM-dd")).when(k == 2, F.date_format("d", "d MMMM yyyy")).when(k == 3, F.date_format("d", "MMMM d, yyyy")).when(k == 4, F.concat(F.lit("Dated: "), F.date_format("d", "dd/MM/yyyy"))).otherwise(F.lit("31-02-2021"))
    percent = F.when(k == 5, F.lit("many")).otherwise(F.concat(v, F.element_at(F.array(*map(F.lit, ("%", " %", " percent", "percentage", " percentage"))), F.least(k, F.lit(4)).cast("int") + 1)))
    return o.select("o_orderkey", "v", "d", money.alias("money"), day.alias("day"), percent.alias("percent"))


def normalize_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = normalize.money(F.col("money"))
    return _spellings(spark, sf_dir).select("o_orderkey", r.alias("r")).select("o_orderkey", F.col("r.number").cast("double").alias("rupees"), "r.status")


def normalize_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spellings(spark, sf_dir).select("o_orderkey", normalize.date(F.col("day")).alias("r")).select("o_orderkey", F.col("r.value").alias("day"), "r.status")


def normalize_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spellings(spark, sf_dir).select("o_orderkey", normalize.percentage(F.col("percent")).alias("r")).select("o_orderkey", F.col("r.number").cast("double").alias("percent"), "r.status")


def normalize_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ("sqm", "SQ M", "km", "Day", "months", "Year", "Lacs", "cr.", "Crore", "yards")
    k = F.pmod("p_partkey", F.lit(len(words))).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", normalize.unit(F.element_at(F.array(*map(F.lit, words)), k + 1)).alias("r")).select("p_partkey", F.col("r.value").alias("unit"), "r.status")


def infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of value that inference finds in mixed spellings."""
    rows = _spellings(spark, sf_dir)
    mixed = F.element_at(F.array("money", "percent", "day", F.col("v").cast("string")), F.pmod("o_orderkey", F.lit(4)).cast("int") + 1)
    return rows.select(F.pmod("o_orderkey", F.lit(12)).alias("form"), normalize.infer(mixed)["type"].alias("type")).groupBy("form", "type").agg(F.count("*").alias("n"))


def header_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ("Contract Value (INR)", "Unit Price", "Rate", "Qty.", "Item No", "Particulars", "Start Date", "UOM", "Remarks")
    k = F.pmod("p_partkey", F.lit(len(words))).cast("int")
    return table(spark, sf_dir, "part").select(facts.header_predicate(F.element_at(F.array(*map(F.lit, words)), k + 1)).alias("predicate")).groupBy("predicate").agg(F.count("*").alias("n"))


def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_text(F.col("text")).cast("binary")).alias("digest"))


def exact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that equal another after normalization: one equi-join on digests."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_text(F.col("text")).cast("binary")).alias("k"))
    return d.groupBy("k").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("first_id", "n")


def exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose normalized text is that of the first one."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text")
    first = rows.filter("text is not null").orderBy("source_id").first()["text"]
    return search.exact(rows, f"  {first.upper()} ").select("source_id", "score")


def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors nearest to the first one."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    query = e.orderBy("vec_id").first()["embedding"]
    return search.semantic(e, F.lit(query), 10, tie="vec_id").select("vec_id", F.round("score", 6).alias("score"))


def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = world(spark, sf_dir)
    return relational.coverage(w, w.evidence.select("document_id").distinct())


def provenance_of_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a nation rests on: the edges of its customers and suppliers, and its own."""
    return relational.provenance(world(spark, sf_dir), "nation:7").select("via", "evidence_id")


def edges_of_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.range(1).select(F.lit("nation:7").alias("entity_id"))
    return graph.hop_edges(world(spark, sf_dir).relationships, start, "both").select("from_id", "entity_id", "predicate")


def fuzzy_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of the distinct part names, scored; they are a dictionary, which is counted before it is broadcast."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("a")).distinct()
    if names.limit(DICTIONARY + 1).count() > DICTIONARY:
        raise ValueError("part names are no dictionary here")
    return names.join(F.broadcast(names.select(F.col("a").alias("b"))), F.col("a") < F.col("b")).select("a", "b", F.round(text.indel_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


def fuzzy_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_id"), F.col("p_name").alias("text"))
    return search.fuzzy(rows, "green wdget small", 10).select("source_id", "text", F.round("score", 6).alias("score"))


def predicate_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = world(spark, sf_dir)
    names = search.matching_names(w.names("attributes"), "total price")
    return spark.createDataFrame([(n,) for n in names], "predicate string")


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_name").distinct().select("p_name", vectors.hash_embedding(F.col("p_name")).alias("v"))
    # Not posexplode: the optimizer would filter by the size of the vector, which it computes for every row, below the distinct.
    return rows.select("p_name", F.posexplode_outer("v").alias("i", "x")).select("p_name", "i", F.round("x", 6).alias("x"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of all vectors to each whose id is divisible by 100."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    pairs = e.join(q, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", F.round(vectors.cosine(F.col("v"), F.col("q"), 0.0), 6).alias("score"))
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(window)).filter("rank <= 5")


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents nearest to a query, by whole texts."""
    key = F.col("doc_id").cast("string")
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), key).alias("source_id"), F.lit("evidence").alias("source"), key.alias("document_id"), "text")
    return search.hybrid(rows, "the inner text of a thing", 8).select("source_id", "by", F.round("score", 6).alias("score"))


def resolve_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of nations, one of them misspelt, resolved or not."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("entity_id"), F.lit("nation").alias("entity_type"), F.col("n_name").alias("name"), F.array(F.col("n_name")).alias("aliases"))
    m = table(spark, sf_dir, "nation").select(F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("mention_id"), F.when(F.col("n_nationkey") == 3, "elsewhere").otherwise(F.lower(F.translate("n_name", "_", " "))).alias("mention_text"), F.lit("Nation").alias("entity_type"))
    found = resolve.finalize(resolve.resolve_mentions(m, n), ["mention_id"])
    return m.join(found, "mention_id", "left").select("mention_id", "entity_id", F.coalesce("status", F.lit("unresolved")).alias("status"))


def resolve_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("mention_id"), F.col("p_name").alias("mention_text"), F.lit("part").alias("entity_type"), F.lit(0.9).alias("confidence"))
    made = resolve.resolve_or_create(m)
    return made.select("entity_id", F.size("mention_ids").alias("n"), "status")


def k_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = world(spark, sf_dir, ("region", "nation", "customer"))
    start = w.entities.filter("entity_type = 'customer'").select("entity_id")
    return graph.k_hop(w.relationships, start, 2).groupBy("depth").agg(F.count("*").alias("n"))


def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = world(spark, sf_dir, ("region", "nation", "customer", "order"))
    first = table(spark, sf_dir, "orders").agg(F.min("o_orderkey").alias("k")).first()["k"]
    region = table(spark, sf_dir, "orders").filter(F.col("o_orderkey") == first).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).first()["n_regionkey"]
    return graph.shortest_path(w.relationships, f"order:{first}", f"region:{region}").select(F.array_join("path", ">").alias("path"), F.col("length").cast("long").alias("length"))


def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = world(spark, sf_dir)
    return graph.counts(w.entities, w.relationships)


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return writers.latest(e, "user_id", F.struct("ts", "event_id")).select("user_id", "event_id", "event_type")


def incremental_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the state of an earlier run, which had taken in those with a label, doesn't hold with this content."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.sha2(F.col("text").cast("binary"), 256).alias("checksum"), "doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    # Of toxic ones the state holds another content.
    state = d.join(labels, "doc_id").select("document_id", F.when(F.col("toxic") == 1, F.lit("changed")).otherwise(F.col("checksum")).alias("checksum"))
    return etl.unchanged(d, state).select("doc_id")


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines state several return flags."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_orderkey").cast("string").alias("document_id"), F.lit("return_flag").alias("predicate"), F.col("l_returnflag").alias("normalized_value"))
    return etl.conflicting(rows).select(F.col("document_id").cast("long").alias("l_orderkey"), "n_values")


def stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", facts.stable_hex(F.lit("entity"), F.col("c_mktsegment"), F.col("c_name")).alias("id"))


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), F.sha2(F.col("n_regionkey").cast("string").cast("binary"), 256).alias("checksum"))
    return writers.fingerprint(n)


def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build's report, over orders as documents with their lines as evidence and the spellings of their prices as facts."""
    value = normalize.money(F.col("money"))
    rows = _spellings(spark, sf_dir).select(F.col("o_orderkey").cast("string").alias("document_id"), F.lit("price").alias("predicate"), F.coalesce(value["value"], F.col("money")).alias("normalized_value"), F.when(value["status"] == "valid", "currency_inr").otherwise("text").alias("normalized_type"))
    return etl.report(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), rows)


def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = world(spark, sf_dir)
    return w.entities.groupBy(F.col("entity_type").alias("type")).agg(F.count("*").alias("n"))


def shape_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_totalprice").cast("decimal(18,2)").alias("gold"))
    scored = o.withColumn("score", facts.score_answer(F.col("gold"), F.when(F.col("gold") > 100000, F.col("gold") * 2).otherwise(F.col("gold"))))
    return scored.groupBy(F.col("o_orderpriority").alias("shape")).agg(F.sum("score").alias("score"), F.count("*").alias("n"))


def column_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.concat(F.upper(F.substring(F.regexp_replace("p_name", "[^a-z]", ""), 1, 2)), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", facts.column_index(cells).alias("column"), facts.row_number(cells).alias("row"))


def token_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.round(text.token_coverage(F.col("p_name"), F.lit("small red green widget")), 6).alias("coverage"))
    return p


def chunk_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation, as fragments of a document, in batches of three."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("conv_id").cast("string").alias("document_id"), F.concat_ws(":", "conv_id", "turn").alias("evidence_id"), F.col("turn").alias("position"))
    return etl.batches(rows, 3).groupBy("conv_id", "batch").agg(F.count("*").alias("n"), F.min("position").cast("long").alias("first_turn"))


def rank_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten dearest orders, by their place."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 20, "0").alias("entity_id"), F.col("o_totalprice").cast("decimal(38,6)").alias("value_number"))
    return relational.ranked(rows, 10).select("o_orderkey", "rank")


QUERIES = {f.__name__: f for f in (normalize_money, normalize_date, normalize_percent, normalize_unit, infer, header_predicate, text_normalize, exact_lookup, exact_search, semantic_search, coverage_counts, provenance_of_nation, edges_of_nation, fuzzy_ratio, fuzzy_topk, predicate_match, hash_embedding, cosine_topk, hybrid_topk, resolve_status, resolve_or_create, k_hop, shortest_path, graph_counts, upsert_latest, incremental_new, conflicts, stable_id, fingerprint, report_counts, type_histogram, shape_score, column_index, token_coverage, chunk_batches, rank_desc)}

_NORMAL = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_LCS = (
    "list_reduce(list_prepend(list_transform(range(0, len({b}) + 1), lambda z: 0::BIGINT), list_transform(string_split({a}, ''), lambda s: [unicode(s)::BIGINT])), "
    "lambda row, c: list_reduce(list_prepend([0::BIGINT], list_transform(range(1, len({b}) + 1), lambda j: [j::BIGINT])), "
    "lambda acc, x: list_append(acc, CASE WHEN unicode({b}[x[1]]) = c[1] THEN row[x[1]] + 1 ELSE greatest(row[x[1] + 1], acc[-1]) END)))[-1]"
)
_SORTED = "array_to_string(list_sort(string_split(" + _NORMAL.format("p_name") + ", ' ')), ' ')"
_MONEY_STATUS = "CASE WHEN o_orderkey % 6 = 5 THEN 'failed' ELSE 'valid' END"
_FACTOR = "CASE o_orderkey % 6 WHEN 1 THEN 10000000 WHEN 3 THEN 100000 WHEN 4 THEN 10000000 ELSE 1 END"
_CODE = "['sqm', 'sqm', 'km', 'days', 'months', 'years', 'lakh', 'crore', 'crore', NULL]"
ORACLE = {
    "normalize_money": f"SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 5 THEN CAST(round_even(CAST({_PRICE} * {_FACTOR} AS DECIMAL(30,2)), 0) AS DOUBLE) END AS rupees, {_MONEY_STATUS} AS status FROM orders",
    "normalize_date": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 5 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 6 = 5 THEN 'failed' ELSE 'valid' END AS status FROM orders",
    "normalize_percent": f"SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 5 THEN CAST({_PRICE} AS DOUBLE) END AS percent, {_MONEY_STATUS} AS status FROM orders",
    "normalize_unit": f"SELECT p_partkey, {_CODE}[p_partkey % 10 + 1] AS unit, CASE WHEN p_partkey % 10 = 9 THEN 'failed' ELSE 'valid' END AS status FROM part",
    "infer": """
SELECT o_orderkey % 12 AS form, CASE o_orderkey % 4
  WHEN 0 THEN CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE 'currency_inr' END
  WHEN 1 THEN CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE 'percentage' END
  WHEN 2 THEN CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE 'date' END ELSE 'number' END AS type, count(*) AS n
FROM orders GROUP BY ALL""",
    "header_predicate": "SELECT ['contract_value', 'amount', 'rate', 'quantity', 'item_number', 'description', 'date', 'unit', NULL][p_partkey % 9 + 1] AS predicate, count(*) AS n FROM part GROUP BY ALL",
    "text_normalize": f"SELECT doc_id, md5({_NORMAL.format('text')}) AS digest FROM documents",
    "exact_lookup": f"SELECT min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY {_NORMAL.format('text')} HAVING count(*) > 1",
    "exact_search": f"SELECT doc_id AS source_id, 100.0::DOUBLE AS score FROM documents WHERE {_NORMAL.format('text')} = (SELECT {_NORMAL.format('text')} FROM documents WHERE text IS NOT NULL ORDER BY doc_id LIMIT 1)",
    "semantic_search": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v AS qv FROM e ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_dot_product(v, qv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv)) + 1e-9), 6) AS score FROM e, q ORDER BY list_dot_product(v, qv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv)) + 1e-9) DESC, vec_id LIMIT 10",
    "coverage_counts": """
SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM documents) AS evidence, 0::BIGINT AS facts,
  (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) AS entities,
  (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) + 2 * (SELECT count(*) FROM lineitem) AS relationships,
  2 * (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + 3 * (SELECT count(*) FROM part) + 4 * (SELECT count(*) FROM orders) AS attributes,
  0::BIGINT AS mentions, 0::BIGINT AS documents_covered, 0::BIGINT AS vectors""",
    "provenance_of_nation": """
SELECT 'relationship' AS via, 'ev:customer:' || c_custkey AS evidence_id FROM customer WHERE c_nationkey = 7
UNION SELECT 'relationship', 'ev:supplier:' || s_suppkey FROM supplier WHERE s_nationkey = 7
UNION SELECT 'relationship', 'ev:nation:7'""",
    "edges_of_nation": """
SELECT 'nation:7' AS from_id, 'customer:' || c_custkey AS entity_id, 'located_in' AS predicate FROM customer WHERE c_nationkey = 7
UNION ALL SELECT 'nation:7', 'supplier:' || s_suppkey, 'located_in' FROM supplier WHERE s_nationkey = 7
UNION ALL SELECT 'nation:7', 'region:' || n_regionkey, 'part_of' FROM nation WHERE n_nationkey = 7""",
    "fuzzy_ratio": f"WITH n AS (SELECT DISTINCT p_name FROM part), p AS (SELECT x.p_name AS a, y.p_name AS b FROM n x JOIN n y ON x.p_name < y.p_name) SELECT a, b, round(200.0::DOUBLE * {_LCS.format(a='a', b='b')} / (len(a) + len(b)), 6) AS ratio FROM p",
    "fuzzy_topk": f"""
WITH n AS (SELECT DISTINCT p_name, {_SORTED} AS k, 'green small wdget' AS q FROM part),
r AS (SELECT p_name, round(200.0::DOUBLE * {_LCS.format(a='k', b='q')} / (len(k) + len(q)), 6) AS score FROM n)
SELECT p_partkey AS source_id, p_name AS text, score FROM part JOIN r USING (p_name) WHERE score >= 30 ORDER BY score DESC, p_partkey LIMIT 10""",
    "hash_embedding": """
WITH t AS (SELECT DISTINCT p_name, list_reduce(list_transform(range(48), lambda k: sha256(p_name || ':' || k)), lambda x, y: x || y) AS h FROM part),
r AS (SELECT p_name, i, ('0x' || substr(h, i * 8 + 1, 8))::BIGINT / 4294967295.0::DOUBLE * 2.0 - 1.0 AS x FROM t, range(384) AS s(i))
SELECT p_name, CAST(i AS INT) AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY p_name)), 6) AS x FROM r""",
    "cosine_topk": """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.v, q.v), 6) AS score FROM e, e q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id)
SELECT query_id, vec_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "predicate_match": "SELECT 'total_price' AS predicate UNION ALL SELECT 'retail_price'",
    "resolve_status": "SELECT 'm' || n_nationkey AS mention_id, CASE WHEN n_nationkey <> 3 THEN 'nation:' || n_nationkey END AS entity_id, CASE WHEN n_nationkey <> 3 THEN 'resolved' ELSE 'unresolved' END AS status FROM nation",
    "resolve_or_create": f"SELECT sha256('entity' || 'part' || {_NORMAL.format('p_name')}) AS entity_id, CAST(count(*) AS INT) AS n, CASE WHEN count(*) > 1 THEN 'resolved' ELSE 'unresolved' END AS status FROM part GROUP BY {_NORMAL.format('p_name')}",
    "k_hop": "SELECT 0::INT AS depth, count(*) AS n FROM customer UNION ALL SELECT 1, count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 2, count(DISTINCT n_regionkey) FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)",
    "shortest_path": "SELECT 'order:' || o_orderkey || '>customer:' || c_custkey || '>nation:' || n_nationkey || '>region:' || n_regionkey AS path, 3::BIGINT AS length FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)",
    "graph_counts": "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) AS nodes, (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) + 2 * (SELECT count(*) FROM lineitem) AS edges",
    "upsert_latest": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "incremental_new": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND (l.toxic IS NULL OR l.toxic <> 1))",
    "conflicts": "SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, count(DISTINCT l_returnflag) AS n_values FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1",
    "stable_id": "SELECT c_custkey, sha256('entity' || c_mktsegment || c_name) AS id FROM customer",
    "fingerprint": "SELECT sha256(string_agg(h, '' ORDER BY h)) AS fingerprint FROM (SELECT sha256(n_name || ':' || sha256(CAST(n_regionkey AS VARCHAR))) AS h FROM nation)",
    "report_counts": "SELECT count(*) AS documents_processed, (SELECT count(*) FROM lineitem) AS evidence_created, count(*) AS facts_created, count(*) FILTER (WHERE o_orderkey % 6 <> 5) AS normalization_successes, count(*) FILTER (WHERE o_orderkey % 6 = 5) AS unsupported_values, 0::BIGINT AS conflicting_facts FROM orders",
    "type_histogram": "SELECT 'region' AS type, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'order', count(*) FROM orders",
    "shape_score": "SELECT o_orderpriority AS shape, CAST(count(*) FILTER (WHERE CAST(o_totalprice AS DECIMAL(18,2)) <= 100000) AS DOUBLE) AS score, count(*) AS n FROM orders GROUP BY 1",
    "column_index": "WITH p AS (SELECT p_partkey, upper(substr(regexp_replace(p_name, '[^a-z]', '', 'g'), 1, 2)) AS s FROM part) SELECT p_partkey, CAST((ascii(s) - 64) * 26 + ascii(substr(s, 2, 1)) - 64 AS INT) AS \"column\", CAST(p_partkey AS INT) AS row FROM p",
    "token_coverage": "WITH p AS (SELECT p_partkey, list_distinct(string_split(" + _NORMAL.format("p_name") + ", ' ')) AS w FROM part) SELECT p_partkey, round(len(list_intersect(w, ['small', 'red', 'green', 'widget'])) / len(w), 6) AS coverage FROM p",
    "chunk_batches": "SELECT conv_id, batch, count(*) AS n, CAST(min(turn) AS BIGINT) AS first_turn FROM (SELECT conv_id, turn, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS BIGINT) AS batch FROM conversations) GROUP BY ALL",
    "rank_desc": "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY CAST(o_totalprice AS DECIMAL(38,6)) DESC, o_orderkey) - 1 AS INT) AS rank FROM orders ORDER BY rank LIMIT 10",
}
