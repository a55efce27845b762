"""Benchmark decontamination by winnowing.

Words are runs of lower-case letters, digits and non-ASCII characters, after
A-Z are lower-cased.  Both sides hash every ``GRAM`` consecutive words, and keep
the least hash of every ``SPAN`` consecutive grams.  Any span of
``GRAM + SPAN - 1`` = 10 words that a document shares with an item therefore
keeps one gram in common.  The kept hashes are joined, and tell the documents that
may hold a window.  In those, hits are extended: every run of 10 words is looked up
among the windows of the items, and runs that match and overlap are one span.  An
item of fewer words is one window: it is looked up by the hash of all its words,
among all runs of that many words.

Only DataFrame functions run here.  Exploded rows hold hashes, never words or texts,
so that the work grows as the length of a text; the text stays in its row, and one
row a document is shuffled.  The benchmark's fingerprints and windows, rows of fixed
width and at most one for each word, are broadcast where its words are counted to be
under ``BROADCAST_WORDS``; a larger benchmark is joined by shuffles.  Documents with
hits are read again: by their ids, broadcast up to ``BROADCAST_IDS``, beyond by a shuffle.

Edge cases: a null text has no words and no windows; an item without words has
none; repeated items count once each by item_id, one without an id marks words
but isn't listed; repeated rows of a document
each give a row (rows of one doc_id with different texts too); an empty table
of documents gives an empty result, an empty benchmark leaves all clean; long
texts are taken whole; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, table

WINDOW = 10
GRAM, SPAN = 6, 5
#: Largest benchmark, in words, whose hashes are broadcast: at most one row of two numbers for each word.
BROADCAST_WORDS = 200_000
#: Most documents whose ids are broadcast to pick their rows.
BROADCAST_IDS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BREAK), "")


def _pairs(a: Column, shift: int, b: Column, f) -> Column:
    """f(a[i], b[i + shift]) wherever both exist."""
    n = F.greatest(F.size(b) - shift, F.lit(0))
    return F.zip_with(F.slice(a, 1, F.least(F.size(a), n)), F.slice(b, shift + 1, n), f)


def _mixed(x: Column, y: Column) -> Column:
    return F.xxhash64(x, y)


def with_grams(df: DataFrame) -> DataFrame:
    """``words`` hashed: ``wh`` each word, and ``kept``, the winnowed hashes of each ``GRAM`` words."""
    low = lambda x, y: F.least(x, y)
    return (
        df.withColumn("wh", F.transform("words", lambda w: F.xxhash64(w)))
        .withColumn("h2", _pairs(F.col("wh"), 1, F.col("wh"), _mixed))
        .withColumn("h4", _pairs(F.col("h2"), 2, F.col("h2"), _mixed))
        .withColumn("grams", _pairs(F.col("h4"), 4, F.col("h2"), _mixed))
        .withColumn("m2", _pairs(F.col("grams"), 1, F.col("grams"), low))
        .withColumn("m4", _pairs(F.col("m2"), 2, F.col("m2"), low))
        .withColumn("kept", F.array_distinct(_pairs(F.col("m4"), 4, F.col("grams"), low)))
        .drop("h2", "h4", "m2", "m4", "grams")
    )


def _runs_of(hashes: Column, n: Column | int) -> Column:
    """The hash of every n consecutive words."""
    n = F.lit(n) if isinstance(n, int) else n
    count = F.size(hashes) - n + 1
    return F.transform(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")), lambda i: F.xxhash64(F.slice(hashes, i, n)))


def _entry(n: Column | int) -> object:
    return lambda h: F.struct((F.lit(n) if isinstance(n, int) else n).cast("int").alias("n"), h.alias("hash"))


def _items(benchmark: DataFrame) -> DataFrame:
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    return with_grams(items).withColumn("n", F.least(F.size("words"), F.lit(WINDOW)))


def item_fingerprints(benchmark: DataFrame) -> DataFrame:
    """(n, hash): n = 0 for winnowed grams, else the words of a short item."""
    items = _items(benchmark)
    long = items.filter(F.col("n") == WINDOW).select(F.explode(F.transform("kept", _entry(0))).alias("x"))
    short = items.filter(F.col("n") < WINDOW).select(_entry(F.col("n"))(F.xxhash64("wh")).alias("x"))
    return long.union(short).select("x.n", "x.hash").distinct()


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(n, hash, item_id): every window of every item, n its words."""
    return _items(benchmark).select("item_id", F.explode(F.transform(_runs_of(F.col("wh"), F.col("n")), _entry(F.col("n")))).alias("x")).select("x.n", "x.hash", "item_id").distinct()


def _probes(docs: DataFrame, short: list[int]) -> DataFrame:
    """(doc_id, text_hash, n_words, probe): each row's fingerprints to look up, and (-1, 0) once for the row itself."""
    rows = with_grams(docs.withColumn("words", words(F.col("text"))))
    parts = [F.array(_entry(-1)(F.lit(0).cast("long"))), F.transform("kept", _entry(0))]
    parts += [F.array_distinct(F.transform(_runs_of(F.col("wh"), n), _entry(n))) for n in short]
    # The marker keeps the array from being empty; the outer form only keeps the optimizer
    # from computing all of it once more to drop empty ones.
    return rows.select("doc_id", "text_hash", F.size("words").alias("n_words"), F.explode_outer(F.concat(*parts)).alias("probe"))


def _of_rows(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Join of ``docs`` (doc_id, text) with the written ``keys`` (__id, __hash), broadcast where they are few."""
    few = keys.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(keys) if few else keys, docs["doc_id"].eqNullSafe(keys["__id"]) & (F.xxhash64(docs["text"]) == keys["__hash"]), how)


def _found(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written: the rows (doc_id, text_hash, n_words, copies); places (doc_id, text_hash, pos, n, hash) of windows in them; the items' windows."""
    sizes = benchmark.select(F.size(words(F.col("text"))).alias("n")).agg(F.sum("n").alias("n"), F.collect_set(F.when((F.col("n") > 0) & (F.col("n") < WINDOW), F.col("n"))).alias("short")).first()
    short, few = sorted(sizes["short"] or []), (sizes["n"] or 0) <= BROADCAST_WORDS
    prints, probes = item_fingerprints(benchmark), _probes(docs, short)
    if few:
        mark = docs.sparkSession.range(1).select(F.lit(-1).alias("n"), F.lit(0).cast("long").alias("hash"))
        prints = F.broadcast(prints.union(mark))
        met = probes.join(prints, (F.col("probe.n") == prints["n"]) & (F.col("probe.hash") == prints["hash"])).select("doc_id", "text_hash", "n_words", "n")
    else:
        prints = prints.select(F.struct("n", "hash").alias("probe"))
        hits = probes.filter("probe.n >= 0").join(prints, "probe", "left_semi")
        met = probes.filter("probe.n < 0").union(hits.select(*probes.columns)).select("doc_id", "text_hash", "n_words", F.col("probe.n").alias("n"))
    rows = met.groupBy("doc_id", "text_hash").agg(F.max("n_words").alias("n_words"), F.count_if(F.col("n") < 0).alias("copies"), F.max("n").alias("n"))
    rows = cut(rows.select("doc_id", "text_hash", "n_words", "copies", (F.col("n") >= 0).alias("hit")), "rows")

    windows = cut(item_windows(benchmark), "windows")
    keys = cut(rows.filter("hit").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")), "hits")
    some = _of_rows(docs, keys, "left_semi").withColumn("wh", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))
    at = lambda n: lambda h, i: F.struct(i.alias("pos"), F.lit(n).alias("n"), h.alias("hash"))
    runs = F.flatten(F.array(*[F.transform(_runs_of(F.col("wh"), n), at(n)) for n in (*short, WINDOW)]))
    looked = some.select("doc_id", "text_hash", F.explode(runs).alias("x")).select("doc_id", "text_hash", "x.*")
    known = windows.select("n", "hash").distinct()
    places = cut(looked.join(F.broadcast(known) if few else known, ["n", "hash"], "left_semi").distinct(), "places")
    return rows, places, windows


def _spans(places: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_hit, spans): the windows of each document, joined where they overlap or touch."""
    rows = places.select("doc_id", "text_hash", "pos", (F.col("pos") + F.col("n")).alias("end"))
    here = Window.partitionBy("doc_id", "text_hash").orderBy("pos", F.desc("end"))
    before = F.max("end").over(here.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.coalesce(F.col("pos") > before, F.lit(True)).cast("int"))
    spans = rows.withColumn("span", F.sum("new").over(here.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "text_hash", "span").agg(F.min("pos").alias("start"), F.max("end").alias("end"))
    return spans.groupBy("doc_id", "text_hash").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _listed(places: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, items): the ids of the items with a window in each document, as sorted strings."""
    pairs = places.select("doc_id", "text_hash", "n", "hash").distinct().join(windows.filter("item_id is not null"), ["n", "hash"])
    return pairs.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: its words, those inside a window of the benchmark, the items, and the spans."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    rows, places, windows = _found(docs, benchmark.select("item_id", "text"))
    hits = _spans(places).withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    listed = _listed(places, windows).withColumnsRenamed({"doc_id": "__id2", "text_hash": "__hash2"})
    hits = cut(hits.join(listed, hits["__id"].eqNullSafe(listed["__id2"]) & (hits["__hash"] == listed["__hash2"]), "left").drop("__id2", "__hash2"), "spans")
    out = rows.join(hits, rows["doc_id"].eqNullSafe(hits["__id"]) & (rows["text_hash"] == hits["__hash"]), "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        "text_hash",
    ).drop("copy")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark."""
    _, places, _ = _found(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), benchmark.select("item_id", "text"))
    return _of_rows(docs, cut(places.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "contaminated"), "left_anti")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "text_hash")


#: DuckDB: every window of every item, looked up among the runs of as many words of each document.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT row, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT row, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hit AS (
  SELECT dw.row, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win
), cover AS (
  SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY row
), items AS (
  SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT row, item_id::VARCHAR AS item_id FROM hit) GROUP BY row
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (row) LEFT JOIN items USING (row)
"""
