"""URL filters: a temporal join of captures with dated lists.

A list is a log of dated entries: on a day, an action ("add" or "remove") for a
host, with all hosts below it, or for a path prefix of a host.  A window over
each entry's log turns it into validity intervals ``[valid_from, valid_to)``; an
add that repeats an open one, or a remove of nothing, changes nothing.  A
capture is looked up under every key that could cover it, its host and the
domains above, each alone and with every prefix of its path, as far as the lists
have keys that long, and takes the intervals that hold its fetch time (the as-of join: of an entry's log, the
state at that time decides).  An "allow" list overrules "block" lists; within
each, the most specific key counts, and of equals the latest, then the list's name.

Only DataFrame functions run here.  The intervals are broadcast where they are
counted to be at most ``BROADCAST_ROWS``; otherwise captures are joined on salted keys,
so one host may hold any share of all captures.

Edge cases: a null or unparsable URL has no host and matches nothing; a null
fetch time matches nothing; repeated captures each give a row; entries without
key or day are ignored; equal days of one entry end with "remove"; empty tables
on either side give no match and no error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table

#: Intervals that are broadcast. They carry a digest of their key, not the key, so their rows stay small however long keys are.
BROADCAST_ROWS = 200_000
SALTS = 64


def host(url: Column) -> Column:
    """The lower-case host of a URL without port, user and leading "www."; null where there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", F.regexp_replace(found, r"^www\.", ""))


def path(url: Column) -> Column:
    """The path of a URL, without query and fragment; "/" where it is empty."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?", 1)
    return F.when(found == "", F.lit("/")).otherwise(found)


def keys(host: Column, path: Column, most_labels: int, most_parts: int) -> Column:
    """Every key of up to so many labels and path parts that covers a capture, with how specific it is: domains, then domains with path prefixes."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    first = F.greatest(n - F.lit(most_labels - 1), F.lit(1))
    domains = F.transform(F.sequence(first, n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    parts = F.array_remove(F.split(path, "/"), "")
    m = F.least(F.size(parts), F.lit(most_parts))
    prefixes = F.transform(F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
    alone = F.transform(domains, lambda d, i: F.struct(d.alias("key"), (n - first - i + 1).alias("labels"), F.lit(0).alias("parts")))
    below = F.flatten(F.transform(domains, lambda d, i: F.transform(prefixes, lambda p, j: F.struct(F.concat(d, p).alias("key"), (n - first - i + 1).alias("labels"), (j + 1).alias("parts")))))
    return F.concat(alone, below)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, key, valid_from, valid_to): when each entry was active; valid_to null is still active."""
    log = entries.filter("key is not null and day is not null and action in ('add', 'remove')").select("list", "kind", F.lower("key").alias("key"), "day", (F.col("action") == "add").alias("on"))
    # One state a day; on one day "remove" comes last.
    log = log.groupBy("list", "kind", "key", "day").agg(F.bool_and("on").alias("on"))
    window = Window.partitionBy("list", "kind", "key").orderBy("day")
    changes = log.withColumn("was", F.coalesce(F.lag("on").over(window), F.lit(False))).filter("on <> was")
    return changes.withColumn("valid_to", F.lead("day").over(window)).filter("on").select("list", "kind", "key", F.col("day").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, host, fetch_time, n_rules, rule (of the deciding entry), rule_list, blocked for each capture.

    ``captures``: page_id, url, fetch_time.
    """
    active = intervals(entries)
    # No key of a capture is longer than the longest listed one: what a capture costs follows the lists, not its URL.
    most = active.agg(F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\."))), F.max(F.size(F.split("key", "/")) - 1)).first()
    # xxhash64 tells repeated captures of one page apart only by their number, which the count below keeps.
    rows = captures.select("page_id", "url", "fetch_time").groupBy("page_id", "url", "fetch_time").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("host", host(F.col("url"))).withColumn("k", F.explode_outer(keys(F.col("host"), path(F.col("url")), max(most[0] or 1, 1), most[1] or 0)))
    rows = rows.select("page_id", "url", "fetch_time", "copies", "host", F.lower("k.key").alias("key"), "k.labels", "k.parts")
    # Joined by digest: the shuffled or broadcast intervals have a fixed width, and the capture knows the key itself.
    rows, active = rows.withColumn("digest", _digest("key")), active.withColumn("digest", _digest("key")).drop("key")
    if active.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(active), _holds(rows, active), "left")
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        spread = active.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(spread, _holds(salted, spread) & (salted["salt"] == spread["salt"]), "left")
    rule = F.struct((F.col("kind") == "allow").alias("allow"), F.col("parts"), F.col("labels"), F.col("valid_from"), F.col("list"), F.col("key"))
    best = joined.groupBy("page_id", "url", "fetch_time").agg(
        F.first("copies").alias("copies"),
        F.first("host").alias("host"),
        F.count(active["digest"]).alias("n_rules"),
        F.max(F.when(active["digest"].isNotNull(), rule)).alias("rule"),
    )
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "page_id",
        "host",
        "fetch_time",
        "n_rules",
        F.col("rule.key").alias("rule"),
        F.col("rule.list").alias("rule_list"),
        F.coalesce(~F.col("rule.allow"), F.lit(False)).alias("blocked"),
    )


def _digest(key: str) -> Column:
    return F.unhex(F.sha2(F.col(key).cast("binary"), 256))


def _holds(rows: DataFrame, active: DataFrame) -> Column:
    return (rows["digest"] == active["digest"]) & (rows["fetch_time"] >= active["valid_from"]) & (active["valid_to"].isNull() | (rows["fetch_time"] < active["valid_to"]))


#: The entries that the query adds to those it derives from the hosts it sees.
LIST_LOG = (
    ("spam", "block", "spam-farm.example.org", "add", "2024-01-10"),
    ("spam", "block", "spam-farm.example.org", "remove", "2024-05-01"),
    ("spam", "block", "spam-farm.example.org", "add", "2024-08-15"),
    ("regional", "block", "example.net/de", "add", "2024-03-01"),
    ("regional", "block", "example.net/de", "remove", "2024-09-01"),
    ("partners", "allow", "example.com/en", "add", "2024-06-01"),
    ("retired", "block", "example.com", "add", "2024-02-01"),
    ("retired", "block", "example.com", "remove", "2024-04-01"),
)


def dated_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time of their own: one hour apart through 2024, by page_id."""
    hours = F.pmod(F.col("page_id") * 7, F.lit(366 * 24))
    return pages.select("page_id", "url", F.timestamp_add("HOUR", hours.cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("fetch_time"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """A list log for the pages at hand: hosts added on one day and removed on a later one, both from their digests."""
    seen = pages.select(host(F.col("url")).alias("key")).filter("key is not null").distinct()
    byte = lambda at: F.conv(F.substring(F.md5(F.col("key").cast("binary")), at, 2), 16, 10).cast("int")
    start = F.lit("2024-01-01").cast("timestamp")
    added = F.timestamp_add("DAY", byte(1), start)
    removed = F.timestamp_add("DAY", byte(1) + byte(3), start)
    listed = seen.filter(byte(5) < 96)
    rows = [listed.select(F.lit("hosts").alias("list"), F.lit("block").alias("kind"), "key", F.lit(a).alias("action"), d.alias("day")) for a, d in (("add", added), ("remove", removed))]
    fixed = pages.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{d}', TIMESTAMP '{e}')" for a, b, c, d, e in LIST_LOG) + " AS t(list, kind, key, action, day)")
    return rows[0].union(rows[1]).union(fixed)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(dated_captures(pages), sample_entries(pages))


_LOG_SQL = ", ".join(f"('{a}', '{b}', '{c}', '{d}', TIMESTAMP '{e}')" for a, b, c, d, e in LIST_LOG)
#: DuckDB: the state of every entry at the fetch time is that of its last day up to then.
ORACLE = rf"""
WITH c AS (
  SELECT row_number() OVER () AS row, page_id, TIMESTAMP '2024-01-01' + to_hours(((page_id * 7) % 8784)::INT) AS fetch_time,
         nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', ''), '') AS host,
         coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?', 1), ''), '/') AS path
  FROM pages
), h AS (
  SELECT DISTINCT host AS key, ('0x' || md5(host)[1:2])::INT AS a, ('0x' || md5(host)[3:4])::INT AS b, ('0x' || md5(host)[5:6])::INT AS x FROM c WHERE host IS NOT NULL
), log AS (
  SELECT 'hosts' AS list, 'block' AS kind, key, 'add' AS action, TIMESTAMP '2024-01-01' + to_days(a) AS day FROM h WHERE x < 96
  UNION ALL SELECT 'hosts', 'block', key, 'remove', TIMESTAMP '2024-01-01' + to_days(a + b) FROM h WHERE x < 96
  UNION ALL SELECT * FROM (VALUES {_LOG_SQL})
), ranked AS (
  SELECT c.row, log.list, log.kind, log.key, log.action, log.day,
         row_number() OVER (PARTITION BY c.row, log.list, log.kind, log.key ORDER BY log.day DESC, log.action DESC) AS rn
  FROM c JOIN log ON (
    (c.host = log.key OR ends_with(c.host, '.' || log.key))
    OR (strpos(log.key, '/') > 0
        AND (c.host = split_part(log.key, '/', 1) OR ends_with(c.host, '.' || split_part(log.key, '/', 1)))
        AND starts_with(lower(c.path) || '/', '/' || substr(log.key, strpos(log.key, '/') + 1) || '/'))
  ) AND log.day <= c.fetch_time
), on_now AS (
  SELECT r.row, r.list, r.kind, r.key,
         (SELECT max(l.day) FROM log l WHERE l.list = r.list AND l.kind = r.kind AND l.key = r.key AND l.action = 'add' AND l.day <= r.day) AS since
  FROM ranked r WHERE rn = 1 AND action = 'add'
), best AS (
  SELECT row, list, kind, key, count(*) OVER (PARTITION BY row) AS n,
         row_number() OVER (PARTITION BY row ORDER BY (kind = 'allow') DESC, len(key) - len(replace(key, '/', '')) DESC,
                            len(split_part(key, '/', 1)) - len(replace(split_part(key, '/', 1), '.', '')) DESC, since DESC, list DESC, key DESC) AS rn
  FROM on_now
)
SELECT c.page_id, c.host, c.fetch_time, coalesce(b.n, 0)::BIGINT AS n_rules, b.key AS rule, b.list AS rule_list, coalesce(b.kind = 'block', FALSE) AS blocked
FROM c LEFT JOIN best b ON c.row = b.row AND b.rn = 1
"""
