"""A content-addressed WARC archive.

The archive is two tables.  ``payloads`` holds the bytes of each distinct payload
once, by its SHA-256, with its SHA-1 and length.  ``headers`` holds a record for
each capture: the exact header block of its WARC record and the digest of the
payload it stands for.  Of captures with one payload the one with the smallest
page_id is the response, the others are revisits that name it.

Reading back verifies every stored payload against its digest, parses the
header blocks, and joins the two.  ``reconstruct`` gives whole records again;
``export`` writes them as .warc files.

Edge cases: a null payload is an empty one; payloads shorter than ``least`` bytes
are all responses; repeated rows of one page_id each have a record, and those
of the smallest page_id are responses alike; an empty table gives an empty archive.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, join_groups, shared_dir, table

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
#: The digits that conv() writes for base 32 and those of RFC 4648.
_CONV, _RFC = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of bytes in upper-case base 32: 5 hex digits are 4 of base 32."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), _CONV, _RFC)


def _payload(pages: DataFrame) -> Column:
    return F.coalesce(pages["html"].cast("string").cast("binary"), F.lit("").cast("binary"))


def records(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Each page with the digests of its payload, its record type and the page it refers to; no payload."""
    payload = _payload(pages)
    rows = pages.select("page_id", "url", F.sha2(payload, 256).alias("digest"), base32_sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    rows = cut(rows, "captures")
    groups = rows.filter(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = join_groups(rows, groups, "digest")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first_id"))).drop("first_id")


def _record_id(page_id: Column) -> Column:
    """A stable urn:uuid of a page."""
    h = F.md5(F.concat(F.lit("page:"), page_id.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def header_block() -> Column:
    """The header of a record, up to and with its empty line."""
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.coalesce(_record_id(F.col("page_id")), F.lit("<urn:uuid:00000000-0000-0000-0000-000000000000>"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.coalesce(F.regexp_replace("url", r"[\r\n]", ""), F.lit(""))),
        line("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("X-Payload-SHA256", F.col("digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", _record_id(F.col("refers_to"))), line("X-Refers-To-Page", F.col("refers_to").cast("string")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, least: int = LEAST_BYTES) -> None:
    """Write the two tables under ``path``: every header, and every distinct payload once."""
    records(pages, least).select("digest", header_block().alias("header")).write.parquet(f"{path}/headers")
    payload = _payload(pages)
    pages.select(F.sha2(payload, 256).alias("digest"), payload.alias("payload")).dropDuplicates(["digest"]).write.parquet(f"{path}/payloads")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads of an archive; a payload that doesn't have its digest is an error."""
    stored = spark.read.parquet(f"{path}/payloads")
    whole = F.sha2("payload", 256) == F.col("digest")
    return stored.withColumn("digest", F.when(whole, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload damaged: "), F.col("digest")))))


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("header", rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """The record headers of an archive, exact and parsed."""
    return spark.read.parquet(f"{path}/headers").select(
        "header",
        "digest",
        _field("X-Page-ID").cast("long").alias("page_id"),
        F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        _field("WARC-Type").alias("record_type"),
        _field("X-Refers-To-Page").cast("long").alias("refers_to"),
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, as read back.

    Length and SHA-1 come from the stored bytes; only these, not the bytes,
    meet the headers.  A header that disagrees is an error.
    """
    stored = payloads(spark, path).select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("sha1"))
    joined = headers(spark, path).join(stored, "digest", "left")
    agrees = F.coalesce(F.col("sha1") == F.col("payload_digest"), F.lit(False))
    return joined.select("page_id", "payload_bytes", F.when(agrees, F.col("sha1")).otherwise(F.raise_error(F.concat(F.lit("record damaged: "), F.col("header")))).alias("payload_digest"), "record_type", "refers_to")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """page_id, header, the record's block (empty for revisits), and the payload that it stands for."""
    joined = headers(spark, path).join(payloads(spark, path), "digest", "left")
    return joined.select("page_id", "header", F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary")).alias("block"), "payload")


def export(spark: SparkSession, path: str, out: str) -> None:
    """Write an archive of text payloads as .warc files: records end with two line breaks."""
    rows = reconstruct(spark, path)
    rows.select(F.concat(F.col("header"), F.col("block").cast("string"))).write.option("lineSep", CRLF * 2).text(out)


def parse_records(data: bytes):
    """The (header, block) pairs of a .warc file's bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        header = data[at:end].decode()
        size = next(int(x[15:]) for x in header.split(CRLF) if x.lower().startswith("content-length:"))
        yield header, data[end : end + size]
        at = end + size + 4


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """header and block of every record of the .warc files under ``path``."""
    import pyarrow as pa

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                found = list(parse_records(content.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()), pa.array([b for _, b in found], pa.binary())], names=["header", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "header string, block binary")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tessera/warc-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path)


#: DuckDB: base 32 from the 160 bits of the hex digest, five at a time.
ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), r AS (
  SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY body) AS first_id,
         list_reduce(list_transform(range(1, 41, 5), lambda i:
           list_reduce(list_transform([32768, 1024, 32, 1], lambda q: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || hex[i : i + 4])::BIGINT // q) % 32 + 1, 1)), lambda x, y: x || y)), lambda x, y: x || y) AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM r
"""
