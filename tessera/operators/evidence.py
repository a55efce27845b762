"""From extraction results to evidence and facts, and from assertions to a world."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import facts as rules
from tessera.functions import normalize
from tessera.functions.bind import let
from tessera.functions.text import normalize_text
from tessera.sources.schema import ASSERTIONS, LOCATION

VERSION = "1.0"


def _place(**fields: Column) -> Column:
    """A location struct; fields that its kind doesn't have are null."""
    parts = [p.split(":", 1) for p in LOCATION[7:-1].split(",")]
    return F.struct(*[fields.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in parts])


_COLUMNS = ("evidence_id", "source_type", "document_id", "source_path", "filename", "extraction_method", "raw_value", "text", "formula", "note", "location", "page_text")


def block_evidence(documents: DataFrame) -> DataFrame:
    """One row per block of every page."""
    pages = documents.select("document_id", "source_path", "filename", F.explode("pages").alias("p"))
    blocks = pages.select("document_id", "source_path", "filename", "p.page_number", F.col("p.text").alias("page_text"), F.explode("p.blocks").alias("b"))
    c = F.col("b.coordinates")
    bbox = F.array(*[F.coalesce(c[k], F.lit(0.0)) for k in ("x0", "y0", "x1", "y1")])
    made = rules.stable_hex(F.col("document_id"), F.col("source_path"), F.lit("pdf"), F.col("page_number"), F.coalesce("b.block_id", F.lit("")), F.coalesce("b.text", F.lit("")), F.lit(VERSION))
    return blocks.select(made.alias("evidence_id"), F.lit("pdf").alias("source_type"), "document_id", "source_path", "filename", F.lit("native_text").alias("extraction_method"), F.coalesce("b.text", F.lit("")).alias("raw_value"), F.coalesce("b.text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("formula"), F.lit(None).cast("string").alias("note"), _place(source_type=F.lit("pdf"), page_number=F.col("page_number"), block_id=F.coalesce("b.block_id", F.lit("")), bbox=bbox).alias("location"), "page_text")


def cell_evidence(documents: DataFrame) -> DataFrame:
    """One row per cell of every sheet."""
    sheets = documents.select("document_id", "source_path", "filename", F.explode("sheets").alias("s"))
    cells = sheets.select("document_id", "source_path", "filename", "s.workbook_id", "s.sheet_name", F.explode("s.cells").alias("c"))
    made = rules.stable_hex(F.col("document_id"), F.col("source_path"), F.lit("xlsx"), F.col("workbook_id"), F.col("sheet_name"), F.col("c.cell_address"), F.col("c.value"), F.col("c.formula"), F.lit(VERSION))
    place = _place(source_type=F.lit("xlsx"), workbook_id=F.col("workbook_id"), sheet_name=F.col("sheet_name"), cell_address=F.col("c.cell_address"), row=rules.row_number(F.col("c.cell_address")), column=rules.column_index(F.col("c.cell_address")))
    return cells.select(made.alias("evidence_id"), F.lit("xlsx").alias("source_type"), "document_id", "source_path", "filename", F.lit("native_workbook").alias("extraction_method"), F.col("c.value").alias("raw_value"), F.lit(None).cast("string").alias("text"), F.col("c.formula").alias("formula"), F.col("c.note").alias("note"), place.alias("location"), F.lit(None).cast("string").alias("page_text"))


def build_evidence(documents: DataFrame) -> DataFrame:
    """All fragments of extracted documents, once each."""
    return block_evidence(documents).select(*_COLUMNS).union(cell_evidence(documents).select(*_COLUMNS)).dropDuplicates(["evidence_id"])


def _is_text(value: Column) -> Column:
    return value.isNotNull() & value.try_cast("double").isNull() & (F.trim(value) != "")


def with_predicate(evidence: DataFrame) -> DataFrame:
    """``evidence`` with the predicate that its place gives its value, or null, and the value to normalize.

    A cell takes the header of its column: the text in row 1 of its sheet.  A
    block takes the label before it on its page, or its own "label: value".
    """
    place = F.col("location")
    sheet = Window.partitionBy("document_id", "source_type", place["sheet_name"], place["column"])
    header = F.max(F.when((F.col("source_type") == "xlsx") & (place["row"] == 1) & _is_text(F.col("raw_value")), F.trim("raw_value"))).over(sheet)
    cells = evidence.filter("source_type = 'xlsx'").withColumn("header", header)
    named = let(rules.header_predicate(F.col("header")), lambda n: F.when(rules.predicate_accepts(n, F.col("raw_value")), n))
    cell = let(named, lambda n: F.when(F.col("formula").isNotNull(), F.coalesce(n, F.lit("computed_value"))).when(place["row"] > 1, n))
    blocks = evidence.filter("source_type <> 'xlsx'").withColumn("header", F.lit(None).cast("string"))
    raw = F.trim(F.coalesce("raw_value", F.lit("")))
    before = F.when(raw != "", rules.header_predicate(rules.label_before(F.coalesce("page_text", F.lit("")), raw)))
    label, value = F.regexp_extract(raw, r"^([^:]*):(?s)(.*)$", 1), F.trim(F.regexp_extract(raw, r"(?s)^([^:]*):(.*)$", 2))
    own = F.when(value != "", rules.header_predicate(label))
    return cells.withColumn("predicate", cell).withColumn("to_normalize", F.col("raw_value")).unionByName(blocks.withColumn("predicate", F.coalesce(before, own)).withColumn("to_normalize", F.when(before.isNull() & own.isNotNull(), value).otherwise(F.col("raw_value"))))


def build_facts(evidence: DataFrame) -> DataFrame:
    """Typed facts of all evidence with a predicate; text is a valid value of itself."""
    found = with_predicate(evidence).filter("predicate is not null and raw_value is not null")
    found = found.withColumn("r", normalize.infer(F.col("to_normalize"))).filter("r.type is not null or trim(raw_value) <> ''")
    kind = F.coalesce("r.type", F.lit("text"))
    made = rules.stable_hex(F.col("evidence_id"), F.col("predicate"), F.col("raw_value"), F.lit(VERSION))
    return found.select(
        made.alias("fact_id"),
        "evidence_id",
        "document_id",
        "source_path",
        F.lit(None).cast("string").alias("subject_mention"),
        "predicate",
        "raw_value",
        F.coalesce("r.value", F.trim("raw_value")).alias("normalized_value"),
        F.col("r.number").alias("value_number"),
        F.col("r.day").alias("value_date"),
        kind.alias("normalized_type"),
        F.col("r.unit").alias("normalized_unit"),
        "extraction_method",
        F.when(kind == "text", "none").otherwise("deterministic").alias("normalization_method"),
        F.lit(1.0).alias("confidence"),
        F.lit("valid").alias("validation_status"),
        "location",
    )


def unchanged(documents: DataFrame, state: DataFrame) -> DataFrame:
    """The documents (document_id, checksum, ...) that the state doesn't have with this checksum."""
    return documents.join(state.select("document_id", "checksum").distinct(), ["document_id", "checksum"], "left_anti")


def conflicting(facts: DataFrame) -> DataFrame:
    """(document_id, predicate, n_values) where a document states several values."""
    return facts.groupBy("document_id", "predicate").agg(F.count_distinct("normalized_value").alias("n_values")).filter("n_values > 1")


def report(documents: DataFrame, evidence: DataFrame, facts: DataFrame) -> DataFrame:
    """One row of counts over a build."""
    return (
        documents.agg(F.count("*").alias("documents_processed"))
        .crossJoin(evidence.agg(F.count("*").alias("evidence_created")))
        .crossJoin(facts.agg(F.count("*").alias("facts_created"), F.count_if(F.col("normalized_type") != "text").alias("normalization_successes"), F.count_if(F.col("normalized_type") == "text").alias("unsupported_values")))
        .crossJoin(conflicting(facts).agg(F.count("*").alias("conflicting_facts")))  # one row each
    )


def batches(evidence: DataFrame, size: int = 30) -> DataFrame:
    """``evidence`` with its batch within its document: consecutive fragments, in reading order where a ``position`` tells it."""
    order = ["position", "evidence_id"] if "position" in evidence.columns else ["evidence_id"]
    window = Window.partitionBy("document_id").orderBy(*order)
    return evidence.withColumn("batch", F.floor((F.row_number().over(window) - 1) / size))


def parse_assertions(answers: DataFrame, column: str = "answer") -> DataFrame:
    """``answers`` (document_id, batch, answer JSON) parsed; items with a confidence outside 0 to 1 are dropped, bad JSON is null."""
    parsed = answers.withColumn("a", F.from_json(F.col(column), ASSERTIONS))
    good = lambda items: F.filter(items, lambda x: x["confidence"].between(0, 1))
    return parsed.select("document_id", "batch", *[good(F.col(f"a.{k}")).alias(k) for k in ("entities", "relationships", "attributes")], F.col("a").isNull().alias("failed"))


def mentions(assertions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Mentions of parsed assertions, each with its evidence: the one it names, else its batch's first."""
    firsts = batches(evidence).groupBy("document_id", "batch").agg(F.min("evidence_id").alias("first_evidence"))
    rows = assertions.select("document_id", "batch", F.explode("entities").alias("e")).select("document_id", "batch", "e.*")
    rows = rows.join(evidence.select("document_id", F.col("evidence_id").alias("source_ref"), F.col("evidence_id").alias("named")), ["document_id", "source_ref"], "left").join(firsts, ["document_id", "batch"], "left")
    at = F.coalesce("named", "first_evidence")
    return rows.select(rules.stable_hex(F.lit("mention"), F.col("document_id"), at, F.col("entity_type"), F.col("mention_text")).alias("mention_id"), "mention_text", "entity_type", "document_id", "batch", at.alias("evidence_id"), "confidence").dropDuplicates(["mention_id"])


def linked(assertions: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relationships and attributes between entities; those whose mention isn't in the batch are dropped.

    ``found``: mentions with their entity_id.
    """
    key = found.select("document_id", "batch", normalize_text(F.col("mention_text")).alias("k"), "entity_id").dropDuplicates(["document_id", "batch", "k"])
    r = assertions.select("document_id", "batch", F.explode("relationships").alias("r")).select("document_id", "batch", "r.*", normalize_text(F.col("r.subject_mention_text")).alias("ks"), normalize_text(F.col("r.object_mention_text")).alias("ko"))
    s, o = (key.withColumnRenamed("k", k).withColumnRenamed("entity_id", i) for k, i in (("ks", "subject_id"), ("ko", "object_id")))
    edges = r.join(s, ["document_id", "batch", "ks"]).join(o, ["document_id", "batch", "ko"])
    edges = edges.select(rules.stable_hex(F.col("subject_id"), F.col("object_id"), F.col("predicate"), F.col("source_ref")).alias("relationship_id"), "subject_id", "predicate", "object_id", F.col("source_ref").alias("evidence_id"), "document_id", "confidence").dropDuplicates(["relationship_id"])
    a = assertions.select("document_id", "batch", F.explode("attributes").alias("a")).select("document_id", "batch", "a.*", normalize_text(F.col("a.subject_mention_text")).alias("ks"))
    typed = a.join(s, ["document_id", "batch", "ks"]).withColumn("r", normalize.infer(F.col("value")))
    values = typed.select(rules.stable_hex(F.col("subject_id"), F.col("predicate"), F.col("value"), F.col("source_ref")).alias("attribute_id"), F.col("subject_id").alias("entity_id"), "predicate", "value", F.col("r.number").alias("value_number"), F.col("r.day").alias("value_date"), "value_type", F.col("source_ref").alias("evidence_id"), "document_id", "confidence").dropDuplicates(["attribute_id"])
    return edges, values
