"""One object over a document world: search, facts, graph, SQL, plans."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import kg
from tessera.functions.vectors import hash_embedding
from tessera.operators import evidence as etl
from tessera.operators import graph, index, relational, resolve, search
from tessera.plans import sql, verify
from tessera.plans.compile import compile_plan
from tessera.plans.ir import QueryPlan, parse
from tessera.sources import readers, workbook, writers
from tessera.sources.schema import KEYS, TABLES
from tessera.sources.scratch import cut

#: From fragments (document_id, batch, evidence_id, text) to answers (document_id, batch, answer JSON).
Extractor = Callable[[DataFrame], DataFrame]


class Engine:
    """A world, as tables of a session or kept under a folder."""

    def __init__(self, spark: SparkSession, world: kg.World, root: str | None = None, embed: index.Embedder = hash_embedding, extractor: Extractor | None = None):
        self.spark, self.world, self.root, self.embed, self.extractor = spark, world, root, embed, extractor

    @classmethod
    def open(cls, spark: SparkSession, root: str, **options: Any) -> Engine:
        """The world that ``build`` keeps under a folder; missing tables are empty."""
        tables = {name: writers.keyed(spark, root, name) for name in TABLES}
        tables = {n: t if t is not None else spark.createDataFrame([], TABLES[n]) for n, t in tables.items()}
        world = kg.World(entities=tables["entities"], relationships=tables["relationships"], attributes=tables["attributes"], evidence=tables["evidence"], facts=tables["facts"], mentions=tables["mentions"])
        return cls(spark, world, root, **options)

    @classmethod
    def build(cls, spark: SparkSession, results: str, root: str, force: bool = False, document_index: str | None = None) -> Engine:
        """Evidence and facts of an extraction result; documents that didn't change are skipped."""
        documents, failures = readers.extraction(spark, results)
        return cls._take_in(documents, failures, root, force, document_index)

    @classmethod
    def ingest(cls, spark: SparkSession, folder: str, root: str, force: bool = False, document_index: str | None = None) -> Engine:
        """The readable files below a folder, read, and built into evidence and facts."""
        documents, failures = workbook.extract(readers.files(spark, folder))
        path = f"{root}/extraction"
        # Read once: files are parsed for every use of a plan that isn't written.
        documents.write.mode("overwrite").parquet(f"{path}/documents")
        failures.write.mode("overwrite").parquet(f"{path}/failures")
        documents = spark.read.parquet(f"{path}/documents").withColumn("workbook_id", F.col("document_id"))
        return cls._take_in(documents, spark.read.parquet(f"{path}/failures"), root, force, document_index)

    @classmethod
    def _take_in(cls, documents: DataFrame, failures: DataFrame, root: str, force: bool, document_index: str | None) -> Engine:
        spark = documents.sparkSession
        documents = documents.withColumn("document_id", F.coalesce("document_id", "workbook_id")).withColumn("checksum", F.sha2(F.to_json(F.struct("pages", "sheets")).cast("binary"), 256))
        if document_index:
            documents = readers.with_document_type(documents, readers.document_index(spark, document_index))
        state = writers.keyed(spark, root, "state")
        fresh = documents if force or state is None else etl.unchanged(documents, state)
        found = etl.build_evidence(fresh).persist()
        facts = etl.build_facts(found)
        if fresh.limit(1).count():
            writers.upsert(fresh.select("document_id", "filename", "source_path", "document_type", "checksum"), root, "documents", "document_id")
            writers.upsert(found.drop("page_text"), root, "evidence", "evidence_id")
            writers.upsert(facts, root, "facts", "fact_id")
            writers.upsert(fresh.select("document_id", "checksum"), root, "state", "document_id")
        found.unpersist()
        engine = cls.open(spark, root)
        counts = etl.report(documents, engine.world.evidence, engine.world.facts)
        writers.write_report(counts.crossJoin(failures.agg(F.count("*").alias("documents_failed"))), f"{root}/report")  # one row each
        return engine

    def refresh_index(self) -> int:
        """Embed what the stored vector index doesn't hold yet; the number of texts embedded."""
        return index.refresh(self._rows(), self.root, self.embed)

    def extract_documents(self, documents: DataFrame, batch_size: int = 30) -> Engine:
        """Let the extractor read some documents (document_id); those it has read before are skipped."""
        if self.extractor is None:
            raise ValueError("there is no extractor")
        covered = writers.keyed(self.spark, self.root, "covered")
        ids = documents.select("document_id").distinct()
        ids = ids if covered is None else ids.join(covered, "document_id", "left_anti")
        ids = cut(ids.join(self.world.evidence.select("document_id").distinct(), "document_id", "left_semi"), "to_read")
        if not ids.limit(1).count():
            return self if covered is None else Engine.open(self.spark, self.root, embed=self.embed, extractor=self.extractor)
        fragments = etl.batches(self.world.evidence.join(ids, "document_id", "left_semi"), batch_size)
        # Answers are written before they are used: a model is asked once.
        engine = self.extend(cut(self.extractor(fragments.select("document_id", "batch", "evidence_id", "text")), "answers"))
        writers.upsert(ids, self.root, "covered", "document_id")
        return engine

    def extend(self, assertions: DataFrame) -> Engine:
        """Add what an extractor says (document_id, batch, answer JSON); again the same answers change nothing."""
        parsed = etl.parse_assertions(assertions)
        found = etl.mentions(parsed, self.world.evidence)
        entities = resolve.resolve_or_create(found)
        owner = entities.select("entity_id", F.explode("mention_ids").alias("mention_id"))
        found = found.join(owner, "mention_id")
        edges, attributes = etl.linked(parsed, found)
        for rows, name in ((found.drop("batch"), "mentions"), (entities, "entities"), (edges, "relationships"), (attributes, "attributes")):
            writers.upsert(rows, self.root, name, KEYS[name])
        return Engine.open(self.spark, self.root, embed=self.embed, extractor=self.extractor)

    # Search

    def _rows(self) -> DataFrame:
        return search.candidates(self.world.evidence, self.world.facts)

    def search_evidence(self, query: str, limit: int = 10, mode: str = "normalized") -> DataFrame:
        return search.hybrid(self._rows(), query, limit, mode)

    def lexical_search(self, query: str, limit: int = 10) -> DataFrame:
        return search.fuzzy(self._rows(), query, limit)

    def semantic_search(self, query: str, limit: int = 10) -> DataFrame:
        """The nearest texts: of the stored index where there is one, else embedded here."""
        rows = index.stored(self.spark, self.root)
        return index.nearest(self._rows().withColumn("embedding", self.embed(F.col("text"))) if rows is None else rows, query, limit, self.embed)

    def hybrid_search(self, query: str, limit: int = 10) -> DataFrame:
        return search.hybrid(self._rows(), query, limit, nodes=self.world.entities)

    def discover_evidence(self, query: str, limit: int = 15) -> DataFrame:
        return search.discover(search.hybrid(self._rows(), query, max(4 * limit, 40)), limit)

    def check_evidence_support(self, query: str, evidence_id: str) -> DataFrame:
        return search.supports(search.fuzzy(self._rows(), query, 5), evidence_id)

    # Entities and the graph

    def search_entities(self, query: str, limit: int = 10) -> DataFrame:
        return search.fuzzy(self.world.entities, query, limit, 1e-9, "name", "entity_id")

    def resolve_entity(self, query: str, entity_type: str | None = None) -> DataFrame:
        return resolve.resolve_text(self.world.entities, query, entity_type, nodes=self.world.entities)

    def get_entity(self, entity_id: str, shown: int = 100) -> DataFrame:
        """The entity, how many edges lead out and in, and the ids of the first of either; ``get_relationships`` has all."""
        edges = self.get_relationships(entity_id)
        sides = edges.agg(F.count_if(F.col("subject_id") == entity_id).alias("n_out"), F.count_if(F.col("object_id") == entity_id).alias("n_in"))
        found = self.world.entities.filter(F.col("entity_id") == entity_id).crossJoin(sides)  # one row
        if "relationship_id" in edges.columns:
            for side, name in (("subject_id", "out_ids"), ("object_id", "in_ids")):
                # At most ``shown`` ids, taken before they are gathered.
                some = edges.filter(F.col(side) == entity_id).select("relationship_id").orderBy("relationship_id").limit(shown)
                found = found.crossJoin(some.agg(F.sort_array(F.collect_list("relationship_id")).alias(name)))  # one row
        return found

    def get_relationships(self, entity_id: str) -> DataFrame:
        return self.world.relationships.filter((F.col("subject_id") == entity_id) | (F.col("object_id") == entity_id))

    def traverse_graph(self, entities: DataFrame, predicate: str | None = None, direction: str = "both", depth: int = 1) -> DataFrame:
        if depth == 1:
            return graph.one_hop(self.world.relationships, entities, direction, relational.near_names(self.world, "relationships", predicate))
        return graph.k_hop(self.world.relationships, entities, depth)

    def traverse_edges(self, entities: DataFrame, predicate: str | None = None, direction: str = "both") -> DataFrame:
        """The edges of one hop, with their own ids, predicates and evidence."""
        return graph.hop_edges(self.world.relationships, entities, direction, relational.near_names(self.world, "relationships", predicate))

    def find_path(self, start: str, end: str) -> DataFrame:
        return graph.shortest_path(self.world.relationships, start, end)

    def enumerate_population(self, entity_type: str, predicate: str | None = None, anchors: DataFrame | None = None, direction: str = "in") -> DataFrame:
        return relational.enumerate_population(self.world, entity_type, predicate, anchors, direction)

    def get_attribute(self, entities: DataFrame, predicate: str, subject_scoped: bool = False) -> DataFrame:
        return relational.get_attribute(self.world, entities, predicate, subject_scoped)

    # Facts, evidence, coverage

    def get_facts(self, document_id: str | None = None, predicate: str | None = None) -> DataFrame:
        rows = self.world.facts
        rows = rows if document_id is None else rows.filter(F.col("document_id") == document_id)
        return rows if predicate is None else rows.filter(F.col("predicate") == predicate)

    def get_evidence(self, evidence_id: str) -> DataFrame:
        return self.world.evidence.filter(F.col("evidence_id") == evidence_id)

    def get_provenance(self, entity_id: str | None = None, relationship_id: str | None = None, evidence_id: str | None = None, fact_id: str | None = None) -> DataFrame:
        return relational.provenance(self.world, entity_id, relationship_id, evidence_id, fact_id)

    def get_coverage(self) -> DataFrame:
        return relational.coverage(self.world, self.world.evidence.select("document_id").distinct(), index.stored(self.spark, self.root))

    def evidence_text(self, evidence_id: str) -> DataFrame:
        """(evidence_id, text): the text of a fragment, or its raw value where it has none."""
        return self.get_provenance(evidence_id=evidence_id).select("evidence_id", "text")

    def check_completeness(self, entity_type: str, expected_min: int | None = None, anchor_query: str | None = None) -> DataFrame:
        return relational.completeness(self.world, entity_type, expected_min, self.discover_evidence(anchor_query, 50) if anchor_query else None)

    def calculate(self, values: Sequence[float | None], operation: str) -> float | None:
        """An operation on a few numbers, nulls dropped; the same rules as over columns."""
        rows = self.spark.createDataFrame([(None if v is None else float(v),) for v in values], "value double").filter("value is not null")
        if operation in relational.AGGREGATES:
            return rows.agg(relational.AGGREGATES[operation](F.col("value")).alias("x")).first()["x"]
        kept = [F.lit(float(v)) for v in values if v is not None]
        return self.spark.range(1).select(relational.compute(operation, kept).alias("x")).first()["x"]

    # SQL and plans

    def views(self) -> None:
        """Register the world's tables as views."""
        for name in ("entities", "relationships", "attributes", "facts", "mentions", "evidence"):
            rows = getattr(self.world, name)
            if rows is not None:
                rows.createOrReplaceTempView(name)

    def query_duckdb(self, sql: str, params: Sequence[Any] | Mapping[str, Any] | None = None) -> DataFrame:
        """``query_sql`` under the name that tool callers know."""
        return self.query_sql(sql, params)

    def query_sql(self, text: str, args: Sequence[Any] | Mapping[str, Any] | None = None) -> DataFrame:
        self.views()
        return sql.select(self.spark, text, args)

    def schema_context(self) -> dict[str, list[str]]:
        """The entity types and predicates that a planner may use."""
        types = sorted(r["entity_type"] for r in self.world.entities.select("entity_type").distinct().collect())
        return {"entity_types": types, "predicates": sorted({*self.world.names("relationships"), *self.world.names("attributes"), *self.world.names("facts")})}

    def run_plan(self, plan: QueryPlan | dict | str) -> DataFrame:
        plan = plan if isinstance(plan, QueryPlan) else parse(plan)
        return compile_plan(plan, self.grown(plan).world)[plan.final].df

    def grown(self, plan: QueryPlan) -> Engine:
        """This engine after the extractor has read what the plan's DISCOVER steps find; itself without an extractor."""
        engine = self
        for op in plan.operations:
            if op.op_type == "DISCOVER" and self.extractor is not None:
                found = engine.discover_evidence(op.params["query"], op.params.get("limit", 15))
                engine = engine.extract_documents(found, op.params.get("batch_size", 30))
        return engine

    def ask(self, question: str, planner: verify.Planner | None = None, iterations: int = 3, evidence_limit: int = 30) -> verify.Answer:
        return verify.ask(question, self.world, planner, iterations, self.schema_context() if planner else None, evidence_limit)

    def call(self, tool: str, **params: Any) -> Any:
        """A tool by name; a name that isn't one, or wrong parameters, give an error and no exception."""
        if tool.startswith("_") or tool in ("call", "open", "build") or not callable(getattr(self, tool, None)):
            return {"error": f"no tool {tool}"}
        try:
            return getattr(self, tool)(**params)
        except (TypeError, ValueError) as error:
            return {"error": str(error)}

    def answer_all(self, questions: DataFrame, planner: verify.Planner, path: str) -> None:
        """Answer a list of questions and write the submission; unresolved ones are 0."""
        rows = []
        for q in questions.select("qid", "question", "answer_type").collect():
            found = self.ask(q["question"], planner)
            number = found.count if found.count is not None and q["answer_type"] == "count" else found.value
            rows.append((q["qid"], verify.answer_number(self.spark, number, q["answer_type"]), q["answer_type"]))
        writers.write_submission(self.spark.createDataFrame(rows, "question_id string, value double, answer_type string"), path)
