"""Plans, the golden scenario, ETL, storage, SQL and streams."""

import dataclasses
import hashlib
import itertools
import json
import math
import re
import struct

import pytest
from pyspark.sql import functions as F

from tessera import kg
from tessera.engine import Engine
from tessera.operators import evidence as etl
from tessera.operators import graph, relational, resolve, search
from tessera.plans import sql, verify
from tessera.plans.ir import PlanError, parse
from tessera.sources import readers, writers
from tessera.streaming import ingest

NUMBER = "decimal(38,6)"


@pytest.fixture(scope="module")
def golden(spark):
    """Three bridges, two of one authority; one has a fact that differs from its attribute."""
    names = {"alpha": ("Bridge Alpha", "project"), "beta": ("Bridge Beta", "project"), "gamma": ("Bridge Gamma", "project"), "metro": ("Metro Authority", "client"), "other": ("Other Authority", "client")}
    entities = spark.createDataFrame([(i, t, n, [n], [f"m-{i}"], 1.0, "resolved") for i, (n, t) in names.items()], "entity_id string, entity_type string, name string, aliases array<string>, mention_ids array<string>, confidence double, status string")
    edges = spark.createDataFrame([("alpha", "commissioned_by", "metro", "e1"), ("beta", "commissioned_by", "metro", "e3"), ("gamma", "commissioned_by", "other", "e5")], "subject_id string, predicate string, object_id string, evidence_id string")
    attributes = spark.createDataFrame([("alpha", "contract_value", "100000000", 100000000, "e2"), ("beta", "contract_value", "200000000", 200000000, "e4"), ("gamma", "contract_value", "999999999", 999999999, "e6")], "entity_id string, predicate string, value string, value_number long, evidence_id string").select("entity_id", "predicate", "value", F.col("value_number").cast(NUMBER), F.lit(None).cast("date").alias("value_date"), "evidence_id")
    facts = spark.createDataFrame([("f1", "e2", "PKG-ALPHA", "contract_value", "15 Cr", 150000000)], "fact_id string, evidence_id string, document_id string, predicate string, raw_value string, value_number long").select("fact_id", "evidence_id", "document_id", "predicate", "raw_value", F.col("value_number").cast(NUMBER), F.lit(None).cast("date").alias("value_date"), F.lit("valid").alias("validation_status"), F.lit(None).cast("string").alias("subject_mention"))
    mentions = spark.createDataFrame([("m-alpha", "alpha", "PKG-ALPHA", "Bridge Alpha"), ("m-beta", "beta", "PKG-BETA", "Bridge Beta")], "mention_id string, entity_id string, document_id string, mention_text string")
    evidence = spark.createDataFrame([(f"e{i}", d, t) for i, (d, t) in enumerate([("PKG-ALPHA", "Asha Nair led the project Bridge Alpha."), ("PKG-ALPHA", "Bridge Alpha was commissioned by Metro Authority."), ("PKG-ALPHA", "Bridge Alpha contract value is INR 100000000."), ("PKG-BETA", "Bridge Beta was commissioned by Metro Authority."), ("PKG-BETA", "Bridge Beta contract value is INR 200000000."), ("PKG-GAMMA", "Bridge Gamma was commissioned by Other Authority."), ("PKG-GAMMA", "Bridge Gamma contract value is INR 999999999.")])], "evidence_id string, document_id string, text string")
    return kg.World(entities=entities, relationships=edges, attributes=attributes, evidence=evidence, facts=facts, mentions=mentions)


def op(var, kind, **params):
    return {"output_var": var, "op_type": kind, "params": params}


GOOD = {"question": "q", "operations": [op("m", "RESOLVE_ENTITY", query="metro authority", entity_type="client"), op("p", "ENUMERATE", entity_type="project", predicate="commissioned by", anchor_var="$m"), op("v", "GET_ATTRIBUTE", input_var="$p", predicate="contract value"), op("s", "AGGREGATE", input_var="$v", function="sum"), op("r", "RETURN", input_var="$s")], "final_var": "$r"}
BAD = json.loads(json.dumps(GOOD).replace("contract value", "completion date"))


def test_golden_sum_after_a_replan(spark, golden):
    asked = []

    def planner(question, schema, issues):
        asked.append(issues)
        return BAD if not issues else GOOD

    got = Engine(spark, golden).ask("q", planner)
    assert (got.value, got.status, got.iterations) == (350000000.0, "verified", 2)
    assert asked[0] == [] and asked[1]
    assert "e2" in got.evidence


def test_replans_are_bounded_and_no_planner_is_no_answer(spark, golden):
    assert Engine(spark, golden).ask("q", lambda *a: BAD).iterations == 3
    assert Engine(spark, golden).ask("q").status == "insufficient_evidence"


def test_population_and_difference(spark, golden):
    engine = Engine(spark, golden)
    count = {"operations": [*GOOD["operations"][:2], op("n", "AGGREGATE", input_var="$p", function="count")]}
    assert engine.run_plan(count).first().value == 2
    rest = {"operations": [*GOOD["operations"][:2], op("a", "ENUMERATE", entity_type="Project"), op("d", "DIFFERENCE", input_var="$a", exclude_var="$p")]}
    assert [r.entity_id for r in engine.run_plan(rest).collect()] == ["gamma"]
    none = {"operations": [op("m", "RESOLVE_ENTITY", query="zzzz qqqq"), op("p", "ENUMERATE", entity_type="project", anchor_var="$m")]}
    assert engine.run_plan(none).count() == 0


def test_filters_compare_and_compute(spark, golden):
    engine = Engine(spark, golden)
    base = [op("a", "ENUMERATE", entity_type="project"), op("v", "GET_ATTRIBUTE", input_var="$a", predicate="contract_value")]
    big = {"operations": [*base, op("f", "FILTER", input_var="$v", field="value", op="gt", value=180000000), op("n", "AGGREGATE", input_var="$f", function="count"), op("m", "AGGREGATE", input_var="$v", function="max"), op("c", "COMPUTE", operation="ratio", input_vars=["$m", "$n"]), op("x", "COMPARE", left_var="$c", right_var="$m", op="lt")]}
    assert engine.run_plan(big | {"final_var": "n"}).first().value == 2
    assert engine.run_plan(big | {"final_var": "c"}).first().value == 999999999 / 2
    assert engine.run_plan(big).first().value is True
    names = {"operations": [op("a", "ENUMERATE", entity_type="project"), op("f", "FILTER", input_var="$a", field="name", op="contains", value="ALPHA")]}
    assert [r.entity_id for r in engine.run_plan(names).collect()] == ["alpha"]


@pytest.mark.parametrize("operations", [[], [op("x", "NOPE")], [op("x", "TRAVERSE", input_var="$y")], [op("x", "GET_ATTRIBUTE", predicate="p")], [op("a", "ENUMERATE"), op("x", "FILTER", input_var="$a", field="f", op="in", value="text")], [op("a", "ENUMERATE", wrong=1)], [op("a", "ENUMERATE"), op("x", "COMPARE", left_var="$a", right_var="$a", op="gt")]])
def test_plans_that_do_not_hold_together(operations):
    with pytest.raises(PlanError):
        parse({"operations": operations})


def test_dead_steps_are_not_checked_but_completeness_is(spark, golden):
    dead = {"operations": [op("z", "ENUMERATE", entity_type="nothing"), *GOOD["operations"]], "final_var": "r"}
    assert Engine(spark, golden).ask("q", verify.static_planner(dead)).status == "verified"
    short = {"operations": [op("k", "CHECK_COMPLETENESS", entity_type="project", expected_min=9), *GOOD["operations"]], "final_var": "r"}
    assert Engine(spark, golden).ask("q", verify.static_planner(short)).status == "unverified"


def test_traversal_directions(spark, golden):
    start = spark.createDataFrame([("metro",)], "entity_id string")
    hop = lambda d: sorted(r.entity_id for r in graph.one_hop(golden.relationships, start, d).collect())
    assert (hop("in"), hop("out"), hop("both")) == (["alpha", "beta"], [], ["alpha", "beta"])
    both = spark.createDataFrame([("metro",), ("alpha",)], "entity_id string")
    assert sorted(r.entity_id for r in graph.one_hop(golden.relationships, both, "in").collect()) == ["alpha", "beta"]
    assert graph.shortest_path(golden.relationships, "alpha", "metro").first().path == ["alpha", "metro"]
    assert graph.shortest_path(golden.relationships, "metro", "alpha").count() == 0


def test_long_paths_are_found(spark):
    edges = spark.createDataFrame([(f"n{i:02}", "next", f"n{i + 1:02}", "e") for i in range(18)], "subject_id string, predicate string, object_id string, evidence_id string")
    found = graph.shortest_path(edges, "n00", "n18").first()
    assert found.length == 18 and found.path == [f"n{i:02}" for i in range(19)]
    assert graph.shortest_path(edges, "n00", "n18", 17).count() == 0 and graph.shortest_path(edges, "n00", "nowhere").count() == 0


def test_resolution_margins(spark):
    rows = spark.createDataFrame([("a", 0.70, "x"), ("a", 0.68, "y"), ("b", 0.95, "x"), ("b", 0.40, "y"), ("c", 0.90, "x"), ("c", 0.85, "y"), ("d", 0.3, "x")], "m string, score double, entity_id string")
    got = {(r.m, r.entity_id): r.status for r in resolve.finalize(rows, ["m"]).collect()}
    assert got == {("a", "x"): "ambiguous", ("a", "y"): "ambiguous", ("b", "x"): "resolved", ("c", "x"): "ambiguous", ("c", "y"): "ambiguous"}
    with pytest.raises(ValueError):
        resolve.Config(lexical=0.9)


def test_answers_of_any_shape(spark):
    number = lambda value, kind="money": verify.answer_number(spark, value, kind)
    assert [number(v) for v in (True, 5, 2.5, "1,000", "INR 2 Cr", ["7"], {"total": [3]}, {"other": 1}, [1, 2], None, "none")] == [1.0, 5.0, 2.5, 1000.0, 2e7, 7.0, 3.0, None, None, None, None]
    assert [number(v, "count") for v in ([1, 2], [], {"count": 4, "value": 9}, {"value": ["a", "b"]})] == [2.0, 0.0, 4.0, 2.0]


def test_settings_and_the_ids_of_an_entity(spark, golden):
    from tessera.settings import Settings

    assert Settings.read({}) == Settings() and Settings.read({"TESSERA_MAX_ITERATIONS": "5", "TESSERA_DOCUMENT_INDEX": "i.csv"}) == Settings(max_iterations=5, document_index="i.csv")
    edges = golden.relationships.withColumn("relationship_id", F.concat(F.lit("r:"), "subject_id"))
    found = Engine(spark, dataclasses.replace(golden, relationships=edges)).get_entity("metro").first()
    assert (found.n_out, found.n_in, found.out_ids, found.in_ids) == (0, 2, [], ["r:alpha", "r:beta"])


def test_the_graph_is_a_signal(spark, golden):
    plain = resolve.resolve_text(golden.entities, "metro authorty", "client").first()
    with_graph = Engine(spark, golden).resolve_entity("metro authorty", "client").first()
    ratio = search.name_ratio("metro authorty", "Metro Authority") / 100
    assert with_graph.entity_id == plain.entity_id == "metro" and abs(with_graph.score - plain.score - 0.1 * ratio) < 1e-9


def test_search(spark, golden):
    engine = Engine(spark, golden)
    assert engine.search_evidence("Bridge Alpha contract value", 3).count() == 3
    assert engine.lexical_search("bridge beta was commissioned by metro authority", 1).first().source_id == "e3"
    assert engine.discover_evidence("Bridge Gamma", 2).count() == 2
    assert engine.check_evidence_support("bridge beta was commissioned by metro authority", "e3").first().supported
    assert search.exact(engine._rows(), "bridge ALPHA was commissioned, by metro authority!").count() == 1
    raw = [r.score for r in engine.search_evidence("Bridge Alpha", 5, mode="raw").collect()]
    assert raw == sorted(raw, reverse=True) and raw[0] > 1


def test_mentions_meet_all_entities_of_their_type(spark):
    entities = spark.createDataFrame([("m", "client", "Metro", ["Metro"]), ("n", "client", "Northern Rail", None), ("b", None, "Metra", None), ("p", "project", "Metro", None)], "entity_id string, entity_type string, name string, aliases array<string>")
    mentions = spark.createDataFrame([("1", "Metrro", "client"), ("2", "Metro", None), ("3", "Nothern Rail", ""), ("4", "qzj", "client")], "mention_id string, mention_text string, entity_type string")
    got = {(r.mention_id, r.entity_id): r.score for r in resolve.resolve_mentions(mentions, entities).collect()}
    pairs = mentions.select("mention_id", "mention_text", F.col("entity_type").alias("mention_type")).crossJoin(entities)
    fits = "coalesce(mention_type, '') = '' or coalesce(entity_type, '') = '' or mention_type = entity_type"
    want = {(r.mention_id, r.entity_id): r.score for r in resolve.scored(pairs.filter(fits)).collect()}
    assert got.items() <= want.items() and {k for k, v in want.items() if v >= 0.55} <= set(got)
    status = {(r.mention_id, r.entity_id): r.status for r in resolve.finalize(resolve.resolve_mentions(mentions, entities), ["mention_id"]).collect()}
    assert status["1", "m"] == "ambiguous" and status["2", "m"] == status["2", "p"] == "ambiguous" and ("3", "n") in status
    assert not any(m == "4" for m, _ in status)


def test_counts_are_of_the_whole_result(spark, golden, tmp_path):
    n = 1200
    many = spark.range(n).select(F.format_string("x%05d", "id").alias("entity_id"), F.lit("project").alias("entity_type"), F.format_string("Site %d", "id").alias("name"))
    entities = golden.entities.unionByName(many, allowMissingColumns=True)
    edges = golden.relationships.union(many.select("entity_id", F.lit("commissioned_by"), F.lit("metro"), F.when(F.col("entity_id") == "x01100", "e1")))
    world = dataclasses.replace(golden, entities=entities, relationships=edges)
    plan = {"question": "q", "operations": [op("m", "RESOLVE_ENTITY", query="metro authority", entity_type="client"), op("t", "TRAVERSE", input_var="$m", predicate="commissioned by", direction="in")], "final_var": "$t"}
    found = verify.answer(parse(plan), world)
    assert found.count == n + 2 and len(found.value) == 30 and {s.output_var: s.count for s in found.steps}["t"] == n + 2
    questions = spark.createDataFrame([("1", "q", "count")], "qid string, question string, answer_type string")
    Engine(spark, world).answer_all(questions, verify.static_planner(plan), f"{tmp_path}/out")
    assert f"{n + 2}" in "".join(p.read_text() for p in (tmp_path / "out").rglob("*.csv")) if (tmp_path / "out").is_dir() else f"{n + 2}" in (tmp_path / "out").read_text()


def brute_hybrid(rows, query, k):
    def words(t):
        return " ".join(sorted(re.findall(r"[^\W_]+", t.lower())))

    def ratio(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j, old=row, x=x: old[j - 1] + 1 if b[j - 1] == x else max(old[j], left), initial=0))
        return 200 * row[-1] / (len(a) + len(b))

    def vector(t):
        raw = struct.unpack(">384I", b"".join(hashlib.sha256(f"{t}:{i}".encode()).digest() for i in range(48)))
        raw = [x / (2**32 - 1) * 2 - 1 for x in raw]
        size = math.sqrt(sum(x * x for x in raw))
        return [x / size for x in raw]

    q = vector(query)
    lexical = {i: r / 100 for i, t in rows if (r := ratio(words(t), words(query))) >= 30}
    semantic = {i: (sum(a * b for a, b in zip(vector(t), q, strict=True)) / (1 + 1e-9) + 1) / 2 for i, t in rows}
    best = {}
    for by, scores in (("lexical", lexical), ("semantic", semantic)):
        for i in sorted(scores, key=lambda i: (-scores[i], i))[:k]:
            best[i] = max(best.get(i, (0, "")), (scores[i], by))
    return [(i, best[i][1], best[i][0]) for i in sorted(best, key=lambda i: (-best[i][0], i))[:k]]


def test_hybrid_query_searches_whole_documents(spark, tmp_path):
    import __spark_entry__ as entry

    texts = ["padding " * 10 + "the inner text of a thing", "the inner text of a thing", "inner thing", "x" * 80 + " a thing of inner text", "The THING: of inner-text a", *(f"row {i} " + "word " * i for i in range(12))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["hybrid_topk"](spark, str(tmp_path)).collect()
    want = brute_hybrid([(f"d{i}", t) for i, t in enumerate(texts)], "the inner text of a thing", 8)
    assert [(r.source_id, r["by"]) for r in got] == [w[:2] for w in want]
    assert all(abs(r.score - w[2]) < 2e-6 for r, w in zip(got, want, strict=True))


def test_calculate(spark, golden):
    calc = Engine(spark, golden).calculate
    assert calc([1, 2, None, 6], "sum") == 9 and calc([], "sum") == 0 and calc([], "avg") == 0 and calc([], "min") is None
    assert calc([1, 2, 9, 4], "median") == 3 and calc([10, 4], "diff") == 6 and calc([10], "diff") is None
    assert calc([1, 0], "ratio") is None and calc([6, 4], "pct_diff") == 50 and calc([3, 3, 1], "count") == 3
    assert "error" in Engine(spark, golden).call("calculate", values=[1], operation="nope")
    assert "error" in Engine(spark, golden).call("_rows") and "error" in Engine(spark, golden).call("nothing")


def test_difference_removes_nulls_alike(spark):
    left, right = spark.createDataFrame([("a",), (None,), ("b",), ("b",)], "entity_id string"), spark.createDataFrame([(None,), ("a",)], "entity_id string")
    assert [r.entity_id for r in relational.difference(left, right).collect()] == ["b", "b"]


RESULT = {
    "success": [
        {"document_id": "D1", "filename": "d1.pdf", "document_type": "pdf", "source_path": "c/d1.pdf", "metadata": {"size_bytes": 1}, "pages": [{"page_number": 1, "text": "Contract Value: INR 33.38 Cr\n", "blocks": [{"block_id": "b1", "document_id": "D1", "page_number": 1, "text": "INR 33.38 Cr", "coordinates": {"x0": 0, "y0": 0, "x1": 1, "y1": 1}}, {"block_id": "b2", "document_id": "D1", "page_number": 1, "text": "Completion Date: 31 Mar 2026", "coordinates": None}]}]},
        {"document_id": "W1", "filename": "w.xlsx", "document_type": "xlsx", "source_path": "c/w.xlsx", "sheets": [{"workbook_id": "W1", "sheet_name": "S", "cells": [{"workbook_id": "W1", "sheet_name": "S", "cell_address": "A1", "value": "Amount (INR)"}, {"workbook_id": "W1", "sheet_name": "S", "cell_address": "A2", "value": "1000"}, {"workbook_id": "W1", "sheet_name": "S", "cell_address": "B1", "value": "Description"}, {"workbook_id": "W1", "sheet_name": "S", "cell_address": "B2", "value": "203"}, {"workbook_id": "W1", "sheet_name": "S", "cell_address": "C5", "value": "42", "formula": "=SUM(A2:A3)"}]}]},
    ],
    "failures": [{"document_id": "X", "path": "x", "error_type": "E", "error_message": "m"}],
}


def test_build_is_incremental(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps(RESULT))
    engine = Engine.build(spark, str(tmp_path / "r.json"), str(tmp_path / "w"))
    facts = {(r.predicate, r.normalized_type, r.normalized_value) for r in engine.world.facts.collect()}
    assert facts == {("contract_value", "currency_inr", "333800000"), ("date", "date", "2026-03-31"), ("amount", "number", "1000"), ("computed_value", "number", "42")}
    assert engine.world.evidence.count() == 7
    before = writers.current(spark, str(tmp_path / "w"), "facts")
    again = Engine.build(spark, str(tmp_path / "r.json"), str(tmp_path / "w"))
    assert writers.current(spark, str(tmp_path / "w"), "facts") == before and again.world.facts.count() == 4
    assert again.query_sql("SELECT count(*) AS n FROM facts WHERE document_id = ?", ["W1"]).first().n == 2
    says = {"entities": [{"mention_text": "Bridge", "entity_type": "project", "confidence": 0.9, "source_ref": None}, {"mention_text": "Metro", "entity_type": "client", "confidence": 0.9, "source_ref": None}, {"mention_text": "Bad", "entity_type": "x", "confidence": 7, "source_ref": None}], "relationships": [{"subject_mention_text": "bridge", "predicate": "commissioned_by", "object_mention_text": "METRO", "confidence": 1, "source_ref": "e"}, {"subject_mention_text": "nobody", "predicate": "p", "object_mention_text": "Metro", "confidence": 1, "source_ref": "e"}], "attributes": [{"subject_mention_text": "Bridge", "predicate": "length", "value": "5%", "value_type": "percent", "confidence": 1, "source_ref": "e"}]}
    answers = spark.createDataFrame([("D1", 0, json.dumps(says)), ("D1", 1, "not json")], "document_id string, batch long, answer string")
    grown = again.extend(answers)
    grown = grown.extend(answers)
    assert (grown.world.entities.count(), grown.world.relationships.count(), grown.world.attributes.count(), grown.world.mentions.count()) == (2, 1, 1, 2)
    assert grown.get_coverage().first().facts == 4


def test_conflicts(spark):
    rows = spark.createDataFrame([("d", "p", "1"), ("d", "p", "2"), ("d", "q", "1"), ("e", "p", "1")], "document_id string, predicate string, normalized_value string")
    assert [(r.document_id, r.predicate, r.n_values) for r in etl.conflicting(rows).collect()] == [("d", "p", 2)]


def test_readers(spark, tmp_path):
    (tmp_path / "i.csv").write_text("﻿doc_id,doc_type,filename,size_bytes\nD1,cert,a.pdf,1\nD2,letter,x/D1,2\n", encoding="utf-8")
    index = {r.key: r.doc_type for r in readers.document_index(spark, str(tmp_path / "i.csv")).collect()}
    assert index == {"D1": "cert", "D2": "letter", "a.pdf": "cert"}
    (tmp_path / "q1.json").write_text(json.dumps({"questions": [{"qid": "Q1", "question": "a", "answer": 5, "answer_type": "count"}]}))
    (tmp_path / "q2.json").write_text(json.dumps([{"qid": "Q2", "question": "b", "answer_type": "money"}]))
    assert readers.questions(spark, str(tmp_path / "q1.json")).first().qid == "Q1"
    assert readers.questions(spark, str(tmp_path / "q2.json")).first().qid == "Q2"
    (tmp_path / "s.csv").write_text('question_id,answer\nQ1,"₹1,000"\nQ2,INR 5\nQ3,none\n')
    assert {r.question_id: r.answer for r in readers.submission(spark, str(tmp_path / "s.csv")).collect()} == {"Q1": 1000.0, "Q2": 5.0, "Q3": None}
    assert readers.jsonl(spark, str(tmp_path / "missing"), "facts").count() == 0
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.PDF").write_bytes(b"x")
    (tmp_path / "d" / "b.txt").write_bytes(b"y")
    assert [r.extension for r in readers.files(spark, str(tmp_path / "d")).collect()] == ["pdf"]


def test_upsert_keeps_the_last(spark, tmp_path):
    root = str(tmp_path)
    writers.upsert(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), root, "t", "k")
    writers.upsert(spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int"), root, "t", "k")
    assert sorted(tuple(r) for r in writers.keyed(spark, root, "t").collect()) == [("a", 1), ("b", 2), ("c", 2)]


@pytest.mark.parametrize("text", ["DROP TABLE x", "SELECT 1; SELECT 2", "INSERT INTO t VALUES (1)", "CREATE TABLE t (a int)", "SELECT * FROM parquet.`/tmp/x`", "SET a=b", "update t set a = 1", "", "SELECT * FROM TEXT.`/etc/hostname`", "SELECT * FROM Parquet.`/tmp/x`", "SELECT * FROM spark_catalog.default.t", "SELECT * FROM (SELECT * FROM `binaryFile`.`/etc`)", "SELECT (SELECT max(value) FROM text.`/etc/hostname`)", "WITH t AS (SELECT * FROM text.`/etc/hostname`) SELECT * FROM t", "SELECT java_method('java.lang.System', 'getenv', 'HOME')", "SELECT Reflect('java.lang.System', 'getenv', 'HOME')", "SELECT 1 WHERE try_reflect('java.lang.System', 'getenv', 'HOME') IS NOT NULL", "SELECT * FROM IDENTIFIER('text.`/etc/hostname`')", "SELECT IDENTIFIER('reflect')('java.lang.System', 'getenv', 'HOME')", "SELECT TRANSFORM(1) USING 'cat' AS (a)", "SELECT input_file_name()", "SELECT * FROM unknown_table", "SELECT spark_catalog.default.f(1)"])
def test_only_queries(spark, text):
    with pytest.raises(sql.NotASelect):
        sql.select(spark, text)


def test_views_ctes_and_subqueries_are_open_to_queries(spark):
    spark.range(5).createOrReplaceTempView("numbers_here")
    text = "WITH a AS (SELECT id FROM Numbers_Here WHERE id IN (SELECT max(id) FROM numbers_here)) SELECT a.id + x.n AS v FROM a, LATERAL (SELECT count(*) AS n FROM numbers_here WHERE id < a.id) x ORDER BY v LIMIT 3"
    assert [r.v for r in sql.select(spark, text).collect()] == [8]
    assert sql.select(spark, "SELECT sum(col) AS s FROM explode(array(1, 2)) UNION ALL SELECT count(DISTINCT id) FROM range(4)").count() == 2


def test_queries_pass(spark):
    assert sql.select(spark, "WITH t AS (SELECT 1 AS a) SELECT a + :b AS c FROM t", {"b": 2}).first().c == 3


def test_stream_runs_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01", "a"), (1, "2024-01-02", "b"), (2, "2024-01-01", "c")], "event_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.ingest_events(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert sorted((r.event_id, r.event_type) for r in ingest.keyed_table(spark, str(tmp_path / "out")).collect()) == [(1, "b"), (2, "c")]
    rows.withColumn("event_type", F.lit("new")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.ingest_events(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert {r.event_type for r in ingest.keyed_table(spark, str(tmp_path / "out")).collect()} == {"new"}


def test_a_late_older_version_does_not_win(spark, tmp_path):
    made = lambda day, kind: spark.createDataFrame([(1, day, kind)], "event_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for day, kind in (("2024-01-05", "newer"), ("2024-01-01", "older, late")):
        made(day, kind)
        ingest.ingest_events(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert [r.event_type for r in ingest.keyed_table(spark, str(tmp_path / "out")).collect()] == ["newer"]


def test_edges_and_evidence_of_a_hub(spark):
    edges = spark.createDataFrame([(f"r{i:02}", f"n{i:02}", "p", "hub", f"e{i:02}") for i in range(25)], "relationship_id string, subject_id string, predicate string, object_id string, evidence_id string")
    start = spark.createDataFrame([(f"n{i:02}",) for i in range(25)], "entity_id string")
    assert graph.one_hop(edges, start, "out").first().evidence_ids == [f"e{i:02}" for i in range(graph.SHOWN)]
    found = graph.hop_edges(edges, start, "out").collect()
    assert sorted((r.from_id, r.entity_id, r.relationship_id, r.predicate) for r in found) == [(f"n{i:02}", "hub", f"r{i:02}", "p") for i in range(25)]


def test_ranks_need_no_single_task(spark):
    rows = spark.createDataFrame([(f"e{i}", float(i * 7 % 50) if i % 9 else None) for i in range(200)], "entity_id string, value_number double")
    want = sorted(((r.entity_id, r.value_number) for r in rows.collect() if r.value_number is not None), key=lambda x: (-x[1], x[0]))
    got = sorted(relational.ranked(rows).collect(), key=lambda r: r["rank"])
    assert [(r.entity_id, r.value_number) for r in got] == want and [r["rank"] for r in got] == list(range(len(want)))
    assert [r.entity_id for r in sorted(relational.ranked(rows, 5).collect(), key=lambda r: r["rank"])] == [e for e, _ in want[:5]]


def test_rules_over_steps():
    plan = parse({"question": "q", "operations": [op("a", "ENUMERATE", entity_type="t"), op("b", "GET_ATTRIBUTE", input_var="$a", predicate="p"), op("c", "AGGREGATE", input_var="$b", function="sum")], "final_var": "$c"})
    step = lambda var, kind, status, evidence=(), note="": verify.Step(var, kind, status, 1, list(evidence), note)
    good = [step("a", "ENUMERATE", "ok"), step("b", "GET_ATTRIBUTE", "ok", ["e"]), step("c", "AGGREGATE", "ok")]
    assert verify.verify(plan, good) == []
    for at, bad in ((0, "ambiguous"), (0, "failed"), (0, "incomplete"), (1, "empty"), (2, "empty")):
        steps = [dataclasses.replace(s, status=bad) if i == at else s for i, s in enumerate(good)]
        assert len(verify.verify(plan, steps)) == 1, bad
    assert len(verify.verify(plan, [good[0], dataclasses.replace(good[1], evidence_ids=[]), good[2]])) == 1
    assert len(verify.verify(plan, good[:2])) == 1


def test_the_index_embeds_texts_once(spark, tmp_path):
    from tessera.functions.vectors import hash_embedding
    from tessera.operators import index

    made = lambda rows: spark.createDataFrame([(i, "evidence", "D", t) for i, t in rows], "source_id string, source string, document_id string, text string")
    root, embed = str(tmp_path), lambda text: hash_embedding(text, 16)
    assert index.stored(spark, root) is None
    assert index.refresh(made([("a", "one text"), ("b", "another"), ("c", None)]), root, embed) == 3
    assert index.refresh(made([("a", "one text"), ("b", "another"), ("c", None)]), root, embed) == 0
    assert index.refresh(made([("a", "one text"), ("b", "changed")]), root, embed) == 1
    stored = index.stored(spark, root)
    assert sorted((r.source_id, r.text) for r in stored.collect()) == [("a", "one text"), ("b", "changed")]
    best = index.nearest(stored, "changed", 1, embed).first()
    assert best.source_id == "b" and abs(best.score - 1) < 1e-6


def test_provenance_of_each_kind(spark, golden):
    edges = golden.relationships.withColumn("relationship_id", F.concat(F.lit("r:"), "subject_id"))
    engine = Engine(spark, dataclasses.replace(golden, relationships=edges))
    found = {(r.via, r.evidence_id, r.document_id) for r in engine.get_provenance("alpha").collect()}
    assert found == {("attribute", "e2", "PKG-ALPHA"), ("relationship", "e1", "PKG-ALPHA")}
    assert [(r.via_id, r.evidence_id) for r in engine.get_provenance(relationship_id="r:beta").collect()] == [("r:beta", "e3")]
    assert [(r.via_id, r.evidence_id) for r in engine.get_provenance(fact_id="f1").collect()] == [("f1", "e2")]
    assert engine.evidence_text("e0").first().text == "Asha Nair led the project Bridge Alpha."
    with pytest.raises(ValueError):
        engine.get_provenance()


def test_documents_are_extracted_when_a_plan_discovers_them(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps(RESULT))
    read = []

    def extractor(fragments):
        ids = sorted({r.document_id for r in fragments.select("document_id").distinct().collect()})
        read.append(ids)
        says = json.dumps({"entities": [{"mention_text": "Bridge", "entity_type": "project", "confidence": 0.9, "source_ref": None}], "relationships": [], "attributes": []})
        return fragments.select("document_id", "batch").distinct().withColumn("answer", F.lit(says))

    engine = Engine.build(spark, str(tmp_path / "r.json"), str(tmp_path / "w"))
    engine.extractor = extractor
    plan = {"question": "q", "operations": [op("d", "DISCOVER", query="contract value", limit=5), op("p", "ENUMERATE", entity_type="project"), op("n", "AGGREGATE", input_var="$p", function="count")], "final_var": "$n"}
    assert engine.run_plan(plan).first().value == 1.0
    assert len(read) == 1 and read[0]
    assert engine.run_plan(plan).first().value == 1.0 and len(read) == 1


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "hop_aggregate" in entry.queries()
