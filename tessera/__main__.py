"""python -m tessera: ingest, build, query, sql and submit over a folder."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from tessera.engine import Engine
from tessera.plans import verify
from tessera.settings import Settings
from tessera.sources import readers


def main(argv: list[str] | None = None) -> int:
    settings = Settings.read()
    parser = argparse.ArgumentParser(prog="tessera")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="evidence and facts of an extraction result")
    build.add_argument("results")
    build.add_argument("root")
    ingest = commands.add_parser("ingest", help="evidence and facts of the files below a folder")
    ingest.add_argument("folder")
    ingest.add_argument("root")
    for command in (build, ingest):
        command.add_argument("--force", action="store_true", help="take in unchanged documents, too")
        command.add_argument("--document-index", default=settings.document_index, help="CSV with the types of documents")
        command.add_argument("--vectors", action="store_true", help="bring the stored vector index up to date")
    query = commands.add_parser("query", help="run a plan (JSON) and verify its answer")
    query.add_argument("root")
    query.add_argument("plan")
    query.add_argument("--json", action="store_true")
    query.add_argument("--max-iterations", type=int, default=settings.max_iterations)
    query.add_argument("--evidence-limit", type=int, default=settings.evidence_limit, help="rows of a list that are shown")
    text = commands.add_parser("sql", help="one SELECT over the world's tables")
    text.add_argument("root")
    text.add_argument("statement")
    submit = commands.add_parser("submit", help="answer questions with plans by question id")
    submit.add_argument("root")
    submit.add_argument("questions")
    submit.add_argument("plans")
    submit.add_argument("output")
    submit.add_argument("--question-limit", type=int, default=settings.question_limit, help="only the first questions by id")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel(settings.log_level)
    if args.command in ("build", "ingest"):
        take_in, source = (Engine.build, args.results) if args.command == "build" else (Engine.ingest, args.folder)
        engine = take_in(spark, source, args.root, args.force, args.document_index)
        if args.vectors:
            engine.refresh_index()
        engine.get_coverage().show()
        return 0
    engine = Engine.open(spark, args.root)
    if args.command == "sql":
        engine.query_sql(args.statement).show(truncate=False)
    elif args.command == "query":
        found = engine.ask("", verify.static_planner(Path(args.plan).read_text()), args.max_iterations, args.evidence_limit)
        print(json.dumps({"answer": found.value, "status": found.status, "confidence": found.confidence, "evidence": found.evidence, "issues": found.issues}, default=str) if args.json else f"{found.value} ({found.status})")
    else:
        plans = json.loads(Path(args.plans).read_text())
        questions = readers.questions(spark, args.questions)
        questions = questions.orderBy("qid").limit(args.question_limit) if args.question_limit else questions
        engine.answer_all(questions, lambda question, schema, issues: plans.get(question), args.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
