"""Command line: python -m corpusloom COMMAND INPUT... OUTPUT, on the session that spark-submit or the environment gives."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom import registry
from corpusloom.operators import corpus, retrieve, split
from corpusloom.sources import organizer, sinks


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, inputs in (("import-questions", 1), ("import-contexts", 1), ("chunk", 1), ("report", 1), ("aliases", 1), ("split", 1), ("retrieve", 2), ("validate", 2)):
        c = sub.add_parser(name)
        for i in range(inputs):
            c.add_argument(f"input{i}")
        c.add_argument("output")
    q = sub.add_parser("query")
    q.add_argument("name", choices=sorted(registry.queries()))
    q.add_argument("input0")
    q.add_argument("output")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("corpusloom").getOrCreate()
    read = spark.read.parquet
    if a.command == "import-questions":
        df = organizer.read_questions(spark, a.input0)
    elif a.command == "import-contexts":
        df = organizer.read_contexts(spark, a.input0)
    elif a.command == "chunk":
        df = corpus.chunked(read(a.input0).where("indexable"))
    elif a.command == "report":
        df = corpus.corpus_report(read(a.input0), ["kind"])
    elif a.command == "aliases":
        df = retrieve.alias_proposals(read(a.input0))
    elif a.command == "split":
        q = read(a.input0).select(F.col("question_id").alias("id"), F.col("question").alias("text"))
        df = split.split_manifest(split.split_groups(q), "split.v1")
    elif a.command == "retrieve":
        df = retrieve.bm25(read(a.input0).select("chunk_id", F.col("retrieval_text").alias("text")), read(a.input1).select("question_id", "question"))
    elif a.command == "validate":
        df = sinks.validate_submission(read(a.input0), read(a.input1))
    else:
        df = registry.queries()[a.name](spark, a.input0)
    sinks.write_immutable(df, a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
