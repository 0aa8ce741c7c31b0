"""Jobs: python -m quillstone build-corpus | build-index | search | evaluate | latency | bake-off | migrate ... --help"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import chunking, corpus, evaluate, index, retrieval
from quillstone.plans.engine import session
from quillstone.shipping import ship
from quillstone.sources import tables


def build_corpus(spark: SparkSession, a: argparse.Namespace) -> None:
    """Source files of several languages to one table of documents, the first of each text."""
    parts = [corpus.expand_passages(tables.read_source(spark, tables.source_path(a.source, lang, a.split)), lang, a.min_chars) for lang in a.languages]
    tables.write_table(index.union_of_languages(parts, F.sha1("text"), "doc_id"), a.target)
    tables.write_table(reduce(DataFrame.unionByName, [corpus.gold_ids(tables.read_source(spark, tables.source_path(a.source, lang, a.split)), lang) for lang in a.languages]), f"{a.target}-gold")


def build_index(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = spark.read.parquet(a.source).withColumn("text", T.normalize(F.col("text")))
    chunks = index.chunked(docs, a.strategies)
    index.save(a.target, chunks, index.embedded(chunks, chunking.hashing_embedder))


def search(spark: SparkSession, a: argparse.Namespace) -> None:
    tables.write_table(index.bm25(index.load(spark, a.index), spark.read.parquet(a.queries).select("qid", "text"), a.top), a.target)


def evaluation(spark: SparkSession, a: argparse.Namespace) -> None:
    runs = spark.read.parquet(a.runs) if a.runs else None
    evaluate.save_report(evaluate.evaluation(spark.read.parquet(a.hits), evaluate.qrels(spark.read.parquet(a.relevant), "qid", "doc_id"), runs), a.target)


def latency(spark: SparkSession, a: argparse.Namespace) -> None:
    evaluate.save_report(evaluate.latency_report(spark.read.parquet(a.runs)), a.target)


def bake_off(spark: SparkSession, a: argparse.Namespace) -> None:
    """Strategies of an index by what BM25 finds in each, the best first."""
    parts = index.load(spark, a.index)
    queries = spark.read.parquet(a.queries).select("qid", "text")
    relevant = evaluate.qrels(spark.read.parquet(a.relevant), "qid", "doc_id")
    found = []
    for s in sorted(r["strategy"] for r in parts["chunks"].select("strategy").distinct().collect()):
        own = parts["chunks"].where(F.col("strategy") == s)
        hits = retrieval.bm25(own.select("chunk_id", "text"), queries, evaluate.CANDIDATES).join(own.select("chunk_id", "doc_id"), "chunk_id")
        found.append(evaluate.documents_of(hits).withColumn("strategy", F.lit(s)))
    tables.write_table(evaluate.bake_off(reduce(DataFrame.unionByName, found), relevant), a.target)


def migrate(spark: SparkSession, a: argparse.Namespace) -> None:
    print("read {}, written {}".format(*tables.migrate(spark, a.source, a.target)))


JOBS = {
    "build-corpus": (build_corpus, ("source", "target"), {"languages": ["hi"], "split": "train", "min_chars": 40}),
    "build-index": (build_index, ("source", "target"), {"strategies": ["sentence", "contextual", "fixed_tokens", "semantic"]}),
    "search": (search, ("index", "queries", "target"), {"top": 10}),
    "evaluate": (evaluation, ("hits", "relevant", "target"), {"runs": ""}),
    "latency": (latency, ("runs", "target"), {}),
    "bake-off": (bake_off, ("index", "queries", "relevant", "target"), {}),
    "migrate": (migrate, ("source", "target"), {}),
}


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quillstone")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, (_, needed, options) in JOBS.items():
        job = jobs.add_parser(name)
        for n in needed:
            job.add_argument(n)
        for n, default in options.items():
            job.add_argument(f"--{n.replace('_', '-')}", default=default, **({"nargs": "+"} if isinstance(default, list) else {"type": type(default)}))
    a = parser.parse_args(arguments)
    spark = session()
    ship(spark)
    JOBS[a.job][0](spark, a)


if __name__ == "__main__":
    main()
