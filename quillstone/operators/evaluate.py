"""Ranking metrics over hits (qid, doc_id, rank) and relevance (qid, doc_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators import analytics, ranks


def ir_metrics(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """qid, n_relevant, recall_1/5/10, rr_10, ndcg_10, precision_10 for labelled queries."""
    flagged = hits.join(relevant.select("qid", "doc_id", F.lit(True).alias("is_relevant")), ["qid", "doc_id"], "left")
    hit = F.coalesce("is_relevant", F.lit(False))
    found = flagged.groupBy("qid").agg(
        *[F.count_if(hit & (F.col("rank") <= k)).alias(f"hits_{k}") for k in (1, 5, 10)],
        F.min(F.when(hit & (F.col("rank") <= 10), F.col("rank"))).alias("first"),
        F.sum(F.when(hit & (F.col("rank") <= 10), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    sizes = relevant.groupBy("qid").agg(F.count(F.lit(1)).alias("n_relevant"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return sizes.join(found, "qid", "left").select(
        "qid", "n_relevant", *[F.round(zero(F.col(f"hits_{k}")) / F.col("n_relevant"), 6).alias(f"recall_{k}") for k in (1, 5, 10)],
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr_10"), F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg_10"), F.round(zero(F.col("hits_10")) / 10, 6).alias("precision_10"),
    )


def macro(metrics: DataFrame) -> DataFrame:
    names = [c for c in metrics.columns if c not in ("qid", "n_relevant")]
    return metrics.agg(F.count(F.lit(1)).alias("n_queries"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(c) for c in names])


def bake_off(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """Macro metrics of each strategy, best recall first."""
    parts = ir_metrics(hits.withColumn("qid", F.struct("strategy", "qid")), relevant.join(hits.select("strategy").distinct()).withColumn("qid", F.struct("strategy", "qid")))
    names = [c for c in parts.columns if c not in ("qid", "n_relevant")]
    return parts.groupBy("qid.strategy").agg(*[F.round(F.avg(c), 4).alias(c) for c in names]).orderBy(F.desc("recall_10"), "strategy")


def without_warmup(runs: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """Without the first n rows of each group."""
    return runs.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("nth") > n).drop("nth")


def qrels(rows: DataFrame, qid: str, doc_id: str) -> DataFrame:
    """Relevance as a set for each query, however often and in whatever rows it is given: qid, doc_id, once each."""
    return rows.select(F.col(qid).alias("qid"), F.col(doc_id).alias("doc_id")).where("qid IS NOT NULL AND doc_id IS NOT NULL").distinct()


def labelled(queries: DataFrame, relevant: DataFrame) -> DataFrame:
    """Queries that have a relevant document."""
    return queries.join(relevant.select("qid").distinct(), "qid", "left_semi")


def documents_of(hits: DataFrame) -> DataFrame:
    """Hits of chunks (qid, chunk_id, doc_id, rank) as hits of documents, each by its best chunk, in the same order, ranks closed up."""
    best = hits.groupBy("qid", "doc_id").agg(F.min("rank").alias("chunk_rank"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("chunk_rank")).cast("long")).select("qid", "doc_id", "rank")


def hit_flags(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """qid, relevant (how many), hit_at_1, hit_at_10 of labelled queries."""
    sizes = relevant.groupBy("qid").agg(F.count(F.lit(1)).alias("relevant"))
    found = hits.join(relevant, ["qid", "doc_id"], "left_semi").groupBy("qid").agg(F.min("rank").alias("first"))
    return sizes.join(found, "qid", "left").select("qid", "relevant", *[F.coalesce(F.col("first") <= k, F.lit(False)).alias(f"hit_at_{k}") for k in (1, 10)])


def hit_flags_by_label(hits: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    """``hit_flags`` where a query's relevant documents are those of its label: hits, queries (qid, label) and documents (doc_id, label).

    Documents are counted a label and hits look theirs up, so that no pair of a query and a relevant document is made. A query
    may have several labels, and a document too; a document counts once a query.
    """
    asked = queries.where("qid IS NOT NULL").select("qid", "label").distinct()
    known = documents.where("doc_id IS NOT NULL").select("doc_id", "label").distinct()
    wanted = asked.groupBy("qid").agg(F.array_sort(F.collect_set("label")).alias("labels"))  # labels of one query
    held = known.groupBy("doc_id").agg(F.collect_set("label").alias("own"))  # labels of one document
    # a document of several of the query's labels counts once: each set of labels that documents have is one kind
    kinds = held.groupBy(F.array_sort("own").alias("own")).agg(F.count(F.lit(1)).alias("n"))
    sought = wanted.select("labels").distinct().select("labels", F.explode("labels").alias("label")).join(kinds.select("own", "n", F.explode("own").alias("label")), "label")
    asked_kinds = sought.select("labels", "own", "n").distinct().groupBy("labels").agg(F.sum("n").alias("relevant"))
    sizes = wanted.join(asked_kinds, "labels").select("qid", "relevant")
    found = hits.join(wanted, "qid").join(held, "doc_id").where(F.arrays_overlap("labels", "own")).groupBy("qid").agg(F.min("rank").alias("first"))
    return sizes.join(found, "qid", "left").select("qid", "relevant", *[F.coalesce(F.col("first") <= k, F.lit(False)).alias(f"hit_at_{k}") for k in (1, 10)])


#: Rows that a report lists at most, and the candidates that an evaluation asks for.
LISTED, CANDIDATES = 200, 200


def evaluation(hits: DataFrame, relevant: DataFrame, runs: DataFrame | None = None, warmup: int = 3, budget_ms: float = 200.0) -> dict[str, DataFrame]:
    """The retrieval evaluation of chunk hits (qid, chunk_id, doc_id, rank): metrics, per_query, latency and budget.

    ``runs`` (qid, stage, ms, nth) are the timings; the first ``warmup`` queries by nth count for nothing.
    """
    if runs is not None:
        warm = runs.select("qid", "nth").distinct().where(F.col("nth") <= warmup).select("qid")
        hits, relevant, runs = (df.join(warm, "qid", "left_anti") for df in (hits, relevant, runs))
    documents = documents_of(hits.where(F.col("rank") <= CANDIDATES))
    each = ir_metrics(documents, relevant)
    out = {"metrics": macro(each), "per_query": hit_flags(documents, relevant).orderBy("qid").limit(LISTED)}
    if runs is not None:
        out["latency"] = analytics.percentiles(runs, "stage", "ms", linear=True)
        out["budget"] = analytics.budget(runs.where("stage = 'total'"), "stage", "ms", budget_ms)
    return out


def latency_report(runs: DataFrame, slo_ms: float = 200.0) -> dict[str, DataFrame]:
    """For runs (stage, lang, endpoint, outcome, ms): percentiles by stage and by language, the share within the objective, the share answered.

    Totals are of queries only; what retrieval takes is pooled over both endpoints.
    """
    totals = runs.where("stage = 'total' AND endpoint = 'query'")
    return {
        "stages": analytics.percentiles(runs.where("stage <> 'total'").unionByName(totals), "stage", "ms"),
        "languages": analytics.percentiles(totals, "lang", "ms", (50, 100)),
        "objective": runs.where("stage = 'retrieval'").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("ms") < slo_ms).cast("double")), 4).alias("pass_rate")),
        "answered": totals.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("outcome") == "answered").cast("double")), 4).alias("answered_rate")),
    }


#: The legs of a spoken question, in order.
LEGS = ("stt", "retrieval", "generation", "tts")


def leg_report(runs: DataFrame) -> DataFrame:
    """Percentiles of each leg of spoken questions (run, leg, ms), and of all of a run's legs together as e2e."""
    whole = runs.where(F.col("leg").isin(*LEGS)).groupBy("run").agg(F.sum("ms").alias("ms")).withColumn("leg", F.lit("e2e"))
    return analytics.percentiles(runs.where(F.col("leg").isin(*LEGS)).select("leg", "ms").unionByName(whole.select("leg", "ms")), "leg", "ms")


def probe_latency(probes: DataFrame, group: str = "store", value: str = "ms") -> DataFrame:
    """p50, p90 and p100 of a fixed number of probes by position: half way, nine tenths and last in ascending order."""
    placed = ranks.counted(probes, group, value)
    at = lambda share: F.floor(F.col("n") * share).cast("long") + 1
    return placed.groupBy(group).agg(ranks.at_rank(value, at(0.5)).alias("p50"), ranks.at_rank(value, at(0.9)).alias("p90"), ranks.at_rank(value, F.col("n")).alias("p100"))


def bars(df: DataFrame, group: str) -> DataFrame:
    """Counts of a group, largest first, with each one's share of the largest: what a dashboard draws."""
    counts = analytics.group_counts(df, group)
    most = counts.agg(F.max("n").alias("most"))
    return counts.crossJoin(F.broadcast(most)).select(group, "n", F.round(F.col("n") / F.greatest("most", F.lit(1)), 4).alias("width")).orderBy(F.desc("n"), group)


#: Stages that count as retrieval, up to the end of its budget.
RETRIEVAL_STAGES = ("normalize", "guards.input", "embed", "guard.offtopic", "retrieve", "fuse", "guard.confidence")


def request_totals(spans: DataFrame) -> DataFrame:
    """For spans (request, stage, ms, start, end): retrieval_ms, generation_ms, span_ms, and whether all stages went well."""
    pick = lambda *names: F.round(F.coalesce(F.sum(F.when(F.col("stage").isin(*names), F.col("ms"))), F.lit(0.0)), 3)
    return spans.groupBy("request").agg(pick(*RETRIEVAL_STAGES).alias("retrieval_ms"), pick("generate").alias("generation_ms"), F.round(F.max("end") - F.min("start"), 3).alias("span_ms"), F.every("ok").alias("ok"))


def save_report(report: dict[str, DataFrame], folder: str) -> None:
    """Each part as JSON, and as CSV with a header where it is flat."""
    for name, df in report.items():
        df.write.mode("overwrite").json(f"{folder}/{name}.json")
        if not any(kind.startswith(("array", "map", "struct")) for _, kind in df.dtypes):
            df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")


def format_report(spark: SparkSession, folder: str) -> str:
    """A saved evaluation as lines of text: every metric, then every stage's percentiles, then the budget."""
    rows = lambda name: [r.asDict() for r in spark.read.json(f"{folder}/{name}.json").collect()]
    lines = [f"{k}: {v}" for r in rows("metrics") for k, v in sorted(r.items())]
    lines += [f"{r['stage']}: " + ", ".join(f"{k} {v:.2f}" for k, v in sorted(r.items()) if k.startswith("p")) for r in sorted(rows("latency"), key=lambda r: r["stage"])]
    return "\n".join([*lines, *(f"within budget: {r['within']} of {r['n']} ({r['pct']} %)" for r in rows("budget"))])
