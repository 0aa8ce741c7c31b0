"""The façade: settings, a session, and the retrieval service's calls as functions from a batch of queries to a DataFrame."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import answers, graph, index, retrieval, service
from quillstone.sources import tables


def _flag(value: str) -> bool:
    return value.strip().lower() in ("1", "true", "yes", "on")


@dataclass(frozen=True)
class Settings:
    """Every field can be set by an environment variable, its name in capitals behind a prefix."""

    top_k: int = 8
    pool: int = 50
    candidates: int = 50
    confidence_tau: float = 0.35
    sign_bits: bool = False
    oversampling: int = 3
    by_graph: bool = False
    probes: int = 3
    beam: int = 64
    rrf_k: int = 60
    mmr_weight: float = 0.7
    mmr_pool: int = 30
    offtopic_tau: float = 0.70
    top_score_tau: float = 0.72
    flatness_min: float = 1.04
    grounding_tau: float = 0.55
    grounding_refuse: float = 0.60
    grounding_warn: float = 0.85
    context_chars: int = 6000
    answer_chars: int = 800
    budget_ms: float = 200.0
    daily_cap: int = 200
    breaker_threshold: int = 4
    breaker_cooldown_s: float = 30.0

    @classmethod
    def from_environment(cls, prefix: str = "QUILLSTONE_", environment: Mapping[str, str] | None = None) -> Settings:
        found = os.environ if environment is None else environment
        return cls(**{f.name: (_flag if isinstance(f.default, bool) else type(f.default))(found[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in found})


def session(master: str | None = None, partitions: int | None = None) -> SparkSession:
    """Adaptive, UTC; a union's partitions aren't relied on, as its sides may be coalesced apart."""
    builder = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.unionOutputPartitioning", "false")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", partitions)
    return builder.getOrCreate()


@dataclass
class Engine:
    """``chunks`` (chunk_id, doc_id, strategy, text, display_text) and ``vectors`` (vec_id = chunk_id, embedding, strategy).

    ``centroids`` (cid, centroid) gate topics where they are given. ``generate`` adds a column ``generated`` (answer,
    cited_chunk_ids, used_context; null if it failed) to rows of qid, text and contexts; without one, answers are the
    beginning of the first context. ``embed`` turns sentences into vectors for the groundedness check.
    """

    chunks: DataFrame
    vectors: DataFrame
    settings: Settings = Settings()
    centroids: DataFrame | None = None
    generate: Callable[[DataFrame], DataFrame] | None = None
    embed: Callable | None = None
    parts: dict[str, DataFrame] | None = None

    @classmethod
    def from_index(cls, parts: dict[str, DataFrame], **options) -> Engine:
        """Over a stored index, as index.load gives it: searches by its rows, its postings and, if settings say so, its sign bits or its graphs."""
        if "vectors" not in parts:
            raise ValueError("no dense index: at least one strategy must have vectors")
        return cls(parts["chunks"], parts["vectors"].withColumnRenamed("chunk_id", "vec_id"), parts=parts, **options)

    def __post_init__(self) -> None:
        if not self.vectors.limit(1).count():
            raise ValueError("no dense index: at least one strategy must have vectors")

    def search(self, queries: DataFrame, strategies: list[str] | None = None) -> DataFrame:
        """Hits of the dense strategies and of BM25 for queries (qid, text, embedding), ranked in one window; all strategies, or those named."""
        pool, stored = self.settings.pool, self.parts
        names = [r["strategy"] for r in self.vectors.select("strategy").distinct().collect() if strategies is None or r["strategy"] in strategies]
        key = "row" if stored else "vec_id"
        parts = [self._near(self._keyed(self.vectors.where(F.col("strategy") == s), key), queries, pool, s).select("qid", "chunk_id", "score").withColumn("strategy", F.lit(s)) for s in names]
        if strategies is None or "bm25" in strategies:
            asked = queries.select("qid", "text")
            lexical = index.searched(stored, asked, pool)[0].withColumnRenamed("row", "chunk_id") if stored else retrieval.bm25(self.chunks.select("chunk_id", "text"), asked, pool)
            parts.append(lexical.select("qid", "chunk_id", "score").withColumn("strategy", F.lit("bm25")))
        if not parts:
            raise ValueError(f"none of {strategies} is indexed")
        ranked = retrieval.top_k(reduce(DataFrame.unionByName, parts), pool, partition=("qid", "strategy"))
        return index.named(stored, ranked.withColumnRenamed("chunk_id", "row"), "doc_id").drop("row") if stored else ranked.join(self.chunks.select("chunk_id", "doc_id"), "chunk_id")

    @staticmethod
    def _keyed(vectors: DataFrame, key: str) -> DataFrame:
        return vectors.drop(*{"row", "vec_id"} - {key}).withColumnRenamed(key, "vec_id")

    def _near(self, vectors: DataFrame, queries: DataFrame, pool: int, strategy: str | None = None) -> DataFrame:
        """Exact, unless settings say otherwise: by the stored graph of a strategy (a scope has none of its own), or by sign bits."""
        if self.settings.by_graph and strategy and self.parts and "graph" in self.parts:
            walked = self.parts["graph"].where(F.col("strategy") == strategy)
            return graph.top_k(walked, queries, self.parts.get("centroids"), pool, self.settings.probes, max(self.settings.beam, pool))
        if self.settings.sign_bits:
            return retrieval.binary_search(vectors, queries, pool, self.settings.oversampling)
        return retrieval.dense_candidates(vectors, queries, pool)

    def gate(self, queries: DataFrame) -> DataFrame:
        """qid, similarity with the nearest centroid; null without centroids."""
        if self.centroids is None:
            return queries.select("qid", F.lit(None).cast("double").alias("similarity"))
        return retrieval.centroid_gate(queries.select(F.col("qid").alias("vec_id"), "embedding"), self.centroids, self.settings.offtopic_tau).select(F.col("vec_id").alias("qid"), "similarity")

    def retrieve(self, queries: DataFrame, strategies: list[str] | None = None, diverse: bool = False, explain: bool = False) -> DataFrame:
        """The first documents of each query with their best chunk's text; ``diverse`` picks them by marginal relevance, ``explain`` adds their ranks by strategy."""
        fused = retrieval.rrf(self.search(queries, strategies), k=self.settings.rrf_k)
        if diverse:
            keyed = self.vectors.select(F.col("vec_id").alias("best_chunk_id"), "embedding").dropDuplicates(["best_chunk_id"])
            places = retrieval.mmr(fused, keyed, self.settings.top_k, self.settings.mmr_pool, self.settings.mmr_weight, "best_chunk_id")
            first = fused.join(places, ["qid", "doc_id"]).withColumn("rank", F.col("place")).drop("place")
        else:
            first = fused.where(F.col("rank") <= self.settings.top_k)
        shown = F.coalesce(F.expr("nullif(display_text, '')"), "text", F.lit("")).alias("context")
        found = first.join(self.chunks.select(F.col("chunk_id").alias("best_chunk_id"), shown), "best_chunk_id", "left")
        return found if explain else found.drop("strategies")

    def query(self, queries: DataFrame, debug: bool = False) -> DataFrame:
        """One row a query of (qid, text, embedding): answer or refusal, citations and checks, as service.answered_v2. Refused inputs aren't searched."""
        asked = queries.withColumn("text", T.normalize(F.col("text")))
        passed = asked.where(service.input_reason(F.col("text")).isNull())
        fused = retrieval.rrf(self.search(passed), k=self.settings.rrf_k)
        confidence = fused.groupBy("qid").agg(F.max("best_dense_score").alias("top_score")).join(retrieval.flatness(fused).select("qid", "flatness"), "qid")
        shown = F.coalesce(F.expr("nullif(display_text, '')"), "text", F.lit("")).alias("context")
        first = fused.where(F.col("rank") <= self.settings.top_k).join(self.chunks.select(F.col("chunk_id").alias("best_chunk_id"), shown), "best_chunk_id", "left")
        contexts = first.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("best_chunk_id").cast("string").alias("chunk_id"), F.col("context").alias("text")))), lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["text"].alias("text"))).alias("contexts"))
        rows = asked.select("qid", "text").join(self.gate(passed), "qid", "left").join(confidence, "qid", "left").join(contexts, "qid", "left")
        rows = rows.withColumn("contexts", F.coalesce("contexts", F.array().cast("array<struct<chunk_id:string,text:string>>")))
        rows = self.generate(rows) if self.generate else rows.withColumn("generated", self._extract())
        s = self.settings
        return service.answered_v2(self._grounded(rows), s.offtopic_tau, s.top_score_tau, s.flatness_min, s.grounding_refuse, s.grounding_warn, debug)

    def answer(self, queries: DataFrame, scope: str = "all", strategy: str | None = None, score: Callable[[Column, Column], Column] | None = None, threshold: float | None = None) -> DataFrame:
        """The v1 path, one row a query of (qid, text, embedding): guards, search in scope, rerank, confidence, generation, groundedness.

        qid, query (sanitized), language, status, answer, citations, grounding (verdict, null where it isn't asked), warnings. A
        scope other than all needs ``lang`` beside the vectors. ``score`` (query, text) reranks; without it the order of the search
        stays, and says so. Where generation fails, or there is none, the answer is extractive. Queries that a guard refuses aren't searched.
        """
        s = self.settings
        asked = queries.select("qid", "text", "embedding", service.screened_v1(F.col("text")).alias("screened"), T.sanitize(F.col("text")).alias("query")).withColumn("language", T.script_lang(F.col("query")))
        passed = asked.where("screened IS NULL")
        hits = self._in_scope(passed, scope, strategy)
        hits = hits if threshold is None else hits.where(F.col("score") >= threshold)
        shown = self.chunks.select("chunk_id", F.coalesce(F.expr("nullif(display_text, '')"), "text", F.lit("")).alias("passage"))
        candidates = hits.join(shown, "chunk_id").join(passed.select("qid", "query"), "qid").withColumn("text", F.col("passage"))
        ranked = retrieval.rerank(candidates, None if score is None else score(F.col("query"), F.col("passage")), s.top_k)
        kept = ranked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "passage", F.coalesce("rerank_score", "score").alias("score")))).alias("kept"))
        rows = asked.join(kept, "qid", "left")
        rows = rows.withColumns({"contexts": F.coalesce(F.transform("kept", lambda c: F.struct(c["chunk_id"].cast("string").alias("chunk_id"), c["passage"].alias("text"))), F.array().cast("array<struct<chunk_id:string,text:string>>")), "scores": F.coalesce(F.transform("kept", lambda c: c["score"]), F.array().cast("array<double>"))})
        rows = rows.withColumn("early", F.coalesce("screened", F.when(answers.confidence_v1(F.col("scores"), s.confidence_tau) == "block", "refused_low_confidence")))
        rows = rows.drop("text").withColumn("text", F.col("query"))
        rows = self.generate(rows) if self.generate else rows.withColumn("generated", F.lit(None).cast("struct<answer:string,cited_chunk_ids:array<string>,used_context:boolean>"))
        rows = tables.written(rows.drop("kept", "embedding", "text"))
        said = rows.where("early IS NULL AND generated IS NOT NULL").select(F.col("qid").alias("aid"), F.col("generated.answer").alias("answer"), F.col("contexts.text").alias("passages"))
        judged = answers.grounded_v1(said).select(F.col("aid").alias("qid"), F.col("verdict").alias("grounding"))
        ids = F.transform("contexts", lambda c: c["chunk_id"])
        whole = rows.join(judged, "qid", "left")
        status = F.coalesce("early", F.when(F.col("generated").isNull(), "degraded_extractive"), F.when(F.col("grounding").startswith("block"), "refused_ungrounded"), F.lit("answered"))
        whole = whole.withColumn("status", status)
        answer = F.when(F.col("status") == "answered", F.col("generated.answer")).when(F.col("status") == "degraded_extractive", answers.extractive(F.col("contexts.text"), "v1")).otherwise(service.message_v1(F.col("status")))
        cited = F.when(F.col("status") == "answered", answers.kept_citations(F.col("generated.cited_chunk_ids"), ids, "v1")).when(F.col("status") == "degraded_extractive", F.slice(ids, 1, 1)).otherwise(F.array().cast("array<string>"))
        searched = F.col("screened").isNull() & (F.size("contexts") > 0)
        warnings = F.array_compact(F.array(
            F.when(searched & F.lit(score is None), "not reranked"),
            F.when(F.col("status") == "degraded_extractive", "not generated"),
            F.when(F.col("status").isin("answered", "refused_ungrounded") & ~F.coalesce("generated.used_context", F.lit(True)), "insufficient context"),
        ))
        return whole.select("qid", "query", "language", "status", answer.alias("answer"), cited.alias("citations"), "grounding", warnings.alias("warnings"))

    def _in_scope(self, queries: DataFrame, scope: str, strategy: str | None) -> DataFrame:
        """qid, chunk_id, score, rank (from 0) of the first candidates that each query (qid, embedding, language) sees; queries are searched by language, of which the registry knows a few."""
        service.within(scope, F.lit(None), F.lit(None))
        vectors = self.vectors.where(F.col("strategy") == strategy) if strategy else self.vectors
        key = "row" if self.parts else "vec_id"
        if scope == "all":
            parts = [self._near(self._keyed(vectors, key), queries, self.settings.candidates)]
        elif scope == "english":
            parts = [self._near(self._keyed(vectors.where("lang = 'en'"), key), queries, self.settings.candidates)]
        else:
            present = [r["language"] for r in queries.select("language").distinct().collect()]  # at most one a script
            parts = [self._near(self._keyed(vectors.where(F.col("lang") == code), key), queries.where(F.col("language") == code), self.settings.candidates) for code in present]
        none = self._keyed(vectors, key).limit(0).select(F.lit(0).cast("long").alias("qid"), F.col("vec_id").alias("chunk_id"), F.lit(0.0).alias("score"))
        found = retrieval.top_k(reduce(DataFrame.unionByName, [p.select("qid", "chunk_id", "score") for p in parts], none), self.settings.candidates).withColumn("rank", F.col("rank") - 1)
        return index.named(self.parts, found.withColumnRenamed("chunk_id", "row")).drop("row") if self.parts else found

    def _extract(self):
        first = F.get("contexts", F.lit(0))
        return F.when(F.size("contexts") > 0, F.struct(F.substring(first["text"], 1, self.settings.answer_chars).alias("answer"), F.array(first["chunk_id"]).alias("cited_chunk_ids"), F.lit(True).alias("used_context")))

    def _grounded(self, rows: DataFrame) -> DataFrame:
        """With grounded: the share of the answer's sentences that a context supports."""
        if self.embed is None:
            return rows.withColumn("grounded", F.lit(None).cast("double"))
        embed = self.embed

        @F.pandas_udf("array<double>")
        def vector(texts):
            import pandas as pd

            return pd.Series([v.tolist() for v in embed([t or "" for t in texts])], dtype=object)

        said = rows.where("generated IS NOT NULL").select("qid", "contexts", F.explode(T.split_sentences(T.normalize(F.col("generated.answer")))).alias("sentence")).withColumn("embedding", vector("sentence"))
        known = rows.select("qid", F.explode("contexts.text").alias("context")).withColumn("v", vector("context")).groupBy("qid").agg(F.collect_list("v").alias("known"))
        s = self.settings
        checked = answers.grounding_v2(said.join(known, "qid").select(F.col("qid").alias("aid"), "sentence", "embedding", F.col("known").alias("contexts")), s.grounding_tau, s.grounding_refuse, s.grounding_warn)
        return rows.join(checked.select(F.col("aid").alias("qid"), F.col("ratio").alias("grounded")), "qid", "left")

    def statistics(self) -> DataFrame:
        return self.chunks.groupBy("strategy").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("doc_id").alias("n_docs"))

    def health(self) -> dict[str, object]:
        """Whether there is something to search, and what; never raises."""
        try:
            found = {r["strategy"]: r["n_chunks"] for r in self.statistics().collect()}
        except Exception as e:  # noqa: BLE001
            return {"ready": False, "error": type(e).__name__, "strategies": {}}
        return {"ready": bool(found), "error": None, "strategies": found}
