"""Lexical and dense indexes as tables, exact top-k, two-stage binary search, fusion, diversity re-ranking.

All queries of a batch go through one plan; ``qid`` and ``strategy`` are columns. Every rank has a tie-break by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions import vectors as V

K1, B = 1.5, 0.75
RRF_K = 60
#: Weights of the strategies in the fusion; 1 for any other.
WEIGHTS = {"contextual": 1.2, "bm25": 0.8}


#: Terms of a query batch up to which they are broadcast; beyond, they are joined by shuffle.
BROADCAST_TERMS = 200_000


def postings(chunks: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """chunk_id, term, tf, dl; only for the wanted terms, which are sieved out before anything is counted or shuffled."""
    words = chunks.select("chunk_id", T.tokens(F.col("text")).alias("tokens"))
    terms = words.select("chunk_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    if wanted is not None:
        few = wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
        terms = terms.join(F.broadcast(wanted) if few else wanted, "term", "left_semi")
    return terms.groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").cast("long").alias("dl"))


def term_statistics(index: DataFrame, n_chunks: int) -> DataFrame:
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.log(1 + (n_chunks - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def bm25(chunks: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """qid, chunk_id, score, rank.

    The texts are read twice and nothing but counts and each task's own top k is shuffled: once for the chunks that hold each
    query term and the mean length, once for the scores, a block of queries at a time. Terms up to ``BROADCAST_TERMS`` travel
    with the function; beyond, postings are joined by shuffle.
    """
    wanted = queries.select("qid", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
    terms = [r["term"] for r in wanted.select("term").distinct().limit(BROADCAST_TERMS + 1).collect()]
    if len(terms) > BROADCAST_TERMS or queries.limit(BLOCK + 1).count() > BLOCK:
        return bm25_by_postings(postings(chunks, wanted.select("term").distinct()), chunks.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(T.tokens(F.col("text")))).alias("avgdl")), wanted, k)
    words = chunks.select("chunk_id", T.tokens(F.col("text")).alias("tokens"))

    def counted(batch: pa.RecordBatch, value_set: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Chunk, term and number of each pair of both that meet, and the chunks' lengths."""
        lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place = pc.fill_null(pc.index_in(batch.column(1).flatten(), value_set=value_set), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(lengths)), lengths)[place >= 0]
        pair, tf = np.unique(row * len(value_set) + place[place >= 0], return_counts=True)
        return pair // max(1, len(value_set)), pair % max(1, len(value_set)), tf, lengths

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set, n, length = pa.array(terms, pa.string()), 0, 0
        df = np.zeros(len(terms), np.int64)
        for batch in batches:
            _, term, _, lengths = counted(batch, value_set)
            df += np.bincount(term, minlength=len(terms))
            n, length = n + len(lengths), length + int(lengths.sum())
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *held.tolist()], pa.int64()), pa.array([n, length, *df[held].tolist()], pa.int64())], names=["term", "n"])

    sums = {r["term"]: r["n"] for r in words.mapInArrow(frequencies, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, avgdl = sums.get(-2, 0), (sums.get(-1, 0) / sums[-2] if sums.get(-2) else 0) or 1.0
    df = np.array([sums.get(i, 0) for i in range(len(terms))], np.float64)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    place = {t: i for i, t in enumerate(terms)}
    asked: dict[int, list[tuple[int, float]]] = {}
    ids: dict[object, int] = {}
    for r in wanted.collect():  # at most ``BLOCK`` queries
        asked.setdefault(place[r["term"]], []).append((ids.setdefault(r["qid"], len(ids)), float(r["qtf"])))
    by_term = {t: (np.array([q for q, _ in own]), np.array([x for _, x in own]) * idf[t]) for t, own in asked.items()}
    qids, kind = list(ids), id_kind(words, "chunk_id")

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set, best = pa.array(terms, pa.string()), Best(len(qids), k, kind)
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                row, term, tf, lengths = counted(batch, value_set)
                weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[row] / avgdl))
                total = np.zeros((len(lengths), len(qids)))
                order = np.argsort(term, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(term[order])) + 1):
                    if len(own):
                        q, x = by_term[int(term[own[0]])]
                        total[np.ix_(row[own], q)] += weight[own, None] * x[None, :]
                best.add(ids_of(batch.column(0), kind), np.round(total, 4), total > 0)
        yield best.batch(qids)

    found = with_ids(words, "chunk_id").mapInArrow(scores, f"qid bigint, chunk_id {kind}, score double")
    return top_k(found, k)


def id_kind(df: DataFrame, column: str) -> str:
    """bigint for ids that are whole numbers, string for any others."""
    return "bigint" if df.schema[column].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string"


def with_ids(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast(id_kind(df, column)))


def ids_of(values: pa.Array | list, kind: str) -> np.ndarray:
    """Ids as an array that sorts as Spark sorts them."""
    if kind == "bigint":
        return values.to_numpy(zero_copy_only=False).astype(np.int64) if isinstance(values, pa.Array) else np.array(values, np.int64)
    return np.array(values.to_pylist() if isinstance(values, pa.Array) else values, np.str_)


class Best:
    """A task's own top k of each query, by score and then id; what ties at the end is settled by id."""

    def __init__(self, queries: int, k: int, kind: str = "bigint"):
        self.k, self.kind = k, kind
        self.ids: list[np.ndarray] = [ids_of([], kind)] * queries
        self.scores: list[np.ndarray] = [np.empty(0)] * queries

    def add(self, ids: np.ndarray, scores: np.ndarray, valid: np.ndarray | None = None) -> None:
        """Scores of these ids (rows) for every query (columns)."""
        for q in range(len(self.ids)):
            s, i = scores[:, q], ids
            if valid is not None:
                s, i = s[valid[:, q]], i[valid[:, q]]
            if len(self.ids[q]) == self.k:
                keep = s >= self.scores[q][-1]
                s, i = s[keep], i[keep]
            if not len(s):
                continue
            s, i = np.append(self.scores[q], s), np.append(self.ids[q], i)
            if len(s) > 4 * self.k:
                keep = s >= -np.partition(-s, self.k - 1)[self.k - 1]
                s, i = s[keep], i[keep]
            order = np.lexsort((i, -s))[: self.k]
            self.scores[q], self.ids[q] = s[order], i[order]

    def batch(self, qids: list) -> pa.RecordBatch:
        q = [qid for qid, own in zip(qids, self.ids, strict=True) for _ in own]
        flat = lambda parts, empty: np.concatenate([empty, *parts]) if parts else empty
        ids = flat(self.ids, ids_of([], self.kind))
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(ids, pa.int64()) if self.kind == "bigint" else pa.array(ids.tolist(), pa.string()), pa.array(flat(self.scores, np.empty(0)))], names=["qid", "chunk_id", "score"])


def bm25_by_postings(index: DataFrame, size: DataFrame, wanted: DataFrame, k: int = 10) -> DataFrame:
    """qid, chunk_id, score, rank from postings (chunk_id, term, tf, dl), one row of (n, avgdl), and query terms (qid, term, qtf)."""
    held = size.first()
    terms = term_statistics(index, held["n"])
    avgdl = held["avgdl"] or 1.0
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
    weighted = index.join(terms, "term").select("term", "chunk_id", (F.col("idf") * weight).alias("w"))
    scored = weighted.join(wanted, "term").groupBy("qid", "chunk_id").agg(F.round(F.sum(F.col("qtf") * F.col("w")), 4).alias("score"))
    return top_k(scored, k)


def top_k(scored: DataFrame, k: int, by: str = "score", item: str = "chunk_id", partition: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Rank <= k; Spark takes each task's own top k before the shuffle."""
    order = Window.partitionBy(*partition).orderBy(F.desc(by), item)
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """qid, chunk_id, score, rank by exact inner product."""
    return top_k(dense_candidates(vectors, queries, k), k)


#: Queries and vectors that are multiplied at a time.
BLOCK, VECTORS = 4096, 16_384
#: Blocks of queries up to which they are broadcast to the vectors.
BROADCAST_BLOCKS = 16


def packed(rows: DataFrame, id_col: str, size: int, column: str = "embedding") -> DataFrame:
    """ids and what a column holds for them (vectors of numbers, or words of sign bits) end to end, at most ``size`` to a row; nothing is moved."""
    kind, number = id_kind(rows, id_col), np.int64 if column == "bits" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, size):
                batch = whole.slice(start, size)
                own = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(number)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_pylist()]), pa.array([own.tobytes()], pa.binary())], names=["ids", "vectors"])

    return with_ids(rows.where(F.col(id_col).isNotNull() & F.col(column).isNotNull()).select(id_col, column), id_col).mapInArrow(run, f"ids array<{kind}>, vectors binary")


def blocks_met(vectors: DataFrame, queries: DataFrame, column: str = "embedding") -> DataFrame:
    """Each block of the stated queries (qids, asked) beside each block of vectors (ids, vectors).

    Queries of a few blocks travel to the vectors. More are laid out as a grid: each block of vectors belongs to one of its
    columns, each block of queries goes to every column once, and those of a column meet; the vectors move once.
    """
    known = queries.limit(BROADCAST_BLOCKS * BLOCK + 1).count()
    q = packed(queries.coalesce(1) if known <= BLOCK else queries, "qid", BLOCK, column).select(F.col("ids").alias("qids"), F.col("vectors").alias("asked"))
    own = packed(vectors, "vec_id", VECTORS, column)
    if known <= BROADCAST_BLOCKS * BLOCK:
        return own.crossJoin(F.broadcast(q))
    columns = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    everywhere = q.withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    return own.withColumn("column", F.pmod(F.xxhash64("ids"), F.lit(columns)).cast("int")).join(everywhere, "column").drop("column")


def _matrices(batch: pa.RecordBatch, kind: str, number: type = np.float64) -> Iterator[tuple[np.ndarray, np.ndarray, list, np.ndarray]]:
    for k in range(batch.num_rows):
        ids, qids = ids_of(batch.column(0)[k].as_py(), kind), batch.column(2)[k].as_py()
        yield ids, np.frombuffer(batch.column(1)[k].as_py(), number).reshape(len(ids), -1), qids, np.frombuffer(batch.column(3)[k].as_py(), number).reshape(len(qids), -1)


def dense_candidates(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Each task's own top k, to be ranked; candidates of several strategies are united before they are ranked.

    Exact inner products of blocks of queries with blocks of vectors, by matrix products where the vectors are. Ids of vectors may be of any type.
    """
    kind = id_kind(vectors, "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, own, qids, asked in _matrices(batch, kind):
                best = Best(len(qids), k, kind)
                for start in range(0, len(ids), 1024):
                    best.add(ids[start : start + 1024], np.round(own[start : start + 1024] @ asked.T, 6))
                yield best.batch(qids)

    return blocks_met(vectors, queries).mapInArrow(run, f"qid bigint, chunk_id {kind}, score double")


def sign_shortlist(signs: DataFrame, queries: DataFrame, short: int) -> DataFrame:
    """qid, chunk_id, hamming, place up to ``short``: the vectors (vec_id, bits) whose sign bits differ least from the query's (qid, bits). No float is read."""
    kind = id_kind(signs, "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, own, qids, asked in _matrices(batch, kind, np.uint64):
                best = Best(len(qids), short, kind)
                for start in range(0, len(ids), 1024):
                    apart = np.bitwise_count(own[start : start + 1024, None, :] ^ asked[None, :, :]).sum(axis=2, dtype=np.int64)
                    best.add(ids[start : start + 1024], -apart.astype(np.float64))
                yield best.batch(qids)

    near = blocks_met(signs, queries, "bits").mapInArrow(run, f"qid bigint, chunk_id {kind}, score double")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= short).select("qid", "chunk_id", (-F.col("score")).cast("long").alias("hamming"), "place")


def binary_search(vectors: DataFrame, queries: DataFrame, limit: int = 10, oversampling: int = 3, filtered: bool = False, rescore: bool = True, threshold: float | None = None) -> DataFrame:
    """Shortlist by Hamming distance of sign bits, then cosine of the shortlist. Queries (qid, embedding) are a stated batch.

    Without ``rescore`` no float is read at all: the score is the share of equal signs, from -1 to 1. Only hits whose score
    reaches ``threshold`` are returned.

    The first phase reads the words of sign bits that an index stores beside the vectors (vec_id, embedding, bits), or makes
    them where there are none; the second fetches the floats of the shortlist alone, by key.
    """
    short = max(limit * oversampling, 3 * limit, 64) * (4 if filtered else 1)
    signs = vectors.select("vec_id", "bits" if "bits" in vectors.columns else V.sign_words(F.col("embedding")).alias("bits"))
    listed = sign_shortlist(signs, queries.select("qid", V.sign_words(F.col("embedding")).alias("bits")), short)
    reached = lambda df: df if threshold is None else df.where(F.col("score") >= threshold)
    if not rescore:
        sizes = queries.select("qid", F.size("embedding").alias("size"))
        return top_k(reached(listed.join(sizes, "qid").select("qid", "chunk_id", "hamming", F.round(1 - 2 * F.col("hamming") / F.col("size"), 6).alias("score"))), limit)
    few = queries.limit(BLOCK + 1).count() <= BLOCK  # then the list has at most BLOCK * short rows of numbers
    floats = vectors.select(F.col("vec_id").alias("chunk_id"), "embedding").join(F.broadcast(listed) if few else listed, "chunk_id")
    asked = queries.select("qid", F.col("embedding").alias("asked"))
    scored = floats.join(F.broadcast(asked) if few else asked, "qid").select("qid", "chunk_id", "hamming", F.round(V.dot(F.col("embedding"), F.col("asked")), 6).alias("score"))
    return top_k(reached(scored), limit)


def centroid_gate(vectors: DataFrame, centroids: DataFrame, threshold: float = 0.70) -> DataFrame:
    """Highest cosine with any centroid (a table of at most 64 rows), and whether it reaches the threshold; vectors stay where they are."""
    if centroids.limit(BLOCK + 1).count() > BLOCK:
        raise ValueError("more centroids than one block")
    one_row = F.broadcast(centroids.agg(F.collect_list("centroid").alias("centroids")))
    highest = F.array_max(F.transform("centroids", lambda c: V.dot(F.col("embedding"), c)))
    near = vectors.crossJoin(one_row).select("vec_id", F.round(highest, 6).alias("similarity"))
    return near.withColumn("on_topic", F.col("similarity") >= threshold)


def label_centroids(vectors: DataFrame) -> DataFrame:
    each = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))
    return mean.select("label", V.l2_normalize(F.col("centroid")).alias("centroid"))


def kmeans_centroids(vectors: DataFrame, seed: int = 1234, iterations: int = 20) -> DataFrame:
    """k = min(64, max(1, n // 10)) centroids at unit length."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    k = min(64, max(1, vectors.count() // 10))
    model = KMeans(k=k, maxIter=iterations, seed=seed, featuresCol="features").fit(vectors.select(array_to_vector("embedding").alias("features")))
    rows = [(i, (c / (np.linalg.norm(c) or 1)).tolist()) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "cid int, centroid array<double>")


#: Strategies in the order that settles ties; others come after them, by name.
STRATEGY_ORDER = ("fixed", "fixed_tokens", "sentence", "semantic", "contextual")


def rrf(hits: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """Document-level weighted reciprocal-rank fusion of hits (qid, strategy, rank, chunk_id, doc_id, score).

    A document counts once a strategy, by its best chunk's own rank; ranks aren't closed up. BM25 has no say in the best dense
    chunk, for which only each strategy's best one competes; of equal scores the first strategy's wins.
    """
    best = hits.groupBy("qid", "strategy", "doc_id").agg(F.min("rank").alias("rank"), F.min_by("chunk_id", "rank").alias("chunk_id"), F.min_by("score", "rank").alias("score"))
    weight = F.lit(1.0)
    for name, w in (WEIGHTS if weights is None else weights).items():
        weight = F.when(F.col("strategy") == name, w).otherwise(weight)
    dense = F.col("strategy") != "bm25"
    order = F.lit(len(STRATEGY_ORDER))
    for place, name in enumerate(STRATEGY_ORDER):
        order = F.when(F.col("strategy") == name, place).otherwise(order)
    fused = best.groupBy("qid", "doc_id").agg(
        F.round(F.sum(weight / (k + F.col("rank"))), 8).alias("rrf_score"),
        F.coalesce(F.min(F.when(dense, F.struct((-F.col("score")).alias("s"), order.alias("o"), "strategy", "chunk_id")))["chunk_id"], F.min("chunk_id")).alias("best_chunk_id"),
        F.coalesce(F.max(F.when(dense, F.col("score"))), F.lit(0.0)).alias("best_dense_score"),
        F.count(F.lit(1)).alias("n_strategies"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("strategy", "rank")))).alias("strategies"),
    )
    order = Window.partitionBy("qid").orderBy(F.desc("rrf_score"), F.desc("best_dense_score"), "doc_id")
    return fused.withColumn("rank", F.row_number().over(order).cast("long"))


def flatness(fused: DataFrame, depth: int = 10) -> DataFrame:
    """First over ``depth``-th score; null (endless) for fewer documents."""
    return fused.groupBy("qid").agg(F.max("rrf_score").alias("top_score"), F.count(F.lit(1)).alias("n_candidates"), F.round(F.max("rrf_score") / F.max(F.when(F.col("rank") == depth, F.col("rrf_score"))), 6).alias("flatness"))


def mmr(hits: DataFrame, vectors: DataFrame | None, top: int = 5, pool: int = 30, weight: float = 0.7, key: str = "doc_id") -> DataFrame:
    """Greedy maximal marginal relevance over the first ``pool`` hits of each query; without vectors the order stays.

    ``key`` names the column, of hits and vectors, that a hit's vector is found by: its best chunk's, where there are several.
    """
    few = hits.where(F.col("rank") <= pool).select("qid", "doc_id", "rank", "rrf_score", *([key] if key != "doc_id" else []))
    kind = few.schema["doc_id"].dataType.simpleString()
    few = few.join(vectors.select(key, "embedding"), key, "left") if vectors is not None else few.withColumn("embedding", F.lit(None).cast("array<double>"))

    gathered = few.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", F.col("rrf_score").cast("double").alias("rrf_score"), F.col("embedding").cast("array<double>").alias("embedding")))).alias("hits"))  # at most ``pool``

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            qids, docs, places = [], [], []
            for qid, own in zip(batch.column("qid").to_pylist(), batch.column("hits").to_pylist(), strict=True):
                known = np.array([h["embedding"] is not None for h in own])
                size = next((len(h["embedding"]) for h in own if h["embedding"] is not None), 0)
                held = np.array([h["embedding"] if h["embedding"] is not None else [0.0] * size for h in own]).reshape(len(own), size)
                score, nearest = weight * 100 * np.array([h["rrf_score"] for h in own]), np.full(len(own), -np.inf)
                rest, at = np.ones(len(own), bool), 0  # the first hit leads
                for place in range(1, min(top, len(own)) + 1):
                    qids.append(qid), docs.append(own[at]["doc_id"]), places.append(place)
                    rest[at] = False
                    if known[at]:
                        nearest = np.where(known, np.maximum(nearest, held @ held[at]), nearest)
                    gain = score - (1 - weight) * np.where(np.isneginf(nearest), 0.0, nearest)
                    at = int(np.where(rest, gain, -np.inf).argmax())
            yield pa.RecordBatch.from_arrays([pa.array(qids, pa.int64()), pa.array(docs, batch.schema.field("hits").type.value_type.field("doc_id").type), pa.array(places, pa.int64())], names=["qid", "doc_id", "place"])

    return gathered.mapInArrow(pick, f"qid bigint, doc_id {kind}, place bigint")


def rerank(candidates: DataFrame, score: Column | None, top: int | None = None, normalize: bool = True) -> DataFrame:
    """Candidates (qid, chunk_id, query, text, rank) in the order of a scoring column, its sigmoid by default, new ranks from 0; of equal scores
    the earlier candidate stays first. Without a score, because the model can't be had, they stay as they are and say so (``degraded``)."""
    if score is None:
        scored, order = candidates.withColumn("rerank_score", F.lit(None).cast("double")), [F.col("rank")]
    else:
        scored, order = candidates.withColumn("rerank_score", V.sigmoid(score) if normalize else score.cast("double")), [F.desc(F.coalesce("rerank_score", F.lit(0.0))), F.col("rank")]
    placed = scored.withColumn("rank", (F.row_number().over(Window.partitionBy("qid").orderBy(*order, "chunk_id")) - 1).cast("long")).withColumn("degraded", F.lit(score is None))
    return placed.where(F.col("rank") < top) if top else placed
