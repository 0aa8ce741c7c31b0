"""Approximate search by neighbour graphs: vectors in cells of a bounded size, a navigable graph for each as a row of a table.

Vectors are dealt to their nearest centroid, where centroids are given, and each centroid's to as many cells as its vectors
fill, so that a cell holds ``CELL`` vectors or few more, whatever the centroids are. Without centroids all cells are walked:
the share of its vectors that a walk looks at falls as a cell grows, and is what saves work where vectors aren't in clusters. A cell's graph links each vector with near ones that aren't nearer
to each other, and with the nearest of those that came before it in a random order: the first of these links are long, and
every vector can be reached. A query goes to the cells of its nearest centroids and walks there, best first, with a beam.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import vectors as V
from quillstone.operators import index, retrieval

CELL, DEGREE, NEAR = 4096, 16, 48
GRAPH = "bucket int, cell int, ids array<{}>, vectors binary, edges binary, entry int"
#: Queries that meet a cell together.
ASKED = 1024


def linked(own: np.ndarray, degree: int = DEGREE, near: int = NEAR, seed: int = 7) -> np.ndarray:
    """Neighbours of each vector, -1 where there are fewer than 2 * degree."""
    n = len(own)
    edges: list[dict[int, None]] = [{} for _ in range(n)]
    order = np.random.default_rng(seed).permutation(n)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    for start in range(0, n, 512):
        block = np.arange(start, min(n, start + 512))
        close = own[block] @ own.T
        close[np.arange(len(block)), block] = -np.inf
        few = min(near, n - 1)
        candidates = np.argpartition(-close, few - 1, axis=1)[:, :few] if few else np.empty((len(block), 0), np.int64)
        earlier = np.where(place[None, :] < place[block][:, None], close, -np.inf)
        first = earlier.argmax(axis=1) if n > 1 else np.zeros(len(block), np.int64)
        for k, i in enumerate(block.tolist()):
            mine = candidates[k][np.argsort(-close[k, candidates[k]], kind="stable")]
            among = own[mine] @ own[mine].T
            kept: list[int] = []
            for c in range(len(mine)):
                if not kept or close[k, mine[c]] > among[c, kept].max():
                    kept.append(c)
                    if len(kept) == degree:
                        break
            edges[i].update(dict.fromkeys(mine[kept].tolist()))
            if place[i]:
                edges[i][int(first[k])] = None
    # links go both ways; the first ones a vector has stay
    for i in range(n):
        for j in [*edges[i]]:
            if len(edges[j]) < 2 * degree or place[i] > place[j]:
                edges[j][i] = None
    width = max(1, max(map(len, edges), default=1))
    out = np.full((n, width), -1, np.int32)
    for i, own_edges in enumerate(edges):
        out[i, : len(own_edges)] = [*own_edges]
    return out


def walked(own: np.ndarray, edges: np.ndarray, entry: int, query: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and products of the best k that a walk with this beam finds, and how many vectors it looked at."""
    seen = np.zeros(len(own), bool)
    seen[entry] = True
    first = float(own[entry] @ query)
    open_, best, looked = [(-first, entry)], [(first, entry)], 1
    while open_:
        near, i = heapq.heappop(open_)
        if len(best) >= beam and -near < best[0][0]:
            break
        next_ = edges[i]
        next_ = next_[next_ >= 0]
        next_ = next_[~seen[next_]]
        if not len(next_):
            continue
        seen[next_] = True
        looked += len(next_)
        for s, j in zip((own[next_] @ query).tolist(), next_.tolist(), strict=True):
            if len(best) < beam or s > best[0][0]:
                heapq.heappush(open_, (-s, j))
                heapq.heappush(best, (s, j))
                if len(best) > beam:
                    heapq.heappop(best)
    found = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
    return np.array([j for _, j in found], np.int64), np.array([s for s, _ in found]), looked


def build(vectors: DataFrame, centroids: DataFrame | None = None, cell: int = CELL) -> DataFrame:
    """One row a cell: ids, vectors and edges of the vectors (vec_id, embedding) dealt to it, and where a walk begins."""
    kind = retrieval.id_kind(vectors, "vec_id")
    known = retrieval.with_ids(vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", "embedding"), "vec_id")
    dealt = known.withColumn("bucket", F.lit(0)) if centroids is None else index.bucketed(known, centroids)
    cells = dealt.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("cells"))  # one row a centroid
    placed = dealt.join(F.broadcast(cells), "bucket").withColumn("cell", F.pmod(F.xxhash64("vec_id"), F.col("cells")).cast("int"))

    def graph(held: pa.Table) -> pa.Table:
        held = held.sort_by("vec_id")
        own = np.array(held.column("embedding").to_pylist(), np.float64)
        entry = int((own @ own.mean(axis=0)).argmax())
        row = {"bucket": [held.column("bucket")[0].as_py()], "cell": [held.column("cell")[0].as_py()], "ids": [held.column("vec_id").to_pylist()], "vectors": [own.tobytes()], "edges": [linked(own).tobytes()], "entry": [entry]}
        kinds = pa.schema([("bucket", pa.int32()), ("cell", pa.int32()), ("ids", pa.list_(pa.int64() if kind == "bigint" else pa.string())), ("vectors", pa.binary()), ("edges", pa.binary()), ("entry", pa.int32())])
        return pa.table(row, schema=kinds)

    return placed.select("bucket", "cell", "vec_id", "embedding").groupBy("bucket", "cell").applyInArrow(graph, GRAPH.format(kind))


def walks(graph: DataFrame, queries: DataFrame, centroids: DataFrame | None = None, k: int = 10, probes: int = 3, beam: int = 64) -> DataFrame:
    """qid, chunk_id, score, looked (how many vectors the walk looked at in that cell), held (how many the cell has): a cell's best k."""
    kind = graph.schema["ids"].dataType.elementType.simpleString()
    near = queries.select("qid", F.col("embedding").alias("asked"), F.lit(0).alias("bucket")) if centroids is None else index.nearest_buckets(queries, centroids, probes)
    asked = near.withColumn("run", F.pmod(F.xxhash64("qid"), F.lit(max(1, queries.count() // ASKED + 1)))).groupBy("bucket", "run").agg(F.collect_list("qid").alias("qids"), F.collect_list("asked").alias("asked"))
    few = queries.limit(retrieval.BLOCK + 1).count() <= retrieval.BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column("ids")[r].as_py()
                own = np.frombuffer(batch.column("vectors")[r].as_py()).reshape(len(ids), -1)
                edges = np.frombuffer(batch.column("edges")[r].as_py(), np.int32).reshape(len(ids), -1)
                for qid, query in zip(batch.column("qids")[r].as_py(), batch.column("asked")[r].as_py(), strict=True):
                    places, scores, looked = walked(own, edges, batch.column("entry")[r].as_py(), np.array(query, np.float64), k, max(beam, k))
                    n = len(places)
                    yield pa.RecordBatch.from_arrays([pa.array([qid] * n, pa.int64()), pa.array([ids[p] for p in places.tolist()], pa.int64() if kind == "bigint" else pa.string()), pa.array(np.round(scores, 6)), pa.array([looked] * n, pa.int64()), pa.array([len(ids)] * n, pa.int64())], names=["qid", "chunk_id", "score", "looked", "held"])

    met = graph.join(F.broadcast(asked) if few else asked, "bucket").select("ids", "vectors", "edges", "entry", "qids", "asked")
    return met.mapInArrow(run, f"qid bigint, chunk_id {kind}, score double, looked bigint, held bigint")


def top_k(graph: DataFrame, queries: DataFrame, centroids: DataFrame | None = None, k: int = 10, probes: int = 3, beam: int = 64) -> DataFrame:
    """qid, chunk_id, score, rank of the best that the walks found."""
    return retrieval.top_k(walks(graph, queries, centroids, k, probes, beam).select("qid", "chunk_id", "score"), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """qid, recall: the share of the exact hits that were found."""
    hit = exact.select("qid", "chunk_id").join(found.select("qid", "chunk_id", F.lit(1).alias("hit")), ["qid", "chunk_id"], "left")
    return hit.groupBy("qid").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
