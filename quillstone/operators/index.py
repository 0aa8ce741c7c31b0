"""Indexes as tables: chunks of all strategies, dense vectors with their sign bits, BM25 postings; built, saved, loaded, dropped.

A folder holds ``chunks``, ``rows``, ``vectors``, ``postings``, ``terms``, ``stats`` and ``manifest``. What is stored once isn't
computed by each query.

Chunks have ids of text, ``{strategy}:{doc_id}:{ordinal}``, and a row: their place, from 0 without gaps, in the order of ids.
Searches carry rows, and hits of equal scores come in the order of rows, which is that of ids; only what a query finds is
looked up by row. Files hold neighbouring rows, so that statistics tell which of them a lookup needs.

Postings are in blocks: what a term has in ``SPAN`` neighbouring rows, with the largest weight in it. The sum of a query's
largest weights in a span bounds what any of its rows can score, so a search works off the spans with the highest bounds
first, and of the others reads only those whose bound reaches the k-th score found.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions import vectors as V
from quillstone.functions.subwords import Vocabulary
from quillstone.operators import chunking, corpus, retrieval, service
from quillstone.sources import tables


def union_of_languages(parts: list[DataFrame], key: Column, order: str) -> DataFrame:
    """Corpora of several languages as one, the first document of each key."""
    every = reduce(DataFrame.unionByName, parts)
    kept = [c for c in every.columns if c != order]
    return corpus.first_wins(every, key, order, tuple(kept)).select(order, *kept)


def chunked(docs: DataFrame, strategies: list[str], tokenizer: Vocabulary | None = None, **options: dict) -> DataFrame:
    """chunk_id, doc_id, strategy, ordinal, text, display_text, n_tokens of all strategies, and lang where documents have one; unknown names are refused.

    With a tokenizer, strategies that count tokens count its own.
    """
    unknown = sorted(set(strategies) - set(chunking.STRATEGIES))
    if unknown:
        raise ValueError(f"Unknown strategies {unknown}. Available: {', '.join(sorted(chunking.STRATEGIES))}")
    sized = {s: {"tokenizer": tokenizer} if tokenizer and "tokenizer" in inspect.signature(chunking.get_strategy(s)).parameters else {} for s in strategies}
    count = tokenizer.count if tokenizer else T.count_tokens
    # the language travels within the id, so that no text is moved to get it back
    with_lang = "lang" in docs.columns
    keyed = docs.withColumn("doc_id", F.struct("doc_id", F.col("lang").alias("doc_lang"))) if with_lang else docs
    parts = [chunking.get_strategy(s)(keyed.where(F.trim("text") != ""), **sized[s] | options.get(s, {})).withColumn("strategy", F.lit(s)) for s in strategies]
    every = reduce(DataFrame.unionByName, parts)
    if with_lang:
        every = every.withColumns({"lang": F.col("doc_id.doc_lang"), "doc_id": F.col("doc_id.doc_id")})
    return every.select(F.concat_ws(":", "strategy", "doc_id", "ordinal").alias("chunk_id"), "doc_id", "strategy", "ordinal", "text", "display_text", count(F.col("text")).cast("long").alias("n_tokens"), *(["lang"] if with_lang else []))


def embedded(chunks: DataFrame, embed: Callable, sizes: bool = True, kind: str | None = None) -> DataFrame:
    """chunk_id, strategy, embedding; a task's texts go to the model by length, so that a batch's texts need little padding.

    ``kind`` (query or passage) puts what the embedding model wants before a text.
    """
    text = F.col("text") if kind is None else service.prefixed(F.col("text"), kind)

    @F.pandas_udf("array<double>")
    def run(texts):
        import pandas as pd

        return pd.Series(list(embed(list(texts))), dtype=object)

    ordered = chunks.sortWithinPartitions(F.length("text")) if sizes else chunks
    return ordered.select("chunk_id", "strategy", run(text).alias("embedding"))


def checked(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """The vectors, after it was seen that every chunk has one, no chunk two, and no vector is without its chunk."""
    sides = vectors.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).join(chunks.select("chunk_id", F.lit(1).alias("known")), "chunk_id", "full_outer")
    wrong = sides.agg(F.count_if(F.coalesce("n", F.lit(0)) == 0).alias("missing"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("known").isNull()).alias("unknown")).first()
    if any(wrong):
        raise ValueError(f"index and ids differ: {wrong['missing']} chunks without a vector, {wrong['repeated']} with several, {wrong['unknown']} vectors without a chunk")
    return vectors


#: Neighbouring rows whose postings of a term are one block, and spans that a query reads before it knows a bound.
SPAN, FIRST = 1024, 4
#: Queries that are scored against a span at a time.
QUERIES = 1024
PARTS = ("chunks", "rows", "vectors", "centroids", "graph", "postings", "terms", "stats", "manifest")


def numbered(chunks: DataFrame, starts: DataFrame) -> DataFrame:
    """Stored chunks with their row: the place within their file's task, after the rows of the tasks before it."""
    task = F.shiftright("place", 33).cast("int")
    return chunks.withColumn("task", task).join(F.broadcast(starts), "task").withColumn("row", F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).drop("task", "start", "place")


def blocks(chunks: DataFrame, avgdl: float) -> DataFrame:
    """term, span, rows (places in the span, ascending), tf, dl, weight (the largest), n: at most ``SPAN`` postings to a block, whatever the term.

    Stored chunks lie in the order of rows, so each Arrow batch makes the blocks of its spans where they are and no token is moved;
    a span that two batches share has a block of a term from each, whose rows are different.
    """
    words = chunks.select("row", T.tokens(F.col("text")).alias("tokens"))
    k1, b = retrieval.K1, retrieval.B

    def gathered(rows: np.ndarray, tokens: pa.ListArray) -> pa.RecordBatch:
        lengths = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        coded = tokens.flatten().dictionary_encode()
        place = rows % SPAN
        pairs, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * SPAN + np.repeat(place, lengths), return_counts=True)
        term, at = pairs // SPAN, pairs % SPAN
        size = np.zeros(SPAN, np.int64)
        size[place] = lengths
        dl = size[at]
        starts = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.empty(0, np.int64)
        ends = pa.array(np.append(starts, len(term)), pa.int32())
        listed = lambda values, kind: pa.ListArray.from_arrays(ends, pa.array(values, kind))
        most = np.maximum.reduceat(tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)), starts) if len(starts) else np.empty(0)
        span = pa.array(np.full(len(starts), rows[0] // SPAN), pa.int64())
        columns = [coded.dictionary.take(pa.array(term[starts])), span, listed(at, pa.int16()), listed(tf, pa.int32()), listed(dl, pa.int32()), pa.array(most), pa.array(np.diff(np.append(starts, len(term))), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["term", "span", "rows", "tf", "dl", "weight", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            order = np.argsort(rows, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(rows[order] // SPAN)) + 1):
                if len(own):
                    yield gathered(rows[own], batch.column(1).take(pa.array(own)))

    return words.mapInArrow(run, "term string, span bigint, rows array<smallint>, tf array<int>, dl array<int>, weight double, n bigint")


def save(folder: str, chunks: DataFrame, vectors: DataFrame | Callable[[DataFrame], DataFrame] | None = None, lexical: list[str] | None = None, graphs: bool = False, centroids: DataFrame | None = None) -> None:
    """Writes the index of these chunks; dense parts, of those strategies that have vectors, with their sign bits and, if
    asked for, each strategy's ``graphs``, dealt by centroids (cid, centroid) where there are some; postings of the ``lexical`` strategies, or all.

    ``vectors`` may be a function of the chunks, which then gets them as they were written, so that they aren't made again."""
    spark = chunks.sparkSession
    # written first: texts are chunked once, and vectors computed once, however often they are looked at
    made = tables.written(chunks)
    known = None if vectors is None else tables.written(vectors(made) if callable(vectors) else vectors)
    placed = made.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id").withColumn("place", F.monotonically_increasing_id())
    tables.write_table(placed, f"{folder}/chunks", ("strategy",))
    tables.drop_written(made)
    tasks = spark.read.parquet(f"{folder}/chunks").groupBy(F.shiftright("place", 33).cast("int").alias("task")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    tables.write_table(tasks.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), f"{folder}/rows")
    stored = numbered(spark.read.parquet(f"{folder}/chunks"), spark.read.parquet(f"{folder}/rows"))
    if known is not None:
        dense = stored.join(F.broadcast(known.select("strategy").distinct()), "strategy", "left_semi").select("chunk_id", "row", *{"lang"} & {*stored.columns})
        keyed = checked(known, dense).join(dense, "chunk_id").withColumn("bits", V.sign_words(F.col("embedding")))
        tables.write_table(keyed.repartitionByRange("row").sortWithinPartitions("strategy", "row"), f"{folder}/vectors", ("strategy",))
        tables.drop_written(known)
        if graphs:
            from quillstone.operators import graph

            if centroids is not None:
                tables.write_table(centroids, f"{folder}/centroids")
            held = spark.read.parquet(f"{folder}/vectors").select("strategy", F.col("row").alias("vec_id"), "embedding")
            names = [r["strategy"] for r in held.select("strategy").distinct().collect()]
            walked = [graph.build(held.where(F.col("strategy") == s), spark.read.parquet(f"{folder}/centroids") if centroids is not None else None).withColumn("strategy", F.lit(s)) for s in names]
            tables.write_table(reduce(DataFrame.unionByName, walked), f"{folder}/graph", ("strategy",))
    searched = stored.where(F.col("strategy").isin(lexical)) if lexical else stored
    tables.write_table(searched.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(T.tokens(F.col("text")))).alias("avgdl")), f"{folder}/stats")
    size = spark.read.parquet(f"{folder}/stats").first()
    held = tables.written(blocks(searched, size["avgdl"] or 1.0))  # ranges are drawn from a sample, which would make the blocks again
    tables.write_table(held.repartitionByRange("term", "span").sortWithinPartitions("term", "span"), f"{folder}/postings")
    tables.drop_written(held)
    df = spark.read.parquet(f"{folder}/postings").groupBy("term").agg(F.sum("n").alias("df"))
    tables.write_table(df.withColumn("idf", F.log(1 + (size["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))), f"{folder}/terms")
    tables.write_table(tables.manifest(stored), f"{folder}/manifest")


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The parts that there are, chunks with their rows; sign bits are computed where an index has none; without chunks there is no index."""
    parts = {name: spark.read.parquet(f"{folder}/{name}") for name in PARTS if tables.exists(spark, f"{folder}/{name}")}
    if "chunks" not in parts:
        raise FileNotFoundError(f"no index in {folder}")
    parts["chunks"] = numbered(parts["chunks"], parts["rows"])
    if "vectors" in parts and "bits" not in parts["vectors"].columns:
        parts["vectors"] = parts["vectors"].withColumn("bits", V.sign_words(F.col("embedding")))
    return parts


def built(spark: SparkSession, inputs: list[str], name: str, build: Callable[[str], None]) -> dict[str, DataFrame]:
    """The index of these files for this application: built the first time, and again when one of them has changed."""
    folder = f"{tables.shared_folder(spark)}/{name}-{spark.sparkContext.applicationId}-{tables.version_of(spark, inputs)}"
    if not tables.exists(spark, f"{folder}/manifest/_SUCCESS"):
        build(folder)
    return load(spark, folder)


def drop(spark: SparkSession, folder: str) -> bool:
    """Deletes an index; whether there was one."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _asked(parts: dict[str, DataFrame], queries: DataFrame) -> DataFrame:
    """qid, term, times: how often each query names each indexed term, times its rarity; broadcast up to a number of terms."""
    wanted = queries.select("qid", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
    few = wanted.limit(retrieval.BROADCAST_TERMS + 1).count() <= retrieval.BROADCAST_TERMS
    known = tables.written(parts["terms"].join(F.broadcast(wanted) if few else wanted, "term").select("qid", "term", (F.col("qtf") * F.col("idf")).alias("times")))
    return F.broadcast(known) if few else known


def _scored(parts: dict[str, DataFrame], asked: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """qid, row, score of the first k rows that each query finds in each of the cells (qid, span).

    The blocks of a span that any query asks for meet the span's queries once, in one group of at most ``SPAN`` rows and a
    block of queries at a time: what a term adds to rows and queries is a matrix, and no posting is multiplied by the queries.
    """
    avgdl, k1, b = parts["stats"].first()["avgdl"] or 1.0, retrieval.K1, retrieval.B
    met = parts["postings"].select("term", "span", "rows", "tf", "dl").join(asked.select("term").distinct(), "term", "left_semi").join(cells.select("span").distinct(), "span", "left_semi")
    terms = cells.select("qid", "span").join(asked.groupBy("qid").agg(F.collect_list(F.struct("term", "times")).alias("terms")), "qid")
    kind = asked.schema["qid"].dataType.simpleString()

    def scored(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        held = blocks.combine_chunks()
        qids, listed = queries.column("qid").combine_chunks(), queries.column("terms").combine_chunks()
        value = lambda name: held.column(name).combine_chunks() if held.num_rows else None
        out_q, out_row, out_score = [], [], []
        if held.num_rows and queries.num_rows:
            span, names = blocks.column("span")[0].as_py(), value("term")
            rows, tf, dl = (value(c).flatten().to_numpy(zero_copy_only=False) for c in ("rows", "tf", "dl"))
            ends = np.append(0, np.cumsum(value("rows").value_lengths().to_numpy(zero_copy_only=False)))
            weights = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
            different = names.unique()
            of_block = pc.index_in(names, value_set=different).to_numpy(zero_copy_only=False)
            pairs = listed.flatten()
            term = pc.fill_null(pc.index_in(pairs.field("term"), value_set=different), -1).to_numpy(zero_copy_only=False)
            query = np.repeat(np.arange(len(qids)), listed.value_lengths().to_numpy(zero_copy_only=False))
            times = pairs.field("times").to_numpy(zero_copy_only=False)
            for start in range(0, len(qids), QUERIES):
                here = (query >= start) & (query < start + QUERIES) & (term >= 0)
                order = np.argsort(term[here], kind="stable")
                own_term, own_query, own_times = term[here][order], query[here][order] - start, times[here][order]
                low, high = (np.searchsorted(own_term, np.arange(len(different)), side) for side in ("left", "right"))
                total = np.zeros((min(QUERIES, len(qids) - start), SPAN))
                for i, t in enumerate(of_block):
                    q = own_query[low[t] : high[t]]
                    if len(q):
                        total[q[:, None], rows[ends[i] : ends[i + 1]]] += own_times[low[t] : high[t], None] * weights[ends[i] : ends[i + 1]]
                best = retrieval.Best(len(total), k)
                best.add(np.arange(SPAN) + span * SPAN, np.round(total.T, 4), total.T > 0)
                for q, (ids, scores) in enumerate(zip(best.ids, best.scores, strict=True)):
                    out_q += [start + q] * len(ids)
                    out_row.append(ids), out_score.append(scores)
        flat = lambda parts, number: np.concatenate([np.empty(0, number), *parts])
        return pa.table({"qid": qids.take(pa.array(out_q, pa.int64())), "row": pa.array(flat(out_row, np.int64)), "score": pa.array(flat(out_score, np.float64))})

    return met.groupBy("span").cogroup(terms.groupBy("span")).applyInArrow(scored, f"qid {kind}, row bigint, score double")


def bounded(parts: dict[str, DataFrame], asked: DataFrame) -> DataFrame:
    """qid, span, bound (what a row in it scores at most), blocks, place by bound."""
    heads = parts["postings"].select("term", "span", "weight").join(asked, "term")
    bounds = heads.groupBy("qid", "span").agg(F.sum(F.col("times") * F.col("weight")).alias("bound"), F.count(F.lit(1)).alias("blocks"))
    return bounds.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "span")))


def searched(parts: dict[str, DataFrame], queries: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """The best rows (qid, row, score, rank), and for each query how many blocks there are for its terms and how many were read."""
    asked = _asked(parts, queries)
    spans = tables.written(bounded(parts, asked))
    first = tables.written(retrieval.top_k(_scored(parts, asked, spans.where(F.col("place") <= FIRST), k), k, item="row"))
    least = first.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    # scores are rounded to four places, bounds aren't
    rest = spans.where(F.col("place") > FIRST).join(least, "qid", "left").where(F.col("least").isNull() | (F.col("bound") + 1e-4 >= F.col("least")))
    found = retrieval.top_k(first.select("qid", "row", "score").unionByName(_scored(parts, asked, rest, k)), k, item="row")
    read = spans.where(F.col("place") <= FIRST).select("qid", "blocks").unionByName(rest.select("qid", "blocks")).groupBy("qid").agg(F.sum("blocks").alias("blocks_read"))
    return found, spans.groupBy("qid").agg(F.sum("blocks").alias("blocks")).join(read, "qid")


def named(parts: dict[str, DataFrame], hits: DataFrame, *columns: str) -> DataFrame:
    """Hits by row with their chunk's id and what else is asked for of it."""
    return hits.join(parts["chunks"].select("row", "chunk_id", *columns), "row")


def bm25(parts: dict[str, DataFrame], queries: DataFrame, k: int = 10) -> DataFrame:
    """qid, chunk_id, score, rank from a stored index: no text is read, and of the query's terms only the blocks that can hold one of the first k."""
    return named(parts, searched(parts, queries, k)[0]).select("qid", "chunk_id", "score", "rank")


def bucketed(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """Each vector with the nearest of at most a block of centroids (cid, centroid): the buckets of the approximate search."""
    if centroids.limit(retrieval.BLOCK + 1).count() > retrieval.BLOCK:
        raise ValueError("more centroids than one block")
    one_row = F.broadcast(centroids.agg(F.array_sort(F.collect_list(F.struct("cid", "centroid"))).alias("centroids")))
    nearest = F.array_max(F.transform("centroids", lambda c: F.struct(V.dot(F.col("embedding"), c["centroid"]).alias("near"), c["cid"].alias("cid"))))
    return vectors.crossJoin(one_row).withColumn("bucket", nearest["cid"]).drop("centroids")


def nearest_buckets(queries: DataFrame, centroids: DataFrame, probes: int) -> DataFrame:
    """qid, asked (the query's vector), bucket: the ``probes`` buckets whose centroids are nearest."""
    rows = centroids.agg(F.array_sort(F.collect_list(F.struct("cid", "centroid"))).alias("centroids"))
    near = F.sort_array(F.transform("centroids", lambda c: F.struct(V.dot(F.col("embedding"), c["centroid"]).alias("near"), c["cid"].alias("cid"))), asc=False)
    return queries.crossJoin(F.broadcast(rows)).select("qid", F.col("embedding").alias("asked"), F.explode(F.transform(F.slice(near, 1, probes), lambda x: x["cid"])).alias("bucket"))


def approximate_top_k(vectors: DataFrame, queries: DataFrame, centroids: DataFrame, k: int = 10, probes: int = 8) -> DataFrame:
    """qid, chunk_id, score, rank over the ``probes`` buckets nearest to each query; all buckets make it exact."""
    asked = nearest_buckets(queries, centroids, probes)
    few = queries.limit(retrieval.BLOCK + 1).count() <= retrieval.BLOCK
    met = vectors.join(F.broadcast(asked) if few else asked, "bucket")
    return retrieval.top_k(met.select("qid", F.col("vec_id").alias("chunk_id"), F.round(V.dot(F.col("embedding"), F.col("asked")), 6).alias("score")), k)


def payloads(chunks: DataFrame) -> DataFrame:
    """chunk_id and everything else as JSON, as a store keeps it."""
    return chunks.select("chunk_id", F.to_json(F.struct(*[c for c in chunks.columns if c != "chunk_id"])).alias("payload"))
