"""How the sources of each language differ in their words: divergences between term distributions, and the terms behind them.

A tokenizer on bytes: texts stay end to end in their UTF-8 buffer, a lookup table of 256 entries lower-cases A-Z and blanks
what is no term, and boundaries are where the table's answer or the document changes. xxhash groups the slices; of each
group every slice is then compared with the first, eight bytes at a time, and those that differ get groups of their own.

A task counts a term once for each group of texts with the same language and source, and sends sparse matrices in
compressed rows (terms by sources), parted by the terms' hash. A bucket's matrices of a language are added up as they come;
terms of too few documents go. Totals of the sources and the size of the vocabulary are sums over buckets. Then each bucket
works off its matrices again: a term that a source lacks has the same share there as any other that it lacks, so for a
source s against all others at once, its shares are laid out densely, and the entries of all other sources, in compressed
columns, are compared with it and summed by reduceat; what neither has is one product. Shares, squares and sums are whole
numbers throughout.

Groups are as many as there are sources; their totals are broadcast up to a stated number, beyond which they are joined.

Defined results. Null texts, languages and sources are empty strings, and an empty one is a language or source like any
other. Repeated rows are documents each. A language none of whose terms is kept gives pairs of value 0 and no terms. A
source alone in its language has no pairs. Empty table: no rows. Extra columns are ignored. Texts are read whole, a long one
in parts that end between terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch, buckets_for, pick, text_or_empty

SCALE, SMOOTHING = 1_000_000_000, 1
#: Bytes that are tokenized at a time, and pairs of term and group, or terms, that a task holds before it sends them.
PART, PAIRS, TERMS = 1 << 21, 1 << 22, 1 << 20
#: Groups whose totals are broadcast; more are joined.
GROUPS = 100_000
LOWER = np.zeros(256, np.uint8)
LOWER[0x80:] = np.arange(0x80, 0x100)
LOWER[0x61:0x7B] = LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)


def boundaries(lowered: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each term; document k lies between offsets k and k + 1."""
    inside = lowered != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(lowered))]
    first[cuts], last[cuts - 1] = inside[cuts], inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1


def differing(lowered: np.ndarray, starts: np.ndarray, lengths: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Indexes of the slices whose bytes aren't those of the slice that ``other`` names."""
    padded = np.append(lowered, np.zeros(8, np.uint8))
    eight = np.ndarray(len(lowered) + 1, "<u8", padded, strides=(1,))
    differ = lengths != lengths[other]
    left = np.flatnonzero(~differ & (other != np.arange(len(other))))
    done = 0
    while len(left):
        # the bytes of the last eight that are past the end don't count
        unread = (8 * np.maximum(0, 8 - (lengths[left] - done))).astype(np.uint64)
        apart = ((eight[starts[left] + done] ^ eight[starts[other[left]] + done]) << unread) != 0
        differ[left[apart]] = True
        done += 8
        left = left[~apart & (lengths[left] > done)]
    return np.flatnonzero(differ)


def grouped(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[list[bytes], np.ndarray]:
    """Distinct slices, and which of them each slice is."""
    raw = lowered.tobytes()
    slices = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    hashes = np.fromiter(map(digest, slices), np.uint64, len(slices))
    _, sample, place = np.unique(hashes, return_index=True, return_inverse=True)
    names = [slices[k] for k in sample.tolist()]
    odd: dict[bytes, int] = {}
    for k in differing(lowered, starts, ends - starts, sample[place]).tolist():
        place[k] = odd.setdefault(slices[k], len(names) + len(odd))
    return names + [*odd], place


def parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Lower-cased bytes, offsets of documents in them, their row numbers, and whether the last document goes on in the next part."""
    text = batch.column("text").cast(pa.large_binary())
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    row = 0
    while row < len(text):
        upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PART, side="right")) - 1)
        at, end = int(offsets[row]), int(offsets[upto])
        while upto == row + 1 and end - at > PART:
            low = LOWER[data[at : at + PART]]
            gaps = np.flatnonzero(low == 0)
            if not len(gaps):
                low = LOWER[data[at:end]]
                gaps = np.flatnonzero(low == 0)
                if not len(gaps):
                    break
                gaps = gaps[:1]
            low = low[: gaps[-1] + 1]
            yield low, np.array([0, len(low)]), np.array([row]), True
            at += len(low)
        low = LOWER[data[at:end]]
        own = np.array([0, end - at]) if upto == row + 1 else offsets[row : upto + 1] - at
        yield low, own, np.arange(row, upto), False
        row = upto


def added(key: np.ndarray, *numbers: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of their numbers."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[starts], *[np.add.reduceat(x[order], starts) if len(starts) else x for x in numbers]


class Counts:
    """Occurrences and documents of each pair of group and term."""

    def __init__(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.groups: dict = {}
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, key: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        self.waiting.append((key, n, docs))
        self.held += len(key)
        if self.held > PAIRS:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """group << 32 | term, occurrences, documents."""
        key, n, docs = added(*[np.concatenate(x) for x in zip(*self.waiting, strict=True)]) if self.waiting else [np.zeros(0, np.int64)] * 3
        self.waiting, self.held = [(key, n, docs)], len(key)
        return key, n, docs

    def term_ids(self, names: list[bytes]) -> np.ndarray:
        known = self.terms
        return np.fromiter((known.setdefault(s, len(known)) for s in names), np.int64, len(names))


MATRIX = "bucket int, lang string, sources array<string>, terms binary, rows binary, columns binary, n binary, docs binary"


def matrices(docs: DataFrame, buckets: int) -> DataFrame:
    """Sparse matrices, terms by sources, for each bucket of terms and language; terms are parted by spaces, rows are where each begins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(counts: Counts) -> Iterator[pa.RecordBatch]:
            key, n, own = counts.total()
            if not len(key):
                return
            names = [*counts.terms]
            bucket_of = np.fromiter((xxhash.xxh32_intdigest(s) % buckets for s in names), np.int64, len(names))
            langs: dict[str, list[int]] = {}
            for (lang, _), g in counts.groups.items():
                langs.setdefault(lang, []).append(g)
            sources = [source for _, source in counts.groups]
            lang_of = np.zeros(len(sources), np.int64)
            for k, gs in enumerate(langs.values()):
                lang_of[gs] = k
            group, term = key >> 32, key & 0xFFFFFFFF
            order = np.lexsort((group, term, bucket_of[term], lang_of[group]))
            group, term, n, own = group[order], term[order], n[order], own[order]
            lang, bucket = lang_of[group], bucket_of[term]
            edges = np.flatnonzero(np.append(True, (lang[1:] != lang[:-1]) | (bucket[1:] != bucket[:-1]))).tolist()
            by_number = [*langs]
            for a, b in zip(edges, [*edges[1:], len(group)], strict=True):
                present, column = np.unique(group[a:b], return_inverse=True)
                rows = np.flatnonzero(np.append(True, term[a + 1 : b] != term[a : b - 1]))
                terms = b" ".join(names[t] for t in term[a:b][rows].tolist())
                yield row_of(int(bucket[a]), by_number[lang[a]], [sources[g] for g in present.tolist()], terms, rows, column, n[a:b], own[a:b])

        counts = Counts()
        for batch in batches:
            group = np.array([counts.groups.setdefault(g, len(counts.groups)) for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)], np.int64)
            pending: list[np.ndarray] = []  # of a document in several parts: its pairs so far
            for lowered, offsets, rows, goes_on in parts(batch):
                starts, ends, doc = boundaries(lowered, offsets)
                names, place = grouped(lowered, starts, ends)
                pair = rows[doc] << 32 | counts.term_ids(names)[place]
                if goes_on or pending:
                    pending.append(np.stack(np.unique(pair, return_counts=True)))
                    if goes_on:
                        continue
                    pair, n = added(*np.concatenate(pending, axis=1))
                    pending = []
                else:
                    pair, n = np.unique(pair, return_counts=True)
                key = group[pair >> 32] << 32 | pair & 0xFFFFFFFF
                counts.add(*added(key, n, np.ones(len(key), np.int64)))
                if len(counts.terms) > TERMS or counts.held > PAIRS:
                    yield from sent(counts)
                    groups = counts.groups
                    counts = Counts()
                    counts.groups = groups
        yield from sent(counts)

    return docs.select("lang", "source", "text").mapInArrow(run, MATRIX)


def row_of(bucket: int, lang: str, sources: list[str], terms: bytes, rows: np.ndarray, columns: np.ndarray, n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    packed = [x.astype(kind).tobytes() for x, kind in ((rows, "<i4"), (columns, "<i4"), (n, "<i8"), (docs, "<i8"))]
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([lang]), pa.array([sources], pa.list_(pa.string())), pa.array([terms], pa.binary()), *[pa.array([x], pa.binary()) for x in packed]], names=["bucket", "lang", "sources", "terms", "rows", "columns", "n", "docs"])


def unpacked(batch: pa.RecordBatch, k: int, *columns: str) -> list[np.ndarray]:
    return [np.frombuffer(batch.column(c)[k].as_py(), "<i4" if c in ("rows", "columns") else "<i8").astype(np.int64) for c in columns]


def merged(sent: DataFrame, buckets: int, least_docs: int) -> DataFrame:
    """One matrix for each bucket and language: terms of at least so many documents, ascending, with totals of the sources."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def complete(place: tuple[int, str], counts: Counts) -> Iterator[pa.RecordBatch]:
            key, n, docs = counts.total()
            term, column = key & 0xFFFFFFFF, key >> 32
            names = [*counts.terms]
            in_docs = np.zeros(len(names), np.int64)
            np.add.at(in_docs, term, docs)
            kept = sorted((names[t], t) for t in np.flatnonzero(in_docs >= least_docs).tolist())
            if not kept:
                return
            rank = np.full(len(names), -1, np.int64)
            rank[[t for _, t in kept]] = np.arange(len(kept))
            order = np.lexsort((column, rank[term]))
            order = order[rank[term[order]] >= 0]
            term, column, n, docs = rank[term[order]], column[order], n[order], docs[order]
            totals = np.zeros(len(counts.groups), np.int64)
            np.add.at(totals, column, n)
            rows = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
            out = row_of(*place, [*counts.groups], b" ".join(s for s, _ in kept), rows, column, n, docs)
            yield out.append_column("totals", pa.array([totals.tolist()], pa.list_(pa.int64()))).append_column("n_terms", pa.array([len(kept)], pa.int64()))

        now, counts = None, Counts()
        for batch in batches:
            for k, place in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("lang").to_pylist(), strict=True)):
                if place != now:
                    if now:
                        yield from complete(now, counts)
                    now, counts = place, Counts()
                rows, columns, n, docs = unpacked(batch, k, "rows", "columns", "n", "docs")
                source = np.array([counts.groups.setdefault(s, len(counts.groups)) for s in batch.column("sources")[k].as_py()], np.int64)
                term = counts.term_ids(batch.column("terms")[k].as_py().split(b" "))
                counts.add(source[columns] << 32 | np.repeat(term, np.diff(np.append(rows, len(n)))), n, docs)
        if now:
            yield from complete(now, counts)

    dealt = sent.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "lang")
    return dealt.mapInArrow(run, f"{MATRIX}, totals array<bigint>, n_terms bigint")


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTHING) / total), a thousandth at a time: exact in 64 bits for totals under 9e15."""
    left, out = count + SMOOTHING, np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // total
        left = left % total
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


FOUND = "lang string, source string, part string, item string, value bigint"


def compared(held: DataFrame, top: int) -> DataFrame:
    """What each bucket adds to each ordered pair of a language's sources, and each source's first terms in it.

    ``held`` has the matrices, and with them the language's sources with their totals (``every``) and its vocabulary (``n_vocabulary``).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(lang: str, source: list[str], part: str, item: list[str], value: np.ndarray) -> pa.RecordBatch:
            n = len(item)
            return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(source, pa.string()), pa.array([part] * n, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])

        for batch in batches:
            for k, lang in enumerate(batch.column("lang").to_pylist()):
                rows, columns, n = unpacked(batch, k, "rows", "columns", "n")
                terms = batch.column("terms")[k].as_py().split(b" ")
                every = batch.column("every")[k].as_py()
                names, totals = [e["source"] for e in every], np.array([e["total"] for e in every], np.int64)
                vocabulary = batch.column("n_vocabulary")[k].as_py()
                number = {s: i for i, s in enumerate(names)}
                column = np.array([number[s] for s in batch.column("sources")[k].as_py()], np.int64)[columns]
                term = np.repeat(np.arange(len(terms)), np.diff(np.append(rows, len(n))))
                order = np.lexsort((term, column))
                column, term, n = column[order], term[order], n[order]
                sizes = totals + SMOOTHING * vocabulary
                p, none = share(n, sizes[column]), share(np.zeros(len(names), np.int64), sizes)
                present = np.unique(column)
                starts = np.searchsorted(column, present)
                ends = np.append(starts[1:], len(column))
                own_none = none[column]
                bounds = dict(zip(present.tolist(), zip(starts.tolist(), ends.tolist(), strict=True), strict=True))
                for s in range(len(names)):
                    a, b = bounds.get(s, (0, 0))
                    dense = np.full(len(terms), none[s])
                    dense[term[a:b]] = p[a:b]
                    shares, times = np.unique(p[a:b], return_counts=True)
                    shares, times = np.append(shares, none[s]), np.append(times, len(terms) - (b - a))
                    value = np.zeros(len(names), np.int64)
                    for x, m in zip(shares, times, strict=True):
                        value += m * divergence(x, none)
                    here = dense[term]
                    value[present] += np.add.reduceat(divergence(here, p) - divergence(here, own_none), starts)
                    others = [t for t in range(len(names)) if t != s]
                    yield out(lang, [names[s]] * len(others), "pair", [names[t] for t in others], value[others])
                of_lang = np.zeros(len(terms), np.int64)
                np.add.at(of_lang, term, n)
                q = share(of_lang, int(totals.sum()) + SMOOTHING * vocabulary)[term]
                over = np.flatnonzero(p > q)
                column, term, value = column[over], term[over], divergence(p[over], q[over])
                order = np.lexsort((term, -value, column))
                column, term, value = column[order], term[order], value[order]
                first = np.searchsorted(column, column)
                few = np.arange(len(column)) - first < top
                yield out(lang, [names[c] for c in column[few].tolist()], "term", [terms[t].decode() for t in term[few].tolist()], value[few])

    return held.mapInArrow(run, FOUND)


def divergences(docs: DataFrame, least_docs: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    src = pick(docs, lang=lang_col, source=source_col, text=text_col)
    src = src.select(*[text_or_empty(F.col(c)).alias(c) for c in src.columns])
    buckets = buckets_for(src)
    held = Scratch.write(merged(matrices(src, buckets), buckets, least_docs)).read()
    totals = held.select("lang", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("totals").alias("total")))).groupBy("lang", "source").agg(F.sum("total").alias("total"))
    sizes = held.groupBy("lang").agg(F.sum("n_terms").alias("n_vocabulary"))
    groups = src.select("lang", "source").distinct()
    listed = Scratch.write(groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0)).read()
    per_lang = listed.groupBy("lang").agg(F.collect_list(F.struct("source", "total")).alias("every"), F.first("n_vocabulary").alias("n_vocabulary"))
    few = listed.limit(GROUPS + 1).count() <= GROUPS
    beside = held.drop("docs", "totals", "n_terms").join(F.broadcast(per_lang) if few else per_lang.hint("merge"), "lang")
    found = Scratch.write(compared(beside, top)).read()

    other = listed.select("lang", F.col("source").alias("item"))
    nothing = listed.where("n_vocabulary = 0").select("lang", "source").join(other, "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    pairs = found.where("part = 'pair'").select("lang", "source", "item", "value").unionByName(nothing).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = [F.desc("value"), F.asc("item")]
    ranked = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)).alias("rank"))
    # first ranks of shares of the terms, so that none of a source's windows holds what all buckets have found
    terms = found.where("part = 'term'").withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(256)))
    few_each = terms.withColumn("place", F.row_number().over(Window.partitionBy("lang", "source", "salt").orderBy(*order))).where(F.col("place") <= top)
    best = few_each.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.unionByName(best.select("lang", "source", "part", "item", "value", "rank"))


TERM_SQL = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
DIVERGENCE_SQL = rf"""
WITH texts AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
terms AS (SELECT row_id, lang, source, translate(unnest(regexp_extract_all(text, '{TERM_SQL}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM texts),
counted AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row_id) AS docs FROM terms GROUP BY lang, source, term),
kept AS (SELECT lang, term, sum(n) AS n FROM counted GROUP BY lang, term HAVING sum(docs) >= 3),
vocabulary AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM texts),
sizes AS (SELECT lang, source, coalesce(sum(c.n), 0) AS n FROM groups LEFT JOIN (SELECT c.* FROM counted c JOIN kept USING (lang, term)) c USING (lang, source) GROUP BY lang, source),
shares AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 * (coalesce(c.n, 0) + 1) AS HUGEINT) // CAST(s.n + v.v AS HUGEINT) AS p,
    1 + CAST(1000000000 * (k.n + 1) AS HUGEINT) // CAST(v.n + v.v AS HUGEINT) AS q
  FROM sizes s JOIN kept k USING (lang) JOIN vocabulary v USING (lang) LEFT JOIN counted c USING (lang, source, term)
),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
both_parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
