"""Interaction of five text filters: what each removes in every order, and what it alone or others with it would remove.

Duplicates are found by sorting. Rows are dealt into ranges of (fingerprint, doc_id) and sorted within them by fingerprint,
full text and doc_id; each row is compared with its predecessor, text with text. A fingerprint may cross the end of a
range, as it does where one text makes up much of the corpus: of such fingerprints a range reports the least id of each of
its texts, and rows that are first of their text in their range, but may not be in the table, stay open until the reports
of all ranges are merged. Only fingerprints and ids decide about the ranges; texts are compared by executors alone.

The same pass over the sorted rows takes the other four filters, so that texts are read and shuffled once. It leaves a row
of id, part and failure mask for each document. Masks, with the labels of their ids, are counted by part: at most 32
counters a part. Those are additive, and all orders and steps of a part follow from them: a filter removes, in its place,
what its bit and no bit before it shows; over all orders, it removes a document that fails k filters in one of k.

Defined results. Null texts are empty; null parts are the empty string. A row fails E if a row with a smaller id has the same
text: of rows with the same id and text none fails on account of the other. Rows without an id have none smaller, are
smaller than none, and have no labels. Several labels of an id: the highest of each kind; labels other than 1 count as 0.
A word is a maximal run without ASCII white space; a text without words fails A, and B not (0 < 0 is false). Empty table: no rows.
Extra columns are ignored. Texts are read whole; a very long one is split into words a megabyte at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch, buckets_for, pick, text_or_empty, word_runs

LETTERS = "ABCDE"
A, B, C, D, E = (1 << k for k in range(5))
UPPER = bytes(range(65, 91))
SYMBOLS = b"#$%&*|"


def failed(raw: bytes, n_chars: int) -> int:
    """Mask of the filters A to D that a text fails."""
    words, distinct = 0, set()
    for run in word_runs(raw):
        words += len(run)
        distinct.update(run)
    mask = A if words < 50 else 0
    if 100 * len(distinct) < 65 * words:
        mask |= B
    if 100 * (len(raw) - len(raw.translate(None, UPPER))) > 5 * n_chars:
        mask |= C
    return mask | D if any(s in raw for s in SYMBOLS) else mask


AUDITED = "doc_id bigint, part string, mask int, n bigint, print bigint, text string"


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, mask (bit k for filter k of ABCDE), n: rows with the same id, text and part may be one row with their number."""
    src = pick(docs, doc_id=id_col, text=text_col, part=part_col).select(F.col("doc_id").cast("long"), text_or_empty(F.col("text")).alias("text"), text_or_empty(F.col("part")).alias("part"))
    ranged = src.withColumn("print", F.xxhash64("text")).repartitionByRange(buckets_for(src), "print", "doc_id").sortWithinPartitions("print", "text", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = now = text = least = None  # fingerprints of the range's first row and of the row before; that row's text and the text's least id
        reports: dict[tuple, int] = {}  # (id, part, mask, fingerprint, text) of open rows, number 0 for reports alone

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "part", "mask", "n", "print", "text"])

        for batch in batches:
            rows: list[tuple] = []
            n_chars = pc.utf8_length(batch.column("text")).to_pylist()
            others = (batch.column(c).to_pylist() for c in ("doc_id", "part", "print"))
            for i, part, own, raw, chars in zip(*others, batch.column("text").cast(pa.binary()), n_chars, strict=True):
                raw = raw.as_py()
                if own != now:
                    if first is None:
                        first = own
                    elif now != first:
                        reports = {k: n for k, n in reports.items() if k[3] == first}
                    now, text, least = own, None, None
                if raw != text:
                    text, least, mask = raw, None, failed(raw, chars)
                if least is None:
                    least = i
                    if i is not None and own != first:
                        reports[i, "", 0, own, raw] = 0
                if i is not None and i == least and own == first:
                    key = (i, part, mask, own, raw)
                    reports[key] = reports.get(key, 0) + 1
                    continue
                row = (i, part, mask | E * (i is not None and i > least))
                if rows and rows[-1][:3] == row:
                    rows[-1] = (*row, rows[-1][3] + 1, None, None)
                else:
                    rows.append((*row, 1, None, None))
            yield batch_of(rows)
        yield batch_of([(i, part, mask, n, own, raw.decode()) for (i, part, mask, own, raw), n in reports.items()])

    found = Scratch.write(ranged.mapInArrow(run, AUDITED)).read()
    ends = found.where("text IS NOT NULL")
    least = ends.groupBy("print", "text").agg(F.min("doc_id").alias("least"))
    settled = ends.where("n > 0").join(least, ["print", "text"]).withColumn("mask", F.col("mask") + F.when(F.col("doc_id") > F.col("least"), E).otherwise(0))
    return found.where("text IS NULL").select("doc_id", "part", "mask", "n").unionByName(settled.select("doc_id", "part", "mask", "n"))


def counters(failures: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: at most 32 rows a part, additive over parts and tables."""
    marks = pick(labels, doc_id="doc_id", good="quality", bad="toxic").select(F.col("doc_id").cast("long"), *[F.coalesce(F.col(c) == 1, F.lit(False)).cast("int").alias(c) for c in ("good", "bad")])
    marks = marks.where("doc_id IS NOT NULL AND (good = 1 OR bad = 1)").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("bad").alias("bad"))
    without = failures.where("doc_id IS NULL").select("part", "mask", "n", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("bad"))
    marked = failures.where("doc_id IS NOT NULL").join(marks, "doc_id", "left").select("part", "mask", "n", "good", "bad").unionByName(without)
    summed = lambda mark: F.sum(F.when(F.col(mark) == 1, F.col("n")).otherwise(0))
    return marked.groupBy("part", "mask").agg(F.sum("n").alias("n"), summed("good").alias("good"), summed("bad").alias("toxic"))


def orders(counted: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the counters."""
    per_part = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counters"))  # at most 32
    every = F.split(F.lit(",".join("".join(p) for p in permutations(LETTERS))), ",")
    ordered = per_part.select("part", "counters", F.explode(every).alias("filter_order")).select("*", F.posexplode(F.split("filter_order", "")).alias("place", "letter"))
    bit = F.expr("shiftleft(1, ascii(letter) - 65)")
    before = F.expr("aggregate(split(left(filter_order, place), ''), 0, (m, x) -> m + CASE WHEN x = '' THEN 0 ELSE shiftleft(1, ascii(x) - 65) END)")
    placed = ordered.withColumns({"bit": bit, "before": before})

    def total(which: str, number: str = "c.n") -> Column:
        return F.expr(f"aggregate(counters, 0L, (s, c) -> s + CASE WHEN {which} THEN {number} ELSE 0L END)")

    here = "c.mask & bit <> 0 AND c.mask & before = 0"
    return placed.select(
        "part",
        "filter_order",
        (F.col("place") + 1).cast("int").alias("step"),
        total("c.mask & (before | bit) = 0").alias("kept"),
        total(here).alias("removed"),
        total("c.mask & bit <> 0 AND c.mask & before <> 0").alias("redundant"),
        total("c.mask = bit").alias("unique_fails"),
        total(here, "c.good").alias("good_lost"),
        total(here, "c.toxic").alias("toxic_lost"),
        total("c.mask & bit <> 0", "c.n * (120 DIV bit_count(c.mask))").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return orders(counters(masks(docs, id_col, text_col, part_col), labels))


SPACE_SQL = r"[^\x20\x09-\x0D]+"
AUDIT_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '{SPACE_SQL}') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM texts),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
    CASE WHEN len(words) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask
  FROM worded LEFT JOIN marks USING (doc_id)
),
counted AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS toxic FROM failing GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, 1 << (ascii(filter_order[step]) - 65) AS own, list_sum([0] || [1 << (ascii(filter_order[i]) - 65) FOR i IN range(1, step)]) AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step))
SELECT part, filter_order, step,
  CAST(sum(CASE WHEN mask & own = 0 AND mask & CAST(before AS INTEGER) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN mask & own <> 0 AND mask & CAST(before AS INTEGER) = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN mask & own <> 0 AND mask & CAST(before AS INTEGER) <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN mask & own <> 0 AND mask & CAST(before AS INTEGER) = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN mask & own <> 0 AND mask & CAST(before AS INTEGER) = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN mask & own <> 0 THEN n * (120 // bit_count(mask)) ELSE 0 END) AS BIGINT) AS shapley
FROM counted, steps GROUP BY part, filter_order, step
"""
