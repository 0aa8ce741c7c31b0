"""SimHash near-duplicates by a hierarchical index in Gray order.

A fingerprint's bit is set if it is set in over half of the hashes of the text's word shingles. Equal fingerprints are one
vertex. For the others, fingerprints are dealt by blocks: those that differ in at most ``most`` bits agree on one of
``most + 1`` blocks at least, so each goes to one group for each block. A group that more than ``GROUP`` fingerprints share
is dealt again by the bits that are left, in blocks of their own, as often as it takes: no group is gathered that is larger,
however alike the corpus is, and no pair is lost.

Within its groups a task sorts the fingerprints by Gray rank, so that neighbours differ in few bits, and builds a tree over
runs of neighbours: a node holds the bits that all below it share as a mask and a pattern, and only those that its parent
doesn't hold already. Pairs of nodes are descended together; what their masks both hold and their parents' didn't is
compared and added to the differences so far, and a pair of nodes that has more than ``most`` is dropped with all that is
below it. So is a pair whose fingerprints are already known to be connected. Links are never written out for a group: each
group gives a forest that spans its components.

Defined results. Null texts and texts without words have fingerprint zero and link like any other. Texts with fewer words
than a shingle has are one shingle. Repeated shingles count each time. Rows without an id have a null component and link
with nothing; rows with the same id are vertices each by their texts. Empty table: no rows. Extra columns are ignored.
Texts are read whole; a very long one is split into words a megabyte at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch, buckets_for, pick, word_runs
from quillstone.llm.ngram_join import components

SEED = 42
#: Fingerprints of a group that are searched by one task at most, and that a task searches together.
GROUP, TOGETHER = 1 << 16, 1 << 15
FAN = 8
#: Pairs of nodes that are opened at a time.
OPENED = 1 << 14
ALL = (1 << 64) - 1


def simhash(text: bytes, n: int = 4) -> int:
    """Bits that are set in over half of the XXH64 hashes of the text's shingles."""
    ones, total, tail = np.zeros(64, np.int64), 0, []
    for run in word_runs(text.lower()):
        words = tail + run
        tail = words[-(n - 1) :]
        if len(words) < n:
            tail = words
            continue
        # the words again, each after one space, so that a shingle is a slice
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.append(0, ends[:-1])
        for a in range(0, len(words) - n + 1, 1 << 15):
            b = min(a + (1 << 15), len(words) - n + 1)
            shingles = [joined[x:y] for x, y in zip(starts[a:b].tolist(), (ends[a + n - 1 : b + n - 1] - 1).tolist(), strict=True)]
            ones += bits(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles)))
            total += len(shingles)
    if not total and tail:
        ones, total = bits(np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], np.uint64)), 1
    return sum(1 << k for k in np.flatnonzero(2 * ones > total).tolist())


def bits(hashes: np.ndarray) -> np.ndarray:
    """How often each bit is set, lowest first."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, print (the fingerprint as a signed number)."""
    src = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([simhash(t.as_py() or b"", n) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return src.mapInArrow(run, "doc_id bigint, print bigint")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Where a fingerprint stands in the order in which neighbours differ in one bit."""
    for k in (32, 16, 8, 4, 2, 1):
        x = x ^ (x >> np.uint64(k))
    return x


@lru_cache(maxsize=4096)
def blocks(mask: int, most: int) -> tuple[int, ...]:
    """Masks of the given bits with one of ``most + 1`` blocks of the other bits each."""
    free = [k for k in range(64) if not mask >> k & 1]
    bounds = [len(free) * k // (most + 1) for k in range(most + 2)]
    return tuple(mask | sum(1 << k for k in free[a:b]) for a, b in zip(bounds, bounds[1:], strict=False))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def dealt(rows: DataFrame, most: int) -> DataFrame:
    """print, mask, own: each row (print, mask) once for each block of the bits that its mask leaves; own is what the print has there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, masks = (batch.column(c).to_numpy() for c in ("print", "mask"))
            for mask in np.unique(masks):
                own = prints[masks == mask]
                for block in blocks(int(mask) & ALL, most):
                    b = np.int64(signed(block))
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), b)), pa.array(own & b)], names=["print", "mask", "own"])

    return rows.select("print", "mask").mapInArrow(run, "print bigint, mask bigint, own bigint")


class Tree:
    """Nodes over runs of ``FAN`` neighbours, level by level from the leaves; node k of a level lies over nodes FAN * k and on of the one below."""

    def __init__(self, prints: np.ndarray, groups: np.ndarray):
        full = np.full(len(prints), ALL, np.uint64)
        self.levels = [(full, prints, groups, groups)]
        while len(self.levels[-1][0]) > 1:
            mask, pattern, low, high = self.levels[-1]
            starts = np.arange(0, len(mask), FAN)
            first = np.repeat(pattern[starts], np.diff(np.append(starts, len(mask))))
            shared = np.bitwise_and.reduceat(mask & ~(pattern ^ first), starts)
            self.levels.append((shared, pattern[starts] & shared, np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)))

    def residual(self, level: int) -> np.ndarray:
        """What a level's masks hold beyond their parents'."""
        mask = self.levels[level][0]
        if level + 1 == len(self.levels):
            return mask
        return mask & ~self.levels[level + 1][0][np.arange(len(mask)) // FAN]


def forest(prints: np.ndarray, groups: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints that span the components of each group; groups are numbers, prints are distinct in each."""
    order = np.lexsort((gray_rank(prints), groups))
    prints, groups = prints[order], groups[order]
    tree = Tree(prints, groups)
    residuals = [tree.residual(k) for k in range(len(tree.levels))]
    label = np.arange(len(prints))

    def joined(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal label
        while True:
            x, y = label[a], label[b]
            open_ = x != y
            if not open_.any():
                return
            a, b = a[open_], b[open_]
            np.minimum.at(label, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
            while (label[label] != label).any():
                label = label[label]

    def descend(level: int, a: np.ndarray, b: np.ndarray, so_far: np.ndarray) -> None:
        """Pairs a <= b of a level's nodes, with the differences in what both hold."""
        if level == 0:
            joined(a, b)
            return
        for k in range(0, len(a), OPENED):
            opened(level, a[k : k + OPENED], b[k : k + OPENED], so_far[k : k + OPENED])

    def opened(level: int, a: np.ndarray, b: np.ndarray, so_far: np.ndarray) -> None:
        held = tree.levels[level][0]
        mask, pattern, low, high = tree.levels[level - 1]
        n, fan = len(mask), np.arange(FAN)
        left = (a[:, None] * FAN + fan)[:, :, None] + np.zeros(FAN, np.int64)
        right = (b[:, None] * FAN + fan)[:, None, :] + np.zeros((FAN, 1), np.int64)
        keep = (left < n) & (right < n) & ((left < right) | ((left == right) & (level > 1)))
        pair = np.nonzero(keep)[0]
        x, y = left[keep], right[keep]
        keep = (low[x] <= high[y]) & (low[y] <= high[x])
        if level == 1:
            keep &= label[x] != label[y]
        pair, x, y = pair[keep], x[keep], y[keep]
        # what both hold now, but for what both parents held
        new = (held[a[pair]] & residuals[level - 1][y]) | (residuals[level - 1][x] & mask[y])
        total = so_far[pair] + np.bitwise_count((pattern[x] ^ pattern[y]) & new)
        near = total <= most
        if near.any():
            descend(level - 1, x[near], y[near], total[near])

    top = len(tree.levels) - 1
    if top:
        descend(top, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))
    child = np.flatnonzero(label != np.arange(len(label)))
    return prints[child], prints[label[child]]


def linked(groups: DataFrame, most: int, partitions: int) -> DataFrame:
    """v, w: forests over the fingerprints of each group (mask, own); a task takes groups together up to ``TOGETHER`` fingerprints."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(parts: list[np.ndarray]) -> pa.RecordBatch:
            held = np.concatenate(parts, axis=1)
            number = np.cumsum((held[0, 1:] != held[0, :-1]) | (held[1, 1:] != held[1, :-1]))
            v, w = forest(held[2].view(np.uint64), np.append(0, number), most)
            return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(w.view(np.int64))], names=["v", "w"])

        waiting, held = [], 0
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in ("mask", "own", "print")])
            waiting.append(rows)
            held += rows.shape[1]
            if held >= TOGETHER:
                rows = np.concatenate(waiting, axis=1)
                last = np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))
                if len(last):  # the last group may go on
                    cut = last[-1] + 1
                    yield found([rows[:, :cut]])
                    rows = rows[:, cut:]
                waiting, held = [rows], rows.shape[1]
        if held:
            yield found(waiting)

    placed = groups.repartition(partitions, "mask", "own").sortWithinPartitions("mask", "own").select("mask", "own", "print")
    return placed.mapInArrow(run, "v bigint, w bigint")


def links(distinct: DataFrame, most: int, partitions: int) -> Scratch:
    """v, w: pairs of fingerprints whose graph has the components of all pairs that differ in at most ``most`` bits."""
    groups = dealt(distinct.select("print", F.lit(0).cast("long").alias("mask")), most)
    found: DataFrame | None = None
    held: list[Scratch] = []
    while True:
        placed = Scratch.write(groups)
        held.append(placed)
        large = Scratch.write(placed.read().groupBy("mask", "own").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select("mask", "own"))
        held.append(large)
        if not large.read().limit(1).count():
            small, groups = placed.read(), None
        else:
            marked = placed.read().join(large.read().withColumn("large", F.lit(True)), ["mask", "own"], "left")
            small, groups = marked.where("large IS NULL").drop("large"), dealt(marked.where("large"), most)
        own = linked(small, most, partitions)
        found = own if found is None else found.unionByName(own)
        if groups is None:
            break
    out = Scratch.write(found.distinct())
    for done in held:
        done.drop()
    return out


def near_duplicates(docs: DataFrame, n: int = 4, most: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (least id that links reach)."""
    src = pick(docs, doc_id=id_col, text=text_col)
    rows = Scratch.write(fingerprints(src, n))
    prints = Scratch.write(rows.read().where("doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("least")))
    pairs = links(prints.read(), most, buckets_for(src))
    vertices = pairs.read().select(F.explode(F.array("v", "w")).alias("v")).distinct()
    roots = components(vertices, pairs.read())
    named = prints.read().join(roots.read().select(F.col("v").alias("print"), "label").hint("merge"), "print", "left")
    of_root = named.where("label IS NOT NULL").groupBy("label").agg(F.min("least").alias("lowest"))
    settled = Scratch.write(named.join(of_root.hint("merge"), "label", "left").select("print", F.coalesce("lowest", "least").alias("component")))
    for done in (prints, pairs, roots):
        done.drop()
    component = F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id")
    return rows.read().join(settled.read(), "print", "left").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), component)
