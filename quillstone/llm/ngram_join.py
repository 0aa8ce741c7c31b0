"""Exact Jaccard self-join of word n-gram sets by partitioning the universe, and its connected components.

Two sets that reach the threshold differ in at most U elements, a number that follows from their sizes. Sizes are dealt
into overlapping bands so that any two sets that can link share a band. In a band, elements are hashed into segments;
what a set holds in a segment, hashed, is a signature. Each differing element spoils one segment at most, so a set with
more than U filled segments shares one of them with every partner (pigeonhole). Where U is 1 at most (sizes to 5, or less
below 70 percent), one segment with its one-deletion neighbourhood (the set, and the set without each element in turn)
makes partners meet as well; so it does for any number of segments, each worth two if it holds two elements. A band takes
exact segments or neighbourhoods, whichever costs less: signatures, and unrelated sets that they are expected to meet. Its
number of segments is the cheapest that leaves every size of the band enough of them with seven standard deviations to
spare; whether every set has enough is counted, and if one hasn't, another seed is taken.

Within a set, signatures are allocated by cost too: of its N it needs only the U + 1 rarest of the corpus, as its partner
has at least N - U of them in common; the rest of its segments get none. A set with U + 1 signatures that nobody shares can
have no partner; very common passages, which fill few segments of a set, are left out by being common.

Sets that share an allocated signature aren't paired with each other but with the least of them. Pairs are verified by
the intersection of the sets. Only where a signature's sets aren't all in one component yet, those of different
components are paired and verified too, by their rarest elements and the room that is left after them: no link that
joins two components is lost, no group is expanded that is one component already. Equal sets are one vertex throughout.

Signatures travel packed, a few thousand to a row. A task sends a set once, however many copies of it it reads; a bucket
is worked off in runs of neighbouring signatures, so that what is held is a small share of it, and the number of buckets
follows the bytes of the input.

Defined results. Null texts and texts without words have no set, link with nothing, and are their own component. Texts
with fewer words than n have one element, all their words. Rows with the same id are one vertex; rows without an id link
with nothing and have a null component. Texts are read whole. No rows: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch, buckets_for, pick

U64 = np.uint64
#: Odd multipliers for the words of an n-gram and for mixing.
ODD = [U64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
SLICE = 1500
#: Signature records that a task packs at a time, the fewest for which a bucket's are parted, and into how many packs at most (powers of 2).
RECORDS, PACK, RUNS = 1 << 20, 64, 6
SIG_BITS, NODE_BITS = 39, 48
#: The cost of a signature's meeting unrelated sets, in signatures, and the share of elements that unrelated sets have in common.
MEETING, COMMON = 50, 0.05
RECORD = np.dtype([("sig", "V5"), ("node", "V6")])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams; words are parted by ASCII white space, A-Z lower-cased."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, U64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words), seed=len(words))], U64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))
    count = len(words) - n + 1
    total = np.zeros(count, U64)
    for k in range(n):
        total += mix(h[k : k + count] + U64(k)) * ODD[k % len(ODD)]
    return np.unique(mix(total))


class Bands:
    """Sizes, segments and needed signatures for a threshold of percent / 100."""

    def __init__(self, percent: int, seed: int = 0):
        if not 50 < percent <= 100:
            raise ValueError("below 51 percent a set of two can differ from its partner in as many elements as it has")
        self.percent, self.seed = percent, seed
        # band 0 goes as far as its one-deletion neighbourhoods serve
        for top in (5, 4, 3, 2, 1):
            self.tops = [top * 2**k for k in range(48)]
            if all(Bands.spoiled.__wrapped__(self, s, 0) <= 1 for s in range(1, top + 1)):
                break

    def need(self, total: int) -> int:
        """Least intersection of two linked sets whose sizes add up to ``total``: i * 100 >= percent * (total - i)."""
        return -(-self.percent * total // (100 + self.percent))

    def least(self, band: int) -> int:
        """Smallest size in a band: the smallest partner of the smallest set above the band before."""
        return 1 if band == 0 else -(-self.percent * (self.tops[band - 1] + 1) // 100)

    def of(self, size: int) -> list[int]:
        own = next(k for k, top in enumerate(self.tops) if size <= top)
        return [own, own + 1] if size >= self.least(own + 1) else [own]

    @lru_cache(maxsize=None)  # noqa: B019
    def spoiled(self, size: int, band: int) -> int:
        """U: in how many elements a set can differ from a partner in the band, at most."""
        high = min(self.tops[band], size * 100 // self.percent)
        low = max(self.least(band), -(-size * self.percent // 100))
        return max((size + other - 2 * self.need(size + other) for other in range(max(low, high - 8), high + 1)), default=0)

    @lru_cache(maxsize=None)  # noqa: B019
    def exact_segments(self, band: int) -> int:
        top, low = self.tops[band], self.least(band)
        if top <= 40:
            # where a small set needs all of its elements in segments of their own, none may meet
            return 4096 if self.tops[0] == 5 else 1 << 32
        return self.fewest(band, 0.3 * top, sorted({low, *range(low, top, max(1, (top - low) // 16)), top}), self.filled)

    @lru_cache(maxsize=None)  # noqa: B019
    def deletion_segments(self, band: int) -> int:
        """0 where no number of neighbourhoods is sure to be enough."""
        top, low = self.tops[band], self.least(band)
        sizes = sorted({low, *range(low, top, max(1, (top - low) // 16)), top})
        if all(min(s, 2) > self.spoiled(s, band) for s in sizes):
            return 1
        return self.fewest(band, 0.1 * top, sizes, self.units, 1000 * top) if top > 40 else 0

    def fewest(self, band: int, m: float, sizes: list[int], enough, most: float = math.inf) -> int:
        """The number of segments from ``m`` on that gives all sizes enough; 0 if none up to ``most`` does."""
        while not all(enough(s, m) >= self.spoiled(s, band) + 1 for s in sizes):
            m *= 1.03
            if m > most:
                return 0
        return int(m) + 1

    @staticmethod
    def filled(size: int, m: float) -> float:
        """Filled segments that a set of this size has but for seven standard deviations."""
        a = size / m
        return m * (1 - math.exp(-a)) - 7 * math.sqrt(m * math.exp(-a) * (1 - (1 + a) * math.exp(-a)))

    @staticmethod
    def units(size: int, m: float) -> float:
        """What neighbourhoods are worth, one for a segment with one element and two for others, but for seven standard deviations."""
        a = size / m
        none, one = math.exp(-a), a * math.exp(-a)
        mean = one + 2 * (1 - none - one)
        spread = one + 4 * (1 - none - one) - mean**2 - (2 * a - one - a * mean) ** 2 / a
        return m * mean - 7 * math.sqrt(m * max(0.0, spread))

    @lru_cache(maxsize=None)  # noqa: B019
    def costs(self, band: int) -> tuple[float, float]:
        """Of exact segments and of neighbourhoods for the band's largest size: signatures, and what they meet."""
        size = self.tops[band]

        def total(m: int, own) -> float:
            if m == 1:
                return own(size)
            a = size / m
            return m * sum(math.exp(-a + k * math.log(a) - math.lgamma(k + 1)) * own(k) for k in range(1, int(a + 12 * math.sqrt(a) + 12)))

        one = lambda k: 1 + MEETING * COMMON**k
        deletion = self.deletion_segments(band)
        return total(self.exact_segments(band), one), total(deletion, lambda k: one(k) + (k * one(k - 1) if k > 1 else 0)) if deletion else math.inf

    @lru_cache(maxsize=None)  # noqa: B019
    def deletes(self, band: int) -> bool:
        exact, deletion = self.costs(band)
        return deletion < exact

    def segments(self, band: int) -> int:
        return self.deletion_segments(band) if self.deletes(band) else self.exact_segments(band)

    def signatures(self, own: np.ndarray, band: int) -> tuple[np.ndarray, int]:
        """The set's signatures in the band, and how many spoiling elements they are proof against, plus one."""
        salt = U64((band * 0x9E3779B97F4A7C15 + self.seed * 0xD1B54A32D192ED03 + 1) & (2**64 - 1))
        content = mix(own + salt)
        segment = (mix(own ^ salt) >> U64(32)) * U64(self.segments(band)) >> U64(32)
        order = np.argsort(segment)
        segment, content = segment[order], content[order]
        starts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
        whole, named = np.add.reduceat(content, starts), mix(segment[starts] + salt)
        if not self.deletes(band):
            return mix(whole + named), len(starts)
        held = np.diff(np.append(starts, len(own)))
        several = np.repeat(held > 1, held)
        return mix(np.unique(np.append(whole + named, (np.repeat(whole + named, held) - content)[several]))), int(np.minimum(held, 2).sum())

    def needed(self, size: int, band: int) -> int:
        """How many of its signatures a set must show."""
        return self.spoiled(size, band) + 1


DEALT = "bucket int, run int, blob binary"
FOUND = "kind int, a bigint, b bigint, c bigint, d bigint, e bigint, f bigint"
DOC, SHARED = 0, 1


def as_bytes(values: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).view(f"V{n}").ravel()


def as_numbers(values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(values), 8), np.uint8)
    out[:, :n] = np.ascontiguousarray(values).view(np.uint8).reshape(-1, n)
    return out.view("<u8").ravel()


def dealt(docs: DataFrame, n: int, bands: Bands, buckets: int) -> DataFrame:
    """Packed records: each document's digest, size and what its signatures are worth (run -1); each signature with its set's digest.

    A pack of signatures is named by the run, the leading bits, of its first one; where a task has many, packs end with their runs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # 16 bytes for each different text of the task
        rows: list[tuple] = []
        sigs: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        held = 0

        def packed() -> pa.RecordBatch:
            table = np.array([[x & (2**64 - 1) for x in r] for r in rows], U64)
            where = (table[:, 1] % U64(buckets)).astype(np.int64)
            out = [(int(b), -1, table[where == b].tobytes()) for b in np.unique(where)]
            if sigs:
                sig, node = np.concatenate(sigs), np.concatenate(nodes)
                order = np.argsort(sig)
                sig = sig[order]
                record = np.empty(len(sig), RECORD)
                record["sig"], record["node"] = as_bytes(sig, 5), as_bytes(node[order], 6)
                bits = max(0, min(RUNS, (len(sig) // (buckets * PACK)).bit_length() - 1))
                place = sig >> U64(40 - bits)
                starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
                ends = np.append(starts[1:], len(sig))
                out += [(int(place[a]) >> bits, (int(place[a]) & ((1 << bits) - 1)) << (RUNS - bits), record[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            rows.clear(), sigs.clear(), nodes.clear()
            bucket, part, blob = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(part, pa.int32()), pa.array(blob, pa.binary())], names=["bucket", "run", "blob"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = shingles(text.as_py(), n)
                digest = xxhash.xxh3_128_digest(own.tobytes())
                high, low = (int.from_bytes(digest[k : k + 8], "little") for k in (0, 8))
                worth = [0, 0]
                if len(own):
                    for band in bands.of(len(own)):
                        s, worth[band % 2] = bands.signatures(own, band)
                        if digest not in seen:
                            sigs.append((s >> U64(64 - SIG_BITS)) << U64(1) | U64(band % 2) | (s % U64(buckets)) << U64(40))
                            nodes.append(np.full(len(s), high >> 16, U64))
                            held += len(s)
                    seen.add(digest)
                rows.append((0 if i is None else i, high, low, len(own), worth[0] | (i is None) << 62, worth[1]))
                if held >= RECORDS or len(rows) >= RECORDS:
                    yield packed()
                    held = 0
        if rows:
            yield packed()

    return docs.mapInArrow(run, DEALT)


def met(deal: DataFrame, buckets: int) -> DataFrame:
    """DOC rows as they came; for each signature of two sets or more a SHARED row for each of them: node, signature, parity of the band, number of sets."""
    names = ["kind", *"abcdef"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def met_in(bucket: int, sig: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
            order = np.lexsort((node, sig))
            sig, node = sig[order], node[order]
            first = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]))
            sig, node = sig[first], node[first]
            starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            count = np.diff(np.append(starts, len(sig)))
            count = np.repeat(count, count)
            keep = count > 1
            sig, node, count = sig[keep], node[keep], count[keep]
            for k in range(0, len(sig), 200_000):
                s, v, c = (x[k : k + 200_000] for x in (sig, node, count))
                none = pa.array(np.zeros(len(s), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), SHARED, np.int32)), pa.array(v.astype(np.int64)), pa.array((s | U64(bucket) << U64(40)).astype(np.int64)), pa.array((s & U64(1)).astype(np.int64)), pa.array(c.astype(np.int64)), none, none], names=names)

        def complete(bucket: int, upto: int) -> Iterator[pa.RecordBatch]:
            """Works off the signatures before a run; packs still to come begin with it or later ones."""
            if waiting:
                sig, node = (np.concatenate(x) for x in zip(*waiting, strict=True))
                waiting.clear()
                done = sig < U64(upto << (40 - RUNS))
                if done.any():
                    yield from met_in(bucket, sig[done], node[done])
                if not done.all():
                    waiting.append((sig[~done], node[~done]))

        place: tuple[int, int] = (0, 0)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for bucket, part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if part < 0:
                    table = np.frombuffer(blob.as_py(), np.int64).reshape(-1, 6)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(table), DOC, np.int32)), *[pa.array(table[:, k].copy()) for k in range(6)]], names=names)
                    continue
                if (bucket, part) != place:
                    yield from complete(place[0], part if bucket == place[0] else 1 << RUNS)
                    place = bucket, part
                record = np.frombuffer(blob.as_py(), RECORD)
                waiting.append((as_numbers(record["sig"], 5), as_numbers(record["node"], 6)))
        yield from complete(place[0], 1 << RUNS)

    return deal.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "run").mapInArrow(run, FOUND)


def needed_sql(bands: Bands) -> str:
    """SQL from a set's size and a band's parity to what its signatures must be worth; negative where all of them are shown."""
    p, last = bands.percent, 24  # no set has more elements than a text has bytes
    band = f"CASE {' '.join(f'WHEN size <= {top} THEN {k}' for k, top in enumerate(bands.tops[:last]))} ELSE {last} END"
    own = f"({band} + CASE WHEN ({band}) % 2 = parity THEN 0 ELSE 1 END)"
    top = f"element_at(array({', '.join(f'{t}L' for t in bands.tops[: last + 2])}), CAST({own} + 1 AS INT))"
    least = f"element_at(array({', '.join(f'{bands.least(k)}L' for k in range(last + 2))}), CAST({own} + 1 AS INT))"
    high, low = f"least({top}, size * 100 DIV {p})", f"greatest({least}, (size * {p} + 99) DIV 100)"
    spoiled = f"array_max(transform(sequence(greatest({low}, {high} - 8), {high}), other -> size + other - 2 * (({p} * (size + other) + {99 + p}) DIV {100 + p})))"
    deleting = [k for k in range(last + 2) if bands.deletes(k)]
    sign = f"CASE WHEN {own} IN ({', '.join(map(str, deleting))}) THEN -1 ELSE 1 END" if deleting else "1"
    return f"CASE WHEN greatest({low}, {high} - 8) <= {high} THEN ({spoiled} + 1) * {sign} ELSE {sign} END"


def sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The wanted rows (v and whatever else) with own array<long>: the sets of these documents, each read again from its text."""
    others = [c for c in wanted.columns if c != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                own = pa.array([shingles(t.as_py(), n).view(np.int64) for t in part.column(0)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], own], names=["v", *others, "own"])

    ddl = ", ".join(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in ("v", *others))
    return docs.join(wanted.withColumnRenamed("v", "doc_id").hint("merge"), "doc_id").select("text", F.col("doc_id").alias("v"), *others).mapInArrow(run, f"{ddl}, own array<bigint>")


def linked(both: DataFrame, percent: int) -> DataFrame:
    """Those pairs of (v, own, w, other) whose sets reach the threshold."""
    common = both.withColumn("common", F.size(F.array_intersect("own", "other")))
    return common.where(100 * F.col("common") >= percent * (F.size("own") + F.size("other") - F.col("common"))).select("v", "w")


#: Vertices up to which those of few pairs are broadcast, to leave the other sets where they are.
FEW = 100_000


def only(sets: DataFrame, vertices: DataFrame) -> DataFrame:
    """The sets of these vertices where they are few, so that the others needn't be moved; else all, for a join to choose from."""
    return sets.join(F.broadcast(vertices), "v", "left_semi") if vertices.limit(FEW + 1).count() <= FEW else sets


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (v, w) whose sets reach the threshold."""
    sets = only(sets, pairs.select(F.explode(F.array("v", "w")).alias("v")).distinct())
    left, right = sets.select("v", "own"), sets.select(F.col("v").alias("w"), F.col("own").alias("other"))
    return linked(pairs.join(left.hint("merge"), "v").join(right.hint("merge"), "w"), percent)


def across_components(unsettled: DataFrame, sets: DataFrame, percent: int) -> Scratch:
    """Pairs (v, w) of different components that may reach the threshold, for the vertices of unsettled signatures.

    Elements are ordered by how many of these sets hold them, rarest first. The first element that two linked sets share
    is among the first size - least overlap + 1 of either, where the overlap of the smaller one is at least what two sets
    of its size need, and what stands from there on in either leaves room for the overlap they need. What common passages
    make sets share stands last, so for it the room is what they share: a set of which they aren't six sevenths (at 75
    percent) never shows them as the smaller one, and sets that only such sets show are compared with nobody. Sets meet
    only where their sizes are in the same or neighbouring classes.
    """
    held = only(sets, unsettled.select("v")).join(unsettled.hint("merge"), "v").select("v", "label", F.size("own").alias("size"), F.explode("own").alias("element"))
    many = held.groupBy("element").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    placed = held.join(many.hint("merge"), "element", "left").withColumn("place", F.expr("row_number() OVER (PARTITION BY v ORDER BY many, element) - 1"))
    prefix = Scratch.write(placed.where(f"many > 1 AND place <= size - ({percent} * size + 99) DIV 100").select("v", "label", "size", "element", "place", F.floor(F.log(F.col("size").cast("double")) / math.log(100 / percent) if percent < 100 else F.lit(0)).cast("int").alias("class")))
    small = prefix.read().where(f"place <= size - ({2 * percent} * size + {99 + percent}) DIV {100 + percent}")
    large = prefix.read().select(*[F.col(c).alias(f"{c}_w") for c in ("v", "label", "size", "place")], "element", F.explode(F.array("class", F.col("class") - 1)).alias("class"))
    room = F.least(F.col("size") - F.col("place"), F.col("size_w") - F.col("place_w"))
    smaller = (F.col("size") < F.col("size_w")) | ((F.col("size") == F.col("size_w")) & (F.col("v") < F.col("v_w")))
    fits = (F.col("label") != F.col("label_w")) & smaller & ((100 + percent) * room >= percent * (F.col("size") + F.col("size_w")))
    pairs = Scratch.write(small.join(large.hint("merge"), ["element", "class"]).where(fits).select("v", F.col("v_w").alias("w")).distinct())
    prefix.drop()
    return pairs


def components(vertices: DataFrame, links: DataFrame) -> Scratch:
    """v, label: the least vertex that links reach.

    Each round takes the least label among neighbours, tells it to the vertex that the old label names, so that all with
    that label follow, then takes the label's label. Labels only fall, and rounds go on until none does: their number
    grows with the logarithm of a chain's length where ids are in no order (11 for 300, 22 for 100,000). A round is one
    job, which counts the labels that fell while it writes them; nothing in it is broadcast.
    """
    both = Scratch.write(links.unionByName(links.select(F.col("w").alias("v"), F.col("v").alias("w"))).distinct())
    labels = Scratch.write(vertices.select("v", F.col("v").alias("label")))
    changed = 1
    while changed:
        now = labels.read()
        offered = both.read().join(now.select(F.col("v").alias("w"), "label").hint("merge"), "w").groupBy("v").agg(F.min("label").alias("offer"))
        lowered = now.join(offered.hint("merge"), "v", "left").select("v", F.col("label").alias("old"), F.least("label", F.coalesce("offer", "label")).alias("label"))
        own, root = F.struct("v", "old", "label"), F.struct(F.col("old").alias("v"), F.lit(None).cast("long").alias("old"), "label")
        told = lowered.select(F.inline(F.when(F.col("label") < F.col("old"), F.array(own, root)).otherwise(F.array(own)))).groupBy("v").agg(F.max("old").alias("old"), F.min("label").alias("label"))
        jump = now.select(F.col("v").alias("label"), F.col("label").alias("further"))
        new, seen = told.join(jump.hint("merge"), "label").select("v", "old", F.least("label", "further").alias("label")), Observation()
        written = Scratch.write(new.observe(seen, F.count_if(F.col("old") != F.col("label")).alias("changed")))
        labels.drop()
        changed, labels = seen.get["changed"], written
    both.drop()
    return labels


def join(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least id that links reach)."""
    src = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    buckets = buckets_for(src)
    for seed in range(8):
        bands = Bands(percent, seed)
        found = Scratch.write(met(dealt(src, n, bands, buckets), buckets))
        rows = found.read().where(F.col("kind") == DOC).select(
            F.when(F.shiftright("e", 62) == 0, F.col("a")).alias("doc_id"), F.col("b").alias("high"), F.col("c").alias("low"), F.col("d").alias("size"),
            F.col("e").bitwiseAND(F.lit((1 << 62) - 1)).alias("n0"), F.col("f").alias("n1"),
        )
        filled = rows.where("size > 0 AND doc_id IS NOT NULL").groupBy("high", "low").agg(F.min("doc_id").alias("v"), *[F.first(c).alias(c) for c in ("size", "n0", "n1")])
        # one row for each set and band: how many signatures it has, and how many it must show
        shown = filled.select("high", "v", "size", F.inline(F.array(*[F.struct(F.lit(p).cast("long").alias("parity"), F.col(f"n{p}").alias("n")) for p in (0, 1)]))).where("n > 0").withColumn("must", F.expr(needed_sql(bands)))
        sets = Scratch.write(shown.select("v", F.shiftrightunsigned("high", 16).alias("node"), "size", "parity", "n", "must"))
        if not sets.read().where("abs(must) > n").limit(1).count():
            break
        found.drop()
        sets.drop()
    else:
        raise RuntimeError("no seed gave every set enough filled segments")

    shared = found.read().where(F.col("kind") == SHARED).select(F.col("a").alias("node"), F.col("b").alias("sig"), F.col("c").alias("parity"), F.col("d").alias("many"))
    per_set = F.expr("row_number() OVER (PARTITION BY node, parity ORDER BY many, sig)"), F.expr("count(1) OVER (PARTITION BY node, parity)")
    ranked = shared.withColumns({"place": per_set[0], "common": per_set[1]})
    # signatures that no other set has are the rarest and need no row
    allocated = ranked.join(sets.read(), ["node", "parity"]).where("must < 0 OR place <= must - (n - common)").select("v", "sig", "size")
    chosen = Scratch.write(allocated)

    groups = chosen.read().groupBy("sig").agg(F.min("v").alias("least"), F.max("v").alias("most")).where("least < most")
    stars = chosen.read().join(groups.hint("merge"), "sig").where("v <> least").select("v", F.col("least").alias("w")).distinct()
    pairs = Scratch.write(stars)
    # a set travels with the centres it is to be compared with, so that it is sent to each of them once
    spokes = pairs.read().groupBy("v").agg(F.collect_list("w").alias("ws"))
    hubs = pairs.read().select(F.col("w").alias("v")).distinct().withColumn("hub", F.lit(True))
    vertices = spokes.join(hubs.hint("merge"), "v", "full_outer")
    candidates = Scratch.write(sets_of(src, vertices, n))
    rays = candidates.read().select("v", "own", F.explode("ws").alias("w"))
    centres = candidates.read().where("hub").select(F.col("v").alias("w"), F.col("own").alias("other"))
    links = Scratch.write(linked(rays.join(centres.hint("merge"), "w"), percent))
    first = components(candidates.read(), links.read())

    labelled = Scratch.write(chosen.read().select("v", "sig").join(first.read().select("v", "label").hint("merge"), "v"))
    open_groups = labelled.read().groupBy("sig").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("sig")
    unsettled = Scratch.write(labelled.read().join(open_groups.hint("merge"), "sig").select("v", "label").distinct())
    across = across_components(unsettled.read(), candidates.read().select("v", "own"), percent)
    more = Scratch.write(verified(across.read(), candidates.read(), percent))
    # where nothing links two components, they stay as they are
    final = components(candidates.read(), links.read().unionByName(more.read())) if more.read().limit(1).count() else first

    whole = rows.select("doc_id", "high", "low", "size")
    # written, so that the join with all documents is split where many of them have the same set
    named = Scratch.write(filled.select("high", "low", "v").join(final.read().select("v", "label"), "v", "left").select("high", "low", F.coalesce("label", "v").alias("component")))
    for done in (sets, chosen, pairs, candidates, links, first, labelled, unsettled, across, more, final):
        done.drop()
    out = whole.join(named.read(), ["high", "low"], "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("doc_id"))).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose id is the least of its component, each such id once; rows without an id stay."""
    ids = Scratch.write(join(docs, n, percent, id_col, text_col).where("doc_id = component_id").select(F.col("doc_id").alias("least_id"))).read()
    key = F.col(f"`{id_col}`")
    repeated = ids.groupBy("least_id").count().where("count > 1").limit(1).count() > 0
    kept = docs.join((ids.distinct() if repeated else ids).hint("merge"), key.cast("long") == F.col("least_id"), "left_semi")
    if repeated:
        first = Window.partitionBy(id_col).orderBy(text_col)
        kept = kept.withColumn("place_of_id", F.row_number().over(first)).where("place_of_id = 1").drop("place_of_id")
    return kept.unionByName(docs.where(key.isNull()))
