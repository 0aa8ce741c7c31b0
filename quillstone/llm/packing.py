"""Best-fit packing of token sequences by linear grouping.

The plan is made on the histogram of piece lengths, which has at most ``capacity`` entries whatever the corpus holds:

1. Large lengths, ascending, are dealt into groups of equal cardinality and rounded up to the largest of their group.
2. Few-size configurations are optimised: for the largest size left, a subset-sum table finds the fullest configuration,
   which is used as often as the sizes last.
3. Actual documents take the places of the rounded ones, so sequences get gaps of known size.
4. Small ones go by best fit, longest first, into the tightest gap, or into new sequences.

Each step is made for a run of equal sequences at once, so that the plan is a short table of runs: pieces of this
length with these ranks go to sequences from this one on, at this offset. A piece finds its run by its rank among the
pieces of its length; ranks are counted in two levels, (length, bucket) and within it, so that a length that a third of
all pieces share isn't ranked by one task. Buckets follow ids and what the pieces hold, so that rows without an id are dealt out too.

Defined results. Null and empty texts are one piece, the closing id. Repeated rows are packed once each. A document
longer than the capacity is cut so that its first piece is the short one. No rows: no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.byte_bpe import Codec, byte_alphabet, codec_from_json, cut_long
from quillstone.llm.common import Scratch, pick, shuffle_partitions

PIECES = "doc_id {}, piece int, start bigint, length bigint, ids_crc32 bigint"


def merges_by_id(codec: Codec) -> bool:
    """Whether merging any two neighbours whose joined bytes are a token, lowest id first, gives what the file's merges give.

    It does if ids ascend with the merges and every token comes out whole from its own bytes. For take the first merge on
    which the two differ, of neighbours a and b to token t: no merge has crossed the ends of t's bytes so far, so they look
    as they do when t is merged on its own; there, all that t's own merge (c, d) needs has a lower id than t and is done, so
    a and b are c and d.
    """
    model = json.loads(codec.tokenizer.to_str())["model"]
    if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return False
    vocab = model["vocab"]
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    single = {vocab.get(c) for c in byte_alphabet().values()}
    if None in single or None in made or any(a >= b for a, b in zip([max(single), *made], made, strict=False)):
        return False
    return {*vocab.values()} <= {*single, *made, *codec.specials.values()} and all(len(codec.tokenizer.model.tokenize(name)) == 1 for name, i in vocab.items() if i not in single and name not in codec.specials)


class FastCodec(Codec):
    """The same ids by a faster merge of the same vocabulary, where that is proven of the file, for texts that split alike; else by the library."""

    def __init__(self, codec: Codec):
        import tiktoken
        from public_tokenizers import PATTERN

        self.__dict__.update(codec.__dict__)
        self.alike, self.odd = set(), set()
        self.proven = merges_by_id(codec)
        special = {*self.specials.values()}
        self.fast = tiktoken.Encoding("pack", pat_str=PATTERN, mergeable_ranks={raw: i for i, raw in enumerate(codec.bytes_of) if i not in special}, special_tokens={})

    def _splits_alike(self, text: str) -> bool:
        if not self.proven:
            return False
        chars = set(text)
        for c in chars - self.alike:
            if c not in self.odd:
                probe = f"a{c}a 1{c}1 !{c}! {c} {c}{c} _{c}"
                same = self.tokenizer.encode(probe, add_special_tokens=False).ids == self.fast.encode_ordinary(probe)
                (self.alike if same else self.odd).add(c)
        return self.odd.isdisjoint(chars)

    def _plain(self, text: str) -> bytes:
        return b"".join(np.array(self.fast.encode_ordinary(p), "<u4").tobytes() if self._splits_alike(p) else self._library([p])[0] for p in cut_long(text))


@lru_cache(maxsize=2)
def fast_codec(path: str) -> FastCodec:
    return FastCodec(codec_from_json(path))


def pieces(docs: DataFrame, vocabulary: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", closing_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every text's ids and the closing id, cut where longer than the capacity."""
    closing = np.uint32(closing_id).astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = fast_codec(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            source: list[int] = []
            for k, text in enumerate(batch.column(1)):
                ids = codec.encode(text.as_py()) + closing
                n = len(ids) // 4
                first = n % capacity or capacity
                bounds = [0, *range(first, n + 1, capacity)] if n > capacity else [0, n]
                rows += [(p, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for p, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
                source += [k] * (len(bounds) - 1)
            piece, start, length, crc = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    src = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    return src.mapInArrow(run, PIECES.format(src.schema["doc_id"].dataType.simpleString()))


def fullest(room: int, sizes: list[int], counts: list[int]) -> list[int]:
    """Indexes (with repeats) of sizes that together fill as much of ``room`` as they can, by a bit set of reachable sums."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    full = 1 << room
    for k, (size, count) in enumerate(zip(sizes, counts, strict=True)):
        for _ in range(min(count, room // size)):
            more = (reach | reach << size) & mask
            if more == reach:
                break
            steps.append((k, reach))
            reach = more
            if reach & full:
                break
        if reach & full:
            break
    left, chosen = reach.bit_length() - 1, []
    for k, before in reversed(steps):
        if not before >> left & 1:
            chosen.append(k)
            left -= sizes[k]
    return chosen


def plan(histogram: dict[int, int], capacity: int, groups: int = 1000, small: int = 256) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, number, first sequence, offset) for all pieces, and the number of sequences."""
    runs: list[tuple[int, int, int, int, int]] = []
    ranks = dict.fromkeys(histogram, 0)
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    bins = 0

    def place(length: int, n: int, first_bin: int, room: int) -> None:
        runs.append((length, ranks[length], n, first_bin, capacity - room))
        ranks[length] += n

    large = [(length, n) for length, n in sorted(histogram.items()) if length > small and n]
    total = sum(n for _, n in large)
    share = max(1, -(-total // groups))
    members: list[list[list[int]]] = []  # for each group its actual [length, number], ascending
    room = 0
    for length, n in large:
        while n:
            if not room:
                members.append([])
                room = share
            take = min(n, room)
            members[-1].append([length, take])
            n, room = n - take, room - take
    members.reverse()  # largest group first
    sizes, counts = [g[-1][0] for g in members], [sum(n for _, n in g) for g in members]
    while any(counts):
        alive = [k for k, n in enumerate(counts) if n]
        first = alive[0]
        counts[first] -= 1
        rest = fullest(capacity - sizes[first], [sizes[k] for k in alive], [counts[k] for k in alive])
        counts[first] += 1
        slots = [first, *[alive[k] for k in rest]]
        times = min(counts[k] // slots.count(k) for k in set(slots))
        for k in slots:
            counts[k] -= times
        # slots take actual lengths, longest first; sequences with the same lengths stay one run
        drawn = []
        for k in slots:
            need, own = times, []
            while need:
                take = min(need, members[k][-1][1])
                own.append((members[k][-1][0], take))
                members[k][-1][1] -= take
                need -= take
                if not members[k][-1][1]:
                    members[k].pop()
            drawn.append(own)
        done, at, used = 0, [0] * len(slots), [0] * len(slots)
        while done < times:
            n = min(drawn[j][at[j]][1] - used[j] for j in range(len(slots)))
            left = capacity
            for j in range(len(slots)):
                length = drawn[j][at[j]][0]
                place(length, n, bins + done, left)
                left -= length
                used[j] += n
                if used[j] == drawn[j][at[j]][1]:
                    at[j], used[j] = at[j] + 1, 0
            gaps[left].append((bins + done, n))
            done += n
        bins += times
    for length in sorted((x for x in histogram if x <= small), reverse=True):
        n, gap = histogram[length], length
        while n:
            while gap <= capacity and not gaps[gap]:
                gap += 1
            if gap > capacity:
                fresh = -(-n // (capacity // length))
                gaps[capacity].append((bins, fresh))
                bins += fresh
                gap = capacity
            first, there = gaps[gap].pop()
            take = min(n, there)
            place(length, take, first, gap)
            gaps[gap - length].append((first, take))
            if there > take:
                gaps[gap].append((first + take, there - take))
            n -= take
            gap = gap - length if gap - length >= length else gap
    return runs, bins


def ranked(pieces_df: DataFrame, partitions: int) -> DataFrame:
    """With rank: from 0 among the pieces of the same length."""
    bucketed = pieces_df.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(partitions)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = bucketed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return bucketed.withColumn("own", within).join(starts, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("base")).drop("own", "base", "bucket")


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, groups: int = 1000, small: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    spark = docs.sparkSession
    cut = Scratch.write(pieces(docs, vocabulary, capacity, id_col, text_col)).read()
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    runs, _ = plan(histogram, capacity, groups, small)
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 48) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    order = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked(cut, shuffle_partitions(spark)).select(*order, "rank").mapInArrow(run, PIECES.format(cut.schema["doc_id"].dataType.simpleString()) + ", sequence_id bigint, offset bigint")
