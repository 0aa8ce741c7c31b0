"""SpotSigs fingerprints: chains of content words that follow common-word anchors, compared through pruned Jaccard.

A text's signatures are, for each place of an anchor, the anchor and the next ``CHAIN`` words that aren't anchors. The
fingerprint is the sorted set of their hashes (40 bits each, in hexadecimal); likeness is the Jaccard similarity of two
sets. Two sets whose sizes differ so much that they can't reach a threshold are told apart without being read: the sets
are partitioned by length so that only neighbouring partitions can meet.

Texts without an anchor that content words follow are signed by the chains of all their words, texts with fewer words by
the words they have, texts without words by themselves: equal texts have equal fingerprints in every case.

The next document in the order of ids is found without a global sort in one task: ids are dealt into ranges, each range
is a partition, and the first document of each range is also sent, as a guest, to the partition before it. Texts are
shuffled once.

Defined results. Null texts count as empty; two empty texts have likeness 1. A null id comes before all others. Repeated
ids are ordered by their texts. The document after the last is the first; a single document is its own next. No rows: no
rows. Texts are signed whole. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch, pick, range_of, range_starts, shuffle_partitions, text_or_empty

#: The most common words of English, German, French and Spanish.
ANCHORS = frozenset(
    "the of and to in a is it that was for on are as with be by this from or an at have not"
    " der die das und ist von zu den mit ein im auf des dem nicht eine sich"
    " le la les et un une du que qui est dans pour par sur pas au avec"
    " el los las y en que del se por con para su una al lo como".split()
)
WORD = re.compile(r"\w+")
CHAIN = 2
SMALLEST = -(1 << 63)


def signatures(text: str) -> np.ndarray:
    """The sorted distinct hashes of the text's chains."""
    words = WORD.findall(text.lower())
    content = [w for w in words if w not in ANCHORS]
    chains: set[str] = set()
    k = 0
    last = len(content) - CHAIN
    for w in words:
        if w in ANCHORS:
            if k > last:
                break
            chains.add(f"{w} {' '.join(content[k : k + CHAIN])}")
        else:
            k += 1
    if not chains:
        chains = {" ".join(words[i : i + CHAIN + 1]) for i in range(max(1, len(words) - CHAIN))} if words else {text}
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, chains), np.uint64, len(chains))
    return np.unique(hashes >> np.uint64(24))


def fingerprint(signed: np.ndarray) -> str:
    return signed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex()


def partition_of(size: int, threshold: float) -> int:
    """Sets whose partitions aren't equal or neighbours can't reach the threshold."""
    return int(math.log(max(size, 1)) / -math.log(threshold))


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity; 0 without reading the sets if their sizes show that it is below ``least``."""
    small, large = sorted((len(a), len(b)))
    if least > 0 and (abs(partition_of(small, least) - partition_of(large, least)) > 1 or small < least * large):
        return 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (small + large - shared) if large else 1.0


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much, or all, of the beginning of the following text."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text, guest: partitions of ascending ids, each followed by the first document of the next one."""
    spark = docs.sparkSession
    keyed = docs.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(SMALLEST)))
    starts = range_starts(keyed.select("key"), "key", shuffle_partitions(spark))
    n = max(1, len(starts))
    own = range_of(starts)(F.col("key"))
    ranged = keyed.withColumn("own", own)
    first = F.col("key") == F.element_at(F.array(*[F.lit(s) for s in starts or [SMALLEST]]), F.col("own") + 1)
    places = F.when(first, F.array(F.struct(F.col("own").alias("range"), F.lit(False).alias("guest")), F.struct(((F.col("own") + n - 1) % n).alias("range"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.col("own").alias("range"), F.lit(False).alias("guest"))))
    dealt = ranged.select("doc_id", "text", "key", F.inline(places)).repartitionById(n, F.col("range").cast("int"))
    return dealt.sortWithinPartitions("guest", "key", "text").select("doc_id", "text", "guest"), n


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    src = pick(docs, doc_id=id_col, text=text_col).withColumn("text", text_or_empty(F.col("text")))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            rows: list[tuple] = []
            for i, text, guest in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if waiting is None and guest:
                    continue
                signed = signatures(text)
                if waiting is not None:
                    last_id, last_text, last_signed = waiting
                    changed = edited(last_text, text)
                    signed_changed = signatures(changed)
                    rows.append((last_id, len(last_text), hashlib.sha256(changed.encode()).hexdigest(), fingerprint(last_signed), fingerprint(signed_changed), likeness(last_signed, signed_changed), likeness(last_signed, signed)))
                waiting = None if guest else (i, text, signed)
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            kinds = (batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    ordered, _ = with_next(src)
    kind = src.schema["doc_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, own array<long>: every text's signatures."""
    src = pick(docs, doc_id=id_col, text=text_col).withColumn("text", text_or_empty(F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([signatures(t.as_py()).astype(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))], names=["doc_id", "own"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, own array<bigint>")


def near_pairs(docs: DataFrame, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Classes of equal fingerprints (doc_id, class), and pairs of classes (a, b, likeness) of likeness threshold or more.

    Fingerprints are partitioned by their length: a set meets its own partition and the next longer one. Within these an
    index of each set's rarest signatures finds the candidates, and the room left after a shared one, in the order of
    rarity, must suffice: what is far is pruned before it is paired. Pairs are verified by intersection. A class is named
    by its least id; ids that are null are left out.
    """
    sets = Scratch.write(signed(docs, id_col, text_col).where("doc_id IS NOT NULL").withColumn("print", F.sha2(F.array_join(F.col("own").cast("array<string>"), ","), 256))).read()
    prints = sets.groupBy("print").agg(F.min("doc_id").alias("class"))
    # written, so that a fingerprint that many documents share is split between tasks
    classes = Scratch.write(prints).read()
    members = sets.select("doc_id", "print").join(classes, "print").select("doc_id", "class")
    one = Scratch.write(sets.join(classes.withColumnRenamed("class", "doc_id"), ["print", "doc_id"]).dropDuplicates(["print"]).select(F.col("doc_id").alias("class"), "own", F.size("own").alias("n")).withColumn("part", F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold)).cast("int"))).read()
    held = one.select("class", "n", "part", F.explode("own").alias("sig"))
    many = held.groupBy("sig").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    # a signature that no other set has comes first in the order and is only counted
    shared = held.join(many, "sig").withColumn("back", F.expr("row_number() OVER (PARTITION BY class ORDER BY many DESC, sig DESC)"))
    index = Scratch.write(shared.withColumn("room", F.col("back")).where(F.col("room") >= F.ceil(F.lit(threshold) * F.col("n"))).select("class", "n", "part", "sig", "room")).read()
    longer = index.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.explode(F.array("part", F.col("part") - 1)).alias("part"), "sig", F.col("room").alias("room_b"))
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("n_b")) - 1e-9)
    fits = ((F.col("n") < F.col("n_b")) | ((F.col("n") == F.col("n_b")) & (F.col("class") < F.col("b")))) & (F.col("n") >= threshold * F.col("n_b")) & (F.least("room", "room_b") >= need)
    candidates = index.join(longer, ["part", "sig"]).where(fits).select(F.col("class").alias("a"), "b").distinct()
    left, right = one.select(F.col("class").alias("a"), "own"), one.select(F.col("class").alias("b"), F.col("own").alias("other"))
    scored = candidates.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("own", "other")))
    return members, scored.select("a", "b", (F.col("both") / (F.size("own") + F.size("other") - F.col("both"))).alias("likeness")).where(F.col("likeness") >= threshold)
