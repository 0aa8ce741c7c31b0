"""Byte-level BPE: encoding by the tokenizers library over Arrow batches, character offsets, and decoding.

A pre-token (a match of the vocabulary's split pattern) is encoded on its own, so its ids are kept in a bounded memo
and the library sees each distinct pre-token about once in a worker. How a text splits is decided by the library:
every character is checked once against the library's own pre-tokenizer, and a text with a character on which the fast
splitter differs goes to the library whole.

Defined results. Null text: empty. Empty text: no ids, the hashes of no bytes. Repeated rows: one result each. Texts of
any length are encoded whole; long ones are cut only where a blank or line feed follows a plain letter, digit, comma or full
stop, where two pre-tokens always part (what other characters count as white space differs between libraries). Extra columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import in_slices, pick

# a task has one core; the library's own threads would only wait for each other
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The split pattern in the syntax of the standard library; like the library's but for rare characters, which are found out.
FAST_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: A place where two pre-tokens always part.
CUT = re.compile(r"(?<=[A-Za-z0-9.,])(?=[ \n])")
MEMO = 600_000
MEMO_CHARS = 64
PIECE_CHARS = 1 << 18


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one from U+0100."""
    plain = {b for first, last in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(first), ord(last) + 1)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


def tokenizer_from_ranks(path: str, pattern: str):
    """The library's tokenizer with the merges that a rank file implies.

    Any two neighbours whose joined bytes have a rank may merge, lowest rank first; so each way to part a token into
    two tokens is a merge of that token's rank.
    """
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in open(path, "rb") if line.strip())}
    alphabet = byte_alphabet()
    name = {token: "".join(alphabet[b] for b in token) for token in ranks}
    merges = [(name[token[:i]], name[token[i:]]) for token in sorted(ranks, key=ranks.get) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    tokenizer = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    tokenizer.decoder = decoders.ByteLevel()
    return tokenizer


class Codec:
    """Encoder and decoder of one vocabulary; texts in, ids as little-endian unsigned 32-bit integers out."""

    def __init__(self, tokenizer, specials: dict[str, int] | None = None):
        self.tokenizer, self.specials = tokenizer, specials or {}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.memo: dict[str, bytes] = {}
        self.alike: set[str] = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .,")
        self.odd: set[str] = set()
        self.names = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})
        back = {c: b for b, c in byte_alphabet().items()}
        self.bytes_of = [b""] * (max(tokenizer.get_vocab().values(), default=-1) + 1)
        for token, i in tokenizer.get_vocab().items():
            self.bytes_of[i] = token.encode() if token in self.specials else bytes(back[c] for c in token)

    def _splits_alike(self, text: str) -> bool:
        chars = set(text)
        for c in chars - self.alike:
            if c not in self.odd:
                probe = f"a{c}a 1{c}1 !{c}! {c} {c}{c} _{c}"
                same = [span for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)] == [m.span() for m in FAST_SPLIT.finditer(probe)]
                (self.alike if same else self.odd).add(c)
        return self.odd.isdisjoint(chars)

    def _library(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for start, end in in_slices(pieces):
            out += [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces[start:end], add_special_tokens=False)]
        return out

    def _merged(self, part: str) -> bytes:
        """A pre-token's ids by the library's merges alone, for it is split already."""
        ids = self.memo.get(part)
        if ids is None:
            ids = array("I", [t.id for t in self.tokenizer.model.tokenize(part.encode().decode("latin-1").translate(self.names))]).tobytes()
            if len(part) <= MEMO_CHARS:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[part] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        out: list[bytes] = []
        for piece in cut_long(text):
            if not self._splits_alike(piece):
                out += self._library([piece])
                continue
            parts = FAST_SPLIT.findall(piece)
            known = list(map(self.memo.get, parts))
            if None in known:
                for k, ids in enumerate(known):
                    if ids is None:
                        known[k] = self._merged(parts[k])
            out.append(b"".join(known))
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        return b"".join(np.uint32(self.specials[p]).astype("<u4").tobytes() if p in self.specials else self._plain(p) for p in self.special.split(text) if p)

    def decode(self, ids: bytes) -> bytes:
        """The bytes; they may begin or end within a character if the ids are a part of a text's ids."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes, text: str) -> list[tuple[int, int]]:
        """For each id, the characters of ``text`` that its bytes touch; a character split over ids is in each of them."""
        sizes = np.array([len(self.bytes_of[i]) for i in np.frombuffer(ids, "<u4").tolist()], dtype=np.int64)
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(sizes)
        return [(int(char[e - n]), int(char[e - 1]) + 1) for e, n in zip(ends, sizes, strict=True)]


def cut_long(text: str) -> Iterator[str]:
    """The text in pieces of about PIECE_CHARS, parted only where two pre-tokens always part."""
    start = 0
    while len(text) - start > PIECE_CHARS and (m := CUT.search(text, start + PIECE_CHARS)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:] if start else text


def decode_text(raw: bytes) -> str:
    """Decoded bytes as text; bytes of a character that is split at either end become U+FFFD."""
    return raw.decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def codec_from_ranks(path: str, pattern: str) -> Codec:
    return Codec(tokenizer_from_ranks(path, pattern))


@lru_cache(maxsize=4)
def codec_from_json(path: str) -> Codec:
    """With the file's added tokens found in the texts, as the library does by default."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return Codec(tokenizer, {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()})


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """doc_id, ids array<long>, and starts/ends array<int> of characters if ``offsets``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_from_ranks(ranks_path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = [codec.encode(t) for t in texts]
            columns = [batch.column(0), pa.array([np.frombuffer(i, "<u4").astype(np.int64) for i in ids], pa.list_(pa.int64()))]
            if offsets:
                spans = [codec.offsets(i, t or "") for i, t in zip(ids, texts, strict=True)]
                columns += [pa.array([[s[k] for s in each] for each in spans], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "starts", "ends"][: len(columns)])

    src = pick(docs, doc_id=id_col, text=text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, ids array<bigint>" + ", starts array<int>, ends array<int>" * offsets)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, raw binary, text string."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_from_ranks(ranks_path, pattern)
        for batch in batches:
            raw = [codec.decode(np.array(ids or [], "<u4").tobytes()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array([decode_text(r) for r in raw], pa.string())], names=["doc_id", "raw", "text"])

    src = pick(encoded, doc_id=id_col, ids=ids_col)
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, raw binary, text string")


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, decodes its ids, and returns the digests of both; ids and bytes never leave the worker."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_from_ranks(ranks_path, pattern)
        for batch in batches:
            counts, ids_sha, raw_sha = [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py())
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                raw_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
