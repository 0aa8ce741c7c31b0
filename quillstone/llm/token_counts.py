"""Token counts with a whole-token shortcut.

Before any text is read, each vocabulary string that ends a word is put through the merges alone; those that come out as
one token form the shortcut. Counting a text then needs a set look-up for a pre-token of the shortcut, and merges only
for the rest, whose counts are kept in a bounded memo. Splitting is checked against the library character by character;
a text with a character on which they differ is counted by the library.

Defined results. Null text: empty, no bytes, no tokens. Repeated rows: one result each. Texts are counted whole, whatever
their length. Special strings in a text count as the library counts them by default. Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.byte_bpe import byte_alphabet, cut_long
from quillstone.llm.common import pick

#: The vocabulary's words, in the syntax of the standard library; like the library's but for rare characters, which are found out.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
END = "</w>"
MEMO = 400_000
MEMO_CHARS = 64


def normal(text: str) -> str:
    """NFC and lower case a character at a time, so without the final sigma."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Counter:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.name = {b: c for b, c in byte_alphabet().items()}
        self.specials = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.whole = self._proven()
        self.memo: dict[str, int] = {}
        self.alike, self.odd = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .,"), set()

    def _merged(self, word: str) -> int:
        return len(self.tokenizer.model.tokenize("".join(self.name[b] for b in word.encode())))

    def _proven(self) -> set[str]:
        back = {c: b for b, c in self.name.items()}
        found = set()
        for token in self.tokenizer.get_vocab():
            body = token.removesuffix(END)
            if token.endswith(END) and all(c in back for c in body):
                try:
                    word = bytes(back[c] for c in body).decode()
                except UnicodeDecodeError:
                    continue
                if word and self._merged(word) == 1:
                    found.add(word)
        return found

    def _splits_alike(self, text: str) -> bool:
        chars = set(text)
        for c in chars - self.alike:
            if c not in self.odd:
                probe = f"a{c}a 1{c}1 !{c}! {c} {c}{c} _{c}"
                library = [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(probe))]
                own = ["".join(self.name[b] for b in w.encode()) for w in WORDS.findall(normal(probe))]
                (self.alike if library == own else self.odd).add(c)
        return self.odd.isdisjoint(chars)

    def _plain(self, text: str) -> int:
        n = 0
        for piece in cut_long(text):
            if not self._splits_alike(piece):
                n += len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
                continue
            words = WORDS.findall(normal(piece))
            whole, memo = self.whole, self.memo
            rest = [w for w in words if w not in whole]
            n += len(words) - len(rest)
            for w in rest:
                k = memo.get(w)
                if k is None:
                    k = self._merged(w)
                    if len(w) <= MEMO_CHARS:
                        if len(memo) >= MEMO:
                            memo.clear()
                        memo[w] = k
                n += k
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        return sum(1 if p in self.specials else self._plain(p) for p in self.special.split(text) if p)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for every row; a map over the scan, nothing is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            tokens = [count(t.as_py()) for t in batch.column(1)]
            size = pc.fill_null(pc.cast(pc.binary_length(batch.column(1)), pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    src = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")
