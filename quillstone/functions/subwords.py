"""Tokens of a vocabulary file, as a model counts them: for chunkers that size their windows by a model's tokens.

The file lies at the same path on the driver and all executors, which load it once each. Functions take and give Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=4)
def _loaded(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@dataclass(frozen=True)
class Vocabulary:
    """``frame``: how many tokens a model's input has around the text's own."""

    path: str
    frame: int = 2

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Start and end, in characters, of each token of the text; tokens that are parts of one character share it."""
        return _loaded(self.path).encode(text, add_special_tokens=False).offsets

    def size(self, text: str) -> int:
        return len(_loaded(self.path).encode(text, add_special_tokens=False).ids) + self.frame

    def count(self, text: Column) -> Column:
        """Tokens of each text with those that frame it; null for null."""
        @F.pandas_udf("long")
        def counted(texts: pd.Series) -> pd.Series:
            return texts.map(self.size, na_action="ignore").astype("Int64")

        return counted(text)

    def within(self, text: str, limit: int) -> list[str]:
        """The text itself if a model takes it, else slices of so many tokens at most, from a token's first character to a token's last."""
        spans = self.spans(text)
        if len(spans) + self.frame <= limit or not spans:
            return [text]
        parts = (text[spans[k][0] : spans[min(k + limit, len(spans)) - 1][1]].strip() for k in range(0, len(spans), limit))
        return [p for p in parts if p]
