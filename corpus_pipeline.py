"""Raw documents to packed training sequences: five stages, each by one operator of quillstone.llm.

Each stage is written as Parquet to the folder that the cluster shares and read again by the next: a lost executor costs
tasks, not stages. A stage works on all that its predecessor kept, and returns the columns of documents; the last returns
the pieces of the packed sequences. A stage's table is deleted when the next one is written.

Defined results. Null, empty and wordless texts aren't toxic, and go with the quality rules. Rows with the same id are one
document from the n-gram join on; of copies the least id stays. Rows without an id aren't compared with any others: they stay,
and their pieces have a null id. Without labels of both kinds nothing is toxic. Extra columns travel as far as the packing. No
rows: no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import ngram_join, packing, quality_rules, secret_scan, toxicity
from quillstone.llm.common import Scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: SQL can't express the stages' fits, tests and packings; tests/llm compares them with plain Python.
ORACLE_SQL = None
CAPACITY = 2048


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.without_rejected(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.without_secrets(docs, length_col="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        written = Scratch.write(stage(spark, docs, sf_dir))
        if last:
            last.drop()
        docs, last = written.read(), written
    packed = STAGES[-1][1](spark, docs, sf_dir)  # has read all of its input when it returns
    last.drop()
    return packed
