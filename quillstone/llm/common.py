"""What the operators of this subpackage share: reading, shared scratch tables and ordered hand-over."""

from __future__ import annotations

import bisect
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only these columns, renamed: whatever else the input holds can't clash with an operator's own names."""
    ship(df.sparkSession)
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of the input for each bucket at most.
BUCKET_BYTES = 64 << 20


def buckets_for(docs: DataFrame) -> int:
    """At least as many as shuffle partitions, more where the planner knows the input to hold more bytes than they should."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(shuffle_partitions(docs.sparkSession), min(size // BUCKET_BYTES, 1 << 20) if size < 1 << 60 else 0)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; one of its own only where none is set and all tasks run in this process."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "quillstone-checkpoints"))
        configured = spark.sparkContext.getCheckpointDir()
    return configured


#: What parts words in bytes: the same that bytes.split() takes.
SPACE = re.compile(rb"[\x20\x09-\x0D]")


@dataclass
class Scratch:
    """A table written to the shared folder: it cuts the lineage and outlives any executor."""

    spark: SparkSession
    path: str

    @classmethod
    def write(cls, df: DataFrame) -> Scratch:
        spark = df.sparkSession
        path = f"{scratch_dir(spark)}/quillstone-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return cls(spark, path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        """For tables that nothing still to be computed reads."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_or_empty(column: Column) -> Column:
    """Null texts count as empty wherever a contract says so."""
    return F.coalesce(column.cast("string"), F.lit(""))


def range_starts(keys: DataFrame, key: str, partitions: int) -> list:
    """Smallest key of each of at most ``partitions`` ranges of about equal numbers of rows, ascending.

    Only the keys are shuffled, and one value a range reaches the driver.
    """
    ranged = keys.where(F.col(key).isNotNull()).repartitionByRange(partitions, key)
    starts = ranged.groupBy(F.spark_partition_id().alias("range")).agg(F.min(key).alias("start"))
    return sorted(row["start"] for row in starts.collect())


def range_of(starts: list, returns: str = "int") -> Callable[[Column], Column]:
    """Arrow function from a key to the index of its range; keys below all starts and nulls go to the first."""
    @F.pandas_udf(returns)
    def index(key: pd.Series) -> pd.Series:
        return pd.Series([max(0, bisect.bisect_right(starts, k) - 1) if k is not None and k == k else 0 for k in key], dtype="int32")

    return index


def in_slices(texts: list, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``limit`` characters, one text at least: bounds what a batch call holds."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def word_runs(raw: bytes, limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text (maximal runs without ASCII white space) in lists of about ``limit`` bytes, so that a very long one is never held in words."""
    start = 0
    while len(raw) - start > limit:
        cut = SPACE.search(raw, start + limit)
        if not cut:
            break
        yield raw[start : cut.start()].split()
        start = cut.end()
    yield raw[start:].split()
