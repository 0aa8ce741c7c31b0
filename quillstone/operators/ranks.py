"""Ranks, running sums and order statistics within groups of any size: no group is gathered by one task.

Sums over rows in order deal a group into ``PARTS`` ranges of its order by approximate quantiles, one small aggregate. What a range's rows add up
to is known after a second small aggregate, so that windows only run within ranges; the results are exact whatever the
quantiles' error, which only decides how even the ranges are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.sources import tables

PARTS = 256


def ranged(df: DataFrame, group: str, order: str, parts: int = PARTS) -> DataFrame:
    """With part: the range that ``order``, a number or a time, falls into; equal values fall into the same. Groups may be null."""
    points = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    cuts = df.groupBy(group).agg(F.percentile_approx(order, points, 10_000).alias("cuts")).withColumnRenamed(group, "group_of_cuts")
    joined = df.join(cuts, F.col(group).eqNullSafe(F.col("group_of_cuts"))).drop("group_of_cuts")
    return joined.withColumn("part", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col(order))), F.lit(0))).drop("cuts")


def running(df: DataFrame, group: str, order: str, value: Column, name: str, ties: tuple[str, ...] = (), parts: int = PARTS) -> DataFrame:
    """With ``name``, the sum of ``value`` over the group's rows up to this one by ``order`` and then ``ties``, and ``group_total``, over all of them."""
    rows = ranged(df.withColumn("own_value", value), group, order, parts)
    sums = rows.groupBy(group, "part").agg(F.sum("own_value").alias("part_sum"))
    every = Window.partitionBy(group)
    before = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col(group).alias("group_of_part"), F.col("part").alias("part_of_sums"), F.coalesce(F.sum("part_sum").over(before), F.lit(0)).alias("base"), F.sum("part_sum").over(every).alias("group_total"))
    joined = rows.join(starts, F.col(group).eqNullSafe(F.col("group_of_part")) & (F.col("part") == F.col("part_of_sums")))
    within = Window.partitionBy(group, "part").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(name, F.sum("own_value").over(within) + F.col("base")).drop("own_value", "part", "base", "group_of_part", "part_of_sums")


def counted(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row for each group and different value: c, how many rows have it; to, how many have it or less; n, the group's rows.

    Equal values are counted first. The rest is dealt into ranges of (group, value), where a task adds up what it holds in
    order; what lies before a range in its group is a sum over ranges, of which a group has as many as its values fill.
    """
    own = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.repartitionByRange(partitions, group, value).sortWithinPartitions(group, value).withColumn("part", F.spark_partition_id())

    def upto(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(group).dictionary_encode()
            code = np.where(names.indices.is_null().to_numpy(zero_copy_only=False), -1, names.indices.fill_null(-1).to_numpy(zero_copy_only=False))
            c = batch.column("c").to_numpy()
            total = np.cumsum(c)
            starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            lengths = np.diff(np.append(starts, len(code)))
            total -= np.repeat(total[starts] - c[starts], lengths)
            first, end = batch.column(group)[0].as_py(), batch.column(group)[-1].as_py()
            if first == last:
                total[: lengths[0]] += held
            last, held = end, int(total[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total)], names=[*batch.schema.names, "upto"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    rows = tables.written(dealt.mapInArrow(upto, f"{ddl}, upto bigint"))
    sums = rows.groupBy(group, "part").agg(F.max("upto").alias("held"))
    every = Window.partitionBy(group)
    base = F.coalesce(F.sum("held").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col(group).alias("group_of_part"), F.col("part").alias("part_of_sums"), base.alias("base"), F.sum("held").over(every).alias("n"))
    joined = rows.join(starts, F.col(group).eqNullSafe(F.col("group_of_part")) & (F.col("part") == F.col("part_of_sums")))
    return joined.select(group, value, "c", (F.col("upto") + F.col("base")).alias("to"), "n")


def at_rank(value: str, rank: Column) -> Column:
    """Aggregate over ``counted``: the value of the row at this rank, from 1."""
    return F.max(F.when((F.col("to") - F.col("c") < rank) & (rank <= F.col("to")), F.col(value)))
