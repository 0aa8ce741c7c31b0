"""Telemetry analytics over samples (group, ms): percentiles by both definitions, budgets, counts, stage sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators import ranks

PERCENTILES = (50, 70, 90, 95, 99, 100)


def percentiles(df: DataFrame, group: str, value: str, points: tuple[float, ...] = PERCENTILES, linear: bool = False) -> DataFrame:
    """One row a group, columns p50 and so on, exact. Equal values are counted before the shuffle, different ones are ranked in ranges: no group is gathered.

    Rounded nearest rank: the value at rank round-half-even(p/100 * n + 0.5), within 1 and n. Linear: between neighbours.
    """
    placed = ranks.counted(df, group, value)

    def at(rank: Column) -> Column:
        return ranks.at_rank(value, rank)

    out = []
    for p in points:
        name = f"p{p:g}"
        if linear:
            place = (F.col("n") - 1) * F.lit(p / 100) + 1
            low, high = at(F.floor(place)), at(F.ceil(place))
            share = F.max(place - F.floor(place))
            out.append(F.round(low + (high - low) * share, 4).alias(name))
        else:
            rank = F.greatest(F.lit(1), F.least(F.col("n"), F.bround(F.lit(p / 100) * F.col("n") + 0.5).cast("bigint")))
            out.append(F.round(at(rank), 4).alias(name))
    return placed.groupBy(group).agg(F.max("n").alias("n"), *out)


def budget(df: DataFrame, group: str, value: str, limit: float) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value) < limit).alias("within"), F.round(100 * F.avg((F.col(value) < limit).cast("double")), 2).alias("pct"), F.round(F.avg(value), 4).alias("mean"), F.round(F.stddev_pop(value), 4).alias("stdev"))


def group_counts(df: DataFrame, group: str) -> DataFrame:
    return df.where(F.coalesce(F.col(group).cast("string"), F.lit("")) != "").groupBy(group).agg(F.count(F.lit(1)).alias("n"))


def stage_totals(df: DataFrame, request: str, stage: str, value: str, order: str) -> DataFrame:
    """v2 adds a request's repeated stages up, v1 keeps the last."""
    return df.groupBy(request, stage).agg(F.round(F.sum(value), 4).alias("total_v2"), F.round(F.max_by(value, order), 4).alias("total_v1"))


def last_n(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows, newest first."""
    return df.orderBy(F.desc(order)).limit(n)


def daily_cap(df: DataFrame, ts: str, order: str, cap: int) -> DataFrame:
    """Calendar variant: whether a request is among the first ``cap`` of its day."""
    days = df.withColumn("day", F.to_date(ts))
    return ranks.running(days, "day", ts, F.lit(1), "place", (order,)).drop("group_total").withColumn("allowed", F.col("place") <= cap)


def sessions(df: DataFrame, user: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """Session windows: start of each, number of events; combined in each task before the shuffle."""
    return df.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("session_start"), "n")
