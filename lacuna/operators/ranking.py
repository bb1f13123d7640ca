"""First, best and n-th rows under complete orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key. Spark filters ranks before the shuffle, so at most k rows a key and task move."""
    numbered = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__rank") <= k)
    return numbered.withColumnRenamed("__rank", rank) if rank else numbered.drop("__rank")


def occurrence(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "occurrence") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def running_offset(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str = "offset") -> DataFrame:
    """Sum of the values of earlier rows of the key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def bursts(df: DataFrame, key: str, ts: str, gap_s: int, least: int, tie: str) -> DataFrame:
    """Runs of events of a key whose neighbours are at most ``gap_s`` seconds apart, of ``least`` events or more."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    begins = (seconds - F.lag(seconds).over(w) > gap_s) | F.lag(seconds).over(w).isNull()
    islands = df.withColumn("island", F.sum(begins.cast("int")).over(w))
    return islands.groupBy(key, "island").agg(F.count("*").alias("n_events"), F.min(tie).alias("first_id"), F.max(tie).alias("last_id")).filter(F.col("n_events") >= least)


def first_names(df: DataFrame, key: str, name: str, k: int) -> DataFrame:
    """The first ``k`` distinct names of each key in order, and how many more there are."""
    names = df.select(key, name).distinct()
    count = names.groupBy(key).agg(F.count("*").alias("n_names"))
    first = top_rows(names, [key], [F.col(name)], k).groupBy(key).agg(F.concat_ws("|", F.array_sort(F.collect_list(name))).alias("first_names"))
    return first.join(count, key).select(key, "first_names", F.greatest(F.col("n_names") - k, F.lit(0)).alias("n_more"))
