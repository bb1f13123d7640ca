"""What is expected and not held."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_numbers(held: DataFrame, key: str, number: str) -> DataFrame:
    """Numbers from 1 to each key's largest that the key does not hold."""
    top = held.groupBy(key).agg(F.max(number).alias("top")).filter("top >= 1")
    expected = top.select(key, F.explode(F.sequence(F.lit(1), F.col("top").cast("int"))).alias(number))
    return expected.join(held.select(key, F.col(number).cast("int").alias(number)), [key, number], "left_anti")


def completion(held: DataFrame, key: str, number: str) -> DataFrame:
    """Held, expected and missing numbers of each key, and whether it is complete, partial or absent."""
    per = held.groupBy(key).agg(F.countDistinct(F.when(F.col(number) >= 1, F.col(number))).alias("held"), F.max(number).cast("long").alias("expected"))
    missing = F.greatest(F.col("expected") - F.col("held"), F.lit(0))
    status = F.when(F.col("held") >= F.col("expected"), "complete").when(F.col("held") > 0, "partial").otherwise("missing")
    return per.select(key, "held", "expected", missing.alias("missing"), (F.col("held") * 100 / F.col("expected")).alias("percent"), status.alias("status"))


def reconciled(expected: DataFrame, held: DataFrame, on: str) -> DataFrame:
    """Every key with its status: found on both sides, missing where only expected, extra where only held."""
    left = expected.select(on).distinct().withColumn("is_expected", F.lit(True))
    right = held.select(on).distinct().withColumn("is_held", F.lit(True))
    status: Column = F.when(F.col("is_expected") & F.col("is_held"), "found").when(F.col("is_expected"), "missing").otherwise("extra")
    return left.join(right, on, "full_outer").select(on, status.alias("status"))
