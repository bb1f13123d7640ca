"""All pairs of strings whose likeness reaches a bound, by a filter on pairs of letters that loses none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators.matching import matching_blocks_ratio

#: Bounds under this leave short strings without a guaranteed common pair of letters.
LEAST = 0.85
#: In groups of which one side has up to so many strings, all are compared, so pairs are at most so many times the other's.
DIRECT = 4


def _grams(key: Column) -> Column:
    """The pairs of letters of a string, the second "an" of banana told from the first."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(key) - 1), lambda i: F.substr(key, i, F.lit(2)))
    return F.transform(pairs, lambda g, i: F.concat(g, F.lit("#"), F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda x: x == g)).cast("string")))


def _firsts(rows: DataFrame, counts: DataFrame, per: Sequence[str], least: float) -> DataFrame:
    """Each string with its rarest pairs of letters, as many as one of them must be common to any string like it.

    Matching blocks of M letters in all leave (la - M) + (lb - M) others, so they are at most one more than these, and each
    block of L letters has L - 1 common pairs: M - blocks = 3 M - la - lb - 1 at least, with M >= least * (la + lb) / 2.
    """
    n = F.length("key")
    shortest = F.ceil(n * least / (2 - least) - 1e-9)
    common = F.greatest(F.lit(1), F.ceil((1.5 * least - 1) * (n + shortest) - 1 - 1e-9))
    long = rows.filter(n > 1).select(*per, "key", (n - common).alias("most"), F.explode(_grams(F.col("key"))).alias("gram"))
    ordered = long.join(counts, "gram").groupBy(*per, "key").agg(F.max("most").alias("most"), F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("grams"))
    return ordered.select(*per, "key", F.inline(F.slice("grams", F.lit(1), F.greatest(F.lit(1), F.col("most")).cast("int")))).select(*per, "key", "gram")


def like_pairs(left: DataFrame, right: DataFrame, least: float = LEAST, per: Sequence[str] = ()) -> DataFrame:
    """``per``, a, b and ratio of all pairs of distinct strings (``key``) of both sides within one group that are alike by
    ``least`` or more; null and empty strings are like nothing.

    Equal strings meet by equality, others by one of their rarest pairs of letters, so a common word brings nothing together
    by itself; in groups of which a side has up to ``DIRECT`` strings all meet. Strings of groups that the other side lacks are
    left out first. ``least`` is ``LEAST`` or more.
    """
    if least < LEAST:
        raise ValueError(f"least must be {LEAST} or more")
    a, b = (side.select(*per, "key").filter("key <> ''").na.drop().distinct() for side in (left, right))
    able = lambda met: met.filter((F.col("a") != F.col("b")) & (2 * F.least(F.length("a"), F.length("b")) >= least * (F.length("a") + F.length("b")) - 1e-9)).select(*per, "a", "b")
    direct = None
    if per:
        sizes = a.groupBy(*per).agg(F.count("*").alias("n_a")).join(b.groupBy(*per).agg(F.count("*").alias("n_b")), [*per])
        sizes = sizes.select(*per, (F.least("n_a", "n_b") <= DIRECT).alias("few"))
        a, b = a.join(sizes, [*per]), b.join(sizes, [*per])
        direct = able(a.filter("few").withColumnRenamed("key", "a").join(b.filter("few").withColumnRenamed("key", "b"), [*per]))
    same = a.join(b, [*per, "key"]).select(*per, F.col("key").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("ratio"))
    if per:
        a, b = a.filter("not few"), b.filter("not few")
    counts = a.select("key").union(b.select("key")).filter(F.length("key") > 1).select(F.explode(_grams(F.col("key"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    able = able(_firsts(a, counts, per, least).withColumnRenamed("key", "a").join(_firsts(b, counts, per, least).withColumnRenamed("key", "b"), [*per, "gram"]))
    able = able if direct is None else able.union(direct)
    able = able.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b").distinct()
    # not deterministic to Spark, or it would compare pairs before their repeats are gone and before they are dealt out
    return same.union(able.withColumn("ratio", matching_blocks_ratio("a", "b", once=True)).filter(F.col("ratio") >= least).select(*per, "a", "b", "ratio"))
