"""Blocking, similarity and one-to-one assignment."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.components import connected_components
from lacuna.operators.lineage import written


def ascii_tokens(text: Column) -> Column:
    """Distinct lower-case runs of a-z and 0-9."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != ""))


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """token and key, once for each token of the text."""
    return df.select(key, F.explode(ascii_tokens(F.col(text))).alias("token"))


def index_sizes(df: DataFrame, key: str, text: str) -> DataFrame:
    return postings(df, key, text).groupBy("token").agg(F.count("*").alias("n_rows"))


def blocked_candidates(left: DataFrame, right: DataFrame, left_key: str, right_key: str, text: str, share: float, least: int) -> DataFrame:
    """Pairs that share ``least`` or more tokens which are rare on the right: in at most ``share`` of its rows."""
    there = postings(right, right_key, text)
    total = right.agg(F.count("*").alias("total"))
    rare = there.groupBy("token").agg(F.count("*").alias("df")).join(total, F.lit(True)).filter(F.col("df") <= F.col("total") * share).select("token")
    met = postings(left, left_key, text).join(rare, "token").join(there, "token")
    return met.groupBy(left_key, right_key).agg(F.count("*").alias("n_shared")).filter(F.col("n_shared") >= least)


def sharing_pairs(rows: DataFrame, key: str, shared: str) -> DataFrame:
    """left_key and right_key (the larger) of all rows that have a value of ``shared`` in common, each pair once.

    A pair comes from the smallest value that both have, so no table of pairs is kept to find repeats; values are dealt to as
    many tasks as a shuffle has, since few rows may make many pairs. Nulls take no part.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = rows.select(F.col(key).alias("key"), F.col(shared).alias("k")).na.drop().groupBy("key").agg(F.collect_set("k").alias("all"))
    each = known.select("key", "all", F.explode("all").alias("k")).repartition(tasks, "k")
    met = each.alias("a").join(each.alias("b"), "k").filter("a.key < b.key").filter(F.col("k") == F.array_min(F.array_intersect("a.all", "b.all")))
    return met.select(F.col("a.key").alias("left_key"), F.col("b.key").alias("right_key"))


def coverage(items: DataFrame, docs: DataFrame, item_key: str, doc_key: str, text: str, least_tokens: int, least_share: float) -> DataFrame:
    """Items most of whose tokens a document holds.

    A document that holds a share of an item's n tokens holds one of any n - share * n + 1 of them, so the item's rarest ones
    give all candidates, and common tokens are looked up for these only.
    """
    there = written(postings(docs, doc_key, text))
    tokens = postings(items, item_key, text)
    size = tokens.groupBy(item_key).agg(F.count("*").alias("n_tokens")).filter(F.col("n_tokens") >= least_tokens)
    often = there.groupBy("token").agg(F.count("*").alias("n_docs"))
    rarest = F.row_number().over(Window.partitionBy(item_key).orderBy(F.coalesce("n_docs", F.lit(0)), "token"))
    tokens = written(tokens.join(size, item_key).join(often, "token", "left").withColumn("nth", rarest))
    first = tokens.filter(F.col("nth") <= F.col("n_tokens") - F.ceil(F.col("n_tokens") * least_share - 1e-9) + 1)
    met = first.select(item_key, "token").join(there, "token").select(item_key, doc_key).distinct()
    held = met.join(tokens.select(item_key, "n_tokens", "token"), item_key).join(there, [doc_key, "token"]).groupBy(item_key, doc_key, "n_tokens").agg(F.count("*").alias("n_held"))
    return held.filter(F.col("n_held") >= F.col("n_tokens") * least_share)


def band_join(df: DataFrame, key: str, id_col: str, day: str, value: str, days: int, share: float) -> DataFrame:
    """Pairs of one key within ``days`` days and a share of the value: day bins make it an equi-join with a residual band."""
    seconds = F.unix_seconds(F.col(day).cast("timestamp"))
    rows = df.select(F.col(key).alias("k"), F.col(id_col).alias("id"), F.floor(seconds / 86400).alias("d"), F.col(value).alias("v"))
    left = rows.withColumn("bin", F.floor(F.col("d") / (days + 1)))
    right = rows.select("k", F.col("id").alias("id2"), F.col("d").alias("d2"), F.col("v").alias("v2"), F.explode(F.array(F.floor(F.col("d") / (days + 1)) - 1, F.floor(F.col("d") / (days + 1)), F.floor(F.col("d") / (days + 1)) + 1)).alias("bin"))
    near = left.join(right, ["k", "bin"]).filter((F.col("id") < F.col("id2")) & (F.abs(F.col("d") - F.col("d2")) <= days) & (F.abs(F.col("v") - F.col("v2")) <= share * F.greatest("v", "v2")))
    return near.select(F.col("k").alias(key), F.col("id").alias("left_id"), F.col("id2").alias("right_id"))


def matching_blocks_ratio(a: str, b: str, once: bool = False) -> Column:
    """Twice the matched characters over all characters, by longest matching blocks; the order of the two counts. With ``once``
    it is made where it stands and nowhere else: Spark moves no filter on it to below a shuffle or a distinct."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")

    ratio = F.pandas_udf(run, "double")
    return (ratio.asNondeterministic() if once else ratio)(a, b)


def _in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The offers that are taken while both ends are free; offers come part after part, each part in order."""
    used_a, used_b, now = set(), set(), None
    for batch in batches:
        taken = []
        for part, a, b in zip(*(batch.column(c).to_pylist() for c in ("part", "a", "b")), strict=True):
            if part != now:
                used_a, used_b, now = set(), set(), part
            free = a not in used_a and b not in used_b
            if free:
                used_a.add(a)
                used_b.add(b)
            taken.append(free)
        yield batch.filter(pa.array(taken, pa.bool_())).drop_columns(["part", "a", "b"])


def greedy_assignment(offers: DataFrame, left: str, right: str, score: str, most: int = 2_000_000, within: str | None = None) -> DataFrame:
    """One-to-one pairs as if offers were taken by falling score (ties by left, then right) while both ends are free.

    A round takes all offers that are the best of both their ends, which is what the sequence would do, and drops the offers of
    taken ends. One round leaves little where most ends have one offer. Of what is left, offers that share no end, directly or
    through others, don't touch each other, so connected parts are settled apart: those of up to ``most`` offers by one pass
    of a task over each, which holds the ends that are taken and no offers. Larger ones go in rounds; each takes some, so it
    ends. Null ends take no part.

    Ends may be numbers ``within`` a column that both ends of an offer share; offers are then dealt once a round, by this
    column, and it comes before the ends in what is returned. Tables are written by column.
    """
    group = [within] if within else []
    order, per = [F.desc("worth"), F.col("one"), F.col("two")], ["within"] if within else []
    given = offers.select(*[F.col(c).alias("within") for c in group], F.col(left).alias("one"), F.col(right).alias("two"), F.col(score).alias("worth"))
    given = given.filter(" and ".join(f"{c} is not null" for c in [*per, "one", "two"]))
    first = lambda end: F.row_number().over(Window.partitionBy(*per, end).orderBy(*order))
    gone = lambda end: F.max("best").over(Window.partitionBy(*per, end))
    taken = None

    def settle_round(rows: DataFrame) -> DataFrame:
        nonlocal taken
        marked = rows.withColumn("nth", first("one")).withColumn("best", (first("two") == 1) & (F.col("nth") == 1)).drop("nth")
        if not within:
            best = written(marked.filter("best").select("one", "two", "worth"))
            taken = best if taken is None else taken.union(best)
            return written(rows.join(best.select("one"), "one", "left_anti").join(best.select("two"), "two", "left_anti").select("one", "two", "worth"))
        marked = written(marked.withColumn("open", ~gone("two")).withColumn("open", F.col("open") & ~gone("one")).filter("best or open"))
        best = marked.filter("best").select(*per, "one", "two", "worth")
        taken = best if taken is None else taken.union(best)
        return marked.filter("open").select(*per, "one", "two", "worth")

    dealt = (given.repartition("within") if within else given).groupBy(*per, "one", "two").agg(F.max("worth").alias("worth"))
    open_ = settle_round(dealt if within else written(dealt))
    named = [*group, left, right, score]
    if open_.isEmpty():
        return taken.toDF(*named)
    open_ = written(open_.withColumn("a", F.xxhash64(F.lit("left"), *per, "one")).withColumn("b", F.xxhash64(F.lit("right"), *per, "two")))
    parts = connected_components(open_.select("a", "b")).select(F.col("node").alias("a"), F.col("component").alias("part"))
    open_ = written(open_.join(parts, "a"))
    large = open_.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("part")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in taken.schema.fields)
    small = open_.join(large, "part", "left_anti").select("part", "a", "b", *per, "one", "two", "worth").repartition(int(offers.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")
    taken = taken.union(small.sortWithinPartitions("part", *order).mapInArrow(_in_order, kinds))
    open_ = written(open_.join(large, "part", "left_semi").select(*per, "one", "two", "worth"))
    while not open_.isEmpty():
        open_ = settle_round(open_.repartition("within") if within else open_)
    return taken.toDF(*named)
