"""Mixing sources to target weights, in DataFrame operations only.

Sources in code point order (null last) weigh 5, 2, 1, repeating. Together they get as many words as all documents have;
no source's target exceeds 3 times its size, and what it cannot take goes to the others by weight. A document's place in
its source is a hash of its doc_id and text; the source is cut at its exact budget of words along that order, after whole
epochs. Equal rows are counted first and follow one another, so a group of copies is one row of the sums.

Prefix sums are distributed: each source is cut into key ranges of about ``RANGE`` documents, ranges are summed and their
sums accumulated (one row a range), and only within a range are documents sorted. No source is gathered.

Defined results: null or wordless text has size 0 and is taken 0 times; a null source is a source; rows that share doc_id,
or have none, have places of their own; equal rows take neighbouring places; an empty table gives an empty table; other columns are carried by ``mixed_documents`` only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import numbered
from lacuna.operators.lineage import written

WEIGHTS = (5, 2, 1)
MOST = 3
RANGE = 4_000
SEED = 20_240_917
WORD = r"[^\x20\x09-\x0D]+"


def _key(doc_id, text):
    """A 53-bit place in the order of documents."""
    return F.shiftrightunsigned(F.xxhash64(doc_id.cast("long"), text, F.lit(SEED)), 11)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and the 53-bit hash key of each document."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _key(F.col("doc_id"), F.col("text")).alias("key"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: its number, documents, size and target.

    With sources ordered by limit over weight, those that stop at their limit are a prefix: a source does if its limit is
    at most its weight's share of what the sources before it leave.
    """
    per = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("number", number)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") - 1) % len(weights) + 1).cast("double"))
    per = per.withColumn("limit", (F.col("source_size") * most).cast("double"))
    every = Window.partitionBy(F.lit(0))
    before = every.orderBy(F.col("limit") / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    left_words = F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    left_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("stops", F.col("limit") * left_weight <= left_words * F.col("weight"))
    stop = F.when(F.col("stops"), F.col("limit")).otherwise(0.0)
    free = F.when(~F.col("stops"), F.col("weight")).otherwise(0.0)
    share = (F.sum("source_size").over(every) - F.sum(stop).over(every)) * F.col("weight") / F.sum(free).over(every)
    return per.select("source", "number", "n", "source_size", F.when(F.col("stops"), F.col("limit")).otherwise(share).alias("target"))


def _mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """As ``mix``, with the documents' keys, their sources and the sources' whole epochs."""
    sized = written(sizes(docs))
    per = written(targets(sized, weights, most)).alias("p")
    equal = sized.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("copies"))
    of = equal.alias("d").join(per, F.col("d.source").eqNullSafe(F.col("p.source"))).select("doc_id", "d.source", "size", "key", "copies", "number", "n", "source_size", "target")
    of = of.withColumn("range", F.floor(F.col("key") / F.lit(float(1 << 53)) * F.ceil(F.col("n") / RANGE)).cast("long"))
    sums = of.groupBy("number", "range").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    earlier = Window.partitionBy("number").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("number", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("number", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = of.join(starts, ["number", "range"]).withColumn("before", F.col("start") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - F.col("epochs") * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before") - F.col("copy") * F.col("size")))
    each = placed.withColumn("epochs", epochs).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return each.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + cut).cast("long").alias("taken"), "key", "source", "epochs")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target and taken, the words that the mix takes of each document, repeats counted."""
    return _mix(docs, weights, most).drop("key", "source", "epochs")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The documents that the mix takes, a row for each epoch; a document that the cut divides stays whole if at least half is taken.

    Rows of one doc_id and text share the largest of their shares. Needs doc_id, source and text; all columns are returned.
    """
    found = written(_mix(docs, weights, most).select("source", "key", "size", "taken", "epochs"))
    size, key, epochs = F.col("size"), F.col("key"), F.col("epochs")
    share = F.when(size > 0, F.round(F.col("taken") / size)).otherwise(0).cast("int")
    # Keys below a source's cut are taken whole once more than keys beyond it, so a row's own key and source tell how often it
    # is taken, but at the cut itself and where sources share a key: only these are looked up, and texts stay where they are.
    cuts = written(found.groupBy("source").agg(F.max("epochs").alias("epochs"), F.min(F.when((size > 0) & (F.col("taken") < (epochs + 1) * size), key)).alias("cut")))
    by_cut = (epochs + F.when(F.col("cut").isNull() | (key < F.col("cut")), 1).otherwise(0)).cast("int")
    judged = found.drop("epochs").alias("d").join(cuts.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")))
    judged = judged.select("key", share.alias("times"), F.when(size > 0, by_cut).otherwise(0).alias("told"))
    others = judged.groupBy("key").agg(F.max("times").alias("times"), F.min("told").alias("least"), F.max("told").alias("most"))
    others = written(others.filter("times <> least or times <> most").select("key", "times"))
    rows, (doc_id, source, text), named = numbered(docs, "doc_id", "source", "text")
    wordy = F.coalesce(text.rlike(WORD), F.lit(False))
    kept = rows.withColumns({"key": _key(doc_id, text), "of": source.cast("string")}).join(cuts, F.col("of").eqNullSafe(F.col("source"))).join(others, "key", "left")
    kept = kept.withColumn("times", F.coalesce("times", F.when(wordy, by_cut).otherwise(0))).filter("times > 0")
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*named)
