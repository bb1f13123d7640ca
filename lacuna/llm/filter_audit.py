"""Audit of five filters in all 120 orders: what each removes, what it removes alone, and what good text it costs.

A document's failures are five flags (A to E). Documents are counted by part and flags, and SQL's CUBE over the flags and
the part sums these counts up for every subset of the flags: the row of a subset in which all its flags are false counts
the documents that survive all filters of the subset. Step i of an order then joins two such subsets, the filters before
the step and those after it; their difference is what the step removes. No document is read once for each order.

E (a copy of a document with a smaller doc_id) is judged on counts of equal (text, part, labels), so a group of copies moves
as one row a part and a task, however large it is. Equality of texts is that of their SHA-256.

Defined results: null text counts as empty (it fails A, and E if a smaller doc_id is empty too), null source as the part '',
which it shares with an empty source; rows that share the smallest doc_id of a text all pass E; a row without doc_id passes
E, makes no other row fail it and has no labels; a doc_id with several labels counts once, as good or toxic if one of them
says so; an empty table gives no rows; other columns, however named, are not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.lineage import written

FILTERS = "ABCDE"
EVERY = (1 << len(FILTERS)) - 1


def flags(docs: DataFrame) -> DataFrame:
    """doc_id, part, a digest of the text, and whether it fails A, B, C and D."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        text.alias("text"), F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
    )
    return rows.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
        (F.size("words") < 200).alias("A"),
        (100 * F.size(F.array_distinct("words")) < 50 * F.size("words")).alias("B"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 2 * F.length("text").cast("long")).alias("C"),
        F.col("text").rlike(r"[#$%&*|]").alias("D"),
    )


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with good and toxic; those without doc_id take no part in the join."""
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality"), says("toxic")).withColumnRenamed("quality", "good")
    no = F.lit(False)
    found = rows.filter("doc_id is not null").join(known, "doc_id", "left").withColumns({c: F.coalesce(F.col(c), no) for c in ("good", "toxic")})
    return found.unionByName(rows.filter("doc_id is null").withColumns({"good": no, "toxic": no}))


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, the five flags, and how many documents have them: n, of these good and toxic."""
    rows = _labelled(written(flags(docs)), labels)
    cell = ["digest", "part", "A", "B", "C", "D", "good", "toxic"]
    each = rows.groupBy(*cell, "doc_id").agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    cells = each.groupBy(*cell).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnumbered"), first)
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    passing = F.col("unnumbered") + F.when(F.col("first.doc_id") == smallest, F.col("first.n")).otherwise(0)
    halves = F.array(F.struct(F.lit(False).alias("E"), F.col("passing").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("passing")).alias("n")))
    both = cells.withColumn("passing", passing).select("part", *cell[2:], F.inline(halves)).filter("n > 0")
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return both.groupBy("part", *FILTERS).agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def survivors(counted: DataFrame) -> DataFrame:
    """part, subset (bit i for filter i) and the documents that pass all filters of the subset, for all 32 subsets."""
    cube = counted.cube(*FILTERS, "part").agg(
        *(F.grouping(f).alias(f"out_{f}") for f in (*FILTERS, "part")), *(F.sum(c).alias(c) for c in ("n", "good", "toxic"))
    )
    alive = cube.filter("out_part = 0")
    for f in FILTERS:
        alive = alive.filter((F.col(f"out_{f}") == 1) | ~F.col(f))
    subset = sum(((1 - F.col(f"out_{f}").cast("int")) * (1 << i) for i, f in enumerate(FILTERS)), F.lit(0))
    found = alive.select("part", subset.alias("subset"), "n", "good", "toxic")
    whole = found.filter("subset = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit(EVERY))).alias("subset"))
    return whole.join(found, ["part", "subset"], "left").na.fill(0, ["n", "good", "toxic"])


def _steps(spark) -> DataFrame:
    """filter_order, step, its filter, and the subsets before and after it: 600 rows."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << FILTERS.index(f)
            rows.append(("".join(order), step, f, before, after))
            before = after
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, before int, after int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and its figures, for each part, order and step."""
    alive = written(survivors(patterns(docs, labels)))
    named = lambda side: alive.select("part", *(F.col(c).alias(f"{side}_{c}") for c in ("subset", "n", "good", "toxic")))
    steps = F.broadcast(_steps(docs.sparkSession))
    pairs = named("b").join(steps, F.col("b_subset") == F.col("before"))
    pairs = pairs.join(named("a").withColumnsRenamed({"part": "a_part"}), (F.col("part") == F.col("a_part")) & (F.col("after") == F.col("a_subset")))
    removed = F.col("b_n") - F.col("a_n")
    of_filter = Window.partitionBy("part", "filter")
    # the step that is first in its order removes all that fails the filter; the one that is last removes what fails it only
    fails = F.max(F.when(F.col("step") == 1, removed)).over(of_filter)
    alone = F.max(F.when(F.col("step") == len(FILTERS), removed)).over(of_filter)
    return pairs.select(
        "part", "filter_order", "step", F.col("a_n").alias("kept"), removed.alias("removed"), (fails - removed).alias("redundant"),
        alone.alias("unique_fails"), (F.col("b_good") - F.col("a_good")).alias("good_lost"),
        (F.col("b_toxic") - F.col("a_toxic")).alias("toxic_lost"), F.sum(removed).over(of_filter).alias("shapley"),
    )
