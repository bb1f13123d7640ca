"""Peer state folded from events, in batch and as a stream.

A failing event blocks its user for a time to live; an event that is good lifts the block. Each event counts once: it is
known by its id, and what comes again changes nothing. State is one row a user.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FAILING, GOOD = "error", "purchase"
SCHEMA = "user_id long, n_seen long, n_failed long, last_id long, blocked boolean"


def fold(events: DataFrame) -> DataFrame:
    """The state after all events, by their ids."""
    once = events.dropDuplicates(["event_id"])
    decided = F.when(F.col("event_type").isin(FAILING, GOOD), F.struct("event_id", F.col("event_type").alias("kind")))
    per = once.groupBy("user_id").agg(F.count("*").alias("n_seen"), F.count_if(F.col("event_type") == FAILING).alias("n_failed"), F.max("event_id").alias("last_id"), F.max(decided).alias("d"))
    return per.select("user_id", "n_seen", "n_failed", "last_id", F.coalesce(F.col("d.kind") == FAILING, F.lit(False)).alias("blocked"))


def _step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    seen, failed, last, decided, blocked = state.get if state.exists else (0, 0, -1, -1, False)
    for batch in batches:
        for i, kind in sorted(set(zip(batch["event_id"].astype(int), batch["event_type"], strict=True))):
            seen, failed, last = seen + 1, failed + (kind == FAILING), max(last, i)
            if kind in (FAILING, GOOD) and i > decided:
                decided, blocked = i, kind == FAILING
    state.update((seen, failed, last, decided, blocked))
    yield pd.DataFrame({"user_id": [int(key[0])], "n_seen": [seen], "n_failed": [failed], "last_id": [last], "blocked": [blocked]})


def fold_stream(events: DataFrame) -> DataFrame:
    """A row for each user that a batch touches, with its state after the batch; repeated ids are dropped upstream."""
    return (
        events.dropDuplicates(["event_id"])
        .groupBy("user_id")
        .applyInPandasWithState(_step, SCHEMA, "seen long, failed long, last long, decided long, blocked boolean", "update", "NoTimeout")
    )


def run_stream(spark: SparkSession, sf_dir: str, name: str, checkpoint: str) -> DataFrame:
    """Fold the events files to the end of what is there now; the newest state of each user."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    table = f"{checkpoint}/{name}"

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{table}/state/epoch={epoch}")

    query = fold_stream(events).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{table}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(f"{SCHEMA}, epoch int").parquet(f"{table}/state")
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("epoch")))
    return rows.withColumn("r", newest).filter("r = 1").drop("r", "epoch")
