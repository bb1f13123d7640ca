"""Named queries of peers: blocks kept as state by a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators.lineage import shared_folder
from lacuna.plans.catalogue import query, t
from lacuna.streaming import policy


@query("""WITH e AS (SELECT 'u' || user_id AS peer, ts, event_id, event_type, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events),
x AS (SELECT *, CASE WHEN event_type = 'error' AND k % 20 = 0 THEN 2 WHEN event_type = 'signup' AND k % 25 = 0 THEN 1 WHEN event_type = 'error' AND k % 10 > 2 THEN 0 END AS rank,
    event_type = 'click' AND k % 5 = 0 AS unblocks FROM e WHERE event_type = 'error' OR (event_type = 'signup' AND k % 25 = 0) OR (event_type = 'click' AND k % 5 = 0)),
u AS (SELECT peer, max(ts) AS free FROM x WHERE unblocks GROUP BY 1), n AS (SELECT max(ts) AS now FROM x),
b AS (SELECT x.peer, x.ts, rank FROM x LEFT JOIN u ON x.peer = u.peer, n WHERE rank IS NOT NULL AND (free IS NULL OR x.ts >= free) AND (rank > 0 OR epoch_us(ts) + 6 * 3600 * 1000000::BIGINT > epoch_us(now))
    QUALIFY row_number() OVER (PARTITION BY x.peer ORDER BY rank DESC, x.ts DESC, event_id DESC) = 1)
SELECT peer, CASE rank WHEN 2 THEN 'Rejected: Banned' WHEN 1 THEN 'Cancelled' ELSE 'Rejected: Too many files' END AS reason, strftime(ts, '%Y-%m-%d %H:%M:%S') AS blocked_at, rank > 0 AS lasting FROM b""")
def peer_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as peers, each event a snapshot: errors are refusals of three sorts, some signups cancellations, some clicks unblock."""
    events = t(spark, sf_dir, "events").withColumn("k", F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0)))
    rows = events.select(F.col("ts").cast("timestamp").alias("seen_at"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"), F.col("event_id").cast("string").alias("id"), "event_type", "k")
    failure = F.when(F.col("event_type") == "error", "Rejected").when((F.col("event_type") == "signup") & (F.col("k") % 25 == 0), "Cancelled")
    reason = F.when(failure == "Rejected", F.when(F.col("k") % 20 == 0, "Banned").when(F.col("k") % 10 <= 2, "File not shared.").otherwise("Too many files"))
    none = F.lit(None)
    failed = rows.select("seen_at", "user", F.lit("a.mp3").alias("path"), "id", failure.alias("failure"), none.cast("int").alias("attempts"), reason.alias("reason"), none.cast("timestamp").alias("enqueued_at"), F.col("seen_at").alias("ended_at"))
    given = rows.filter("event_type = 'click' and k % 5 = 0").select("seen_at", "user", F.lit("unblock").alias("kind"), F.lit(None).cast("string").alias("transfer_id"))
    every = policy.policy_events(failed.filter("failure is not null")).unionByName(policy.commands(given))
    folder = f"{shared_folder(every)}/blocks-{uuid.uuid4().hex}"
    every.write.parquet(f"{folder}/events")
    stored = spark.read.parquet(f"{folder}/events")
    found = policy.run_blocks(spark.readStream.schema(stored.schema).parquet(f"{folder}/events*"), folder)
    now = stored.agg(F.max("seen_at").cast("double").alias("now"))
    held = found.join(F.broadcast(now)).filter("reason is not null and (expires_at is null or expires_at > now)")
    return held.select("peer", "reason", F.date_format(F.timestamp_seconds("blocked_at"), "yyyy-MM-dd HH:mm:ss").alias("blocked_at"), F.col("expires_at").isNull().alias("lasting"))
