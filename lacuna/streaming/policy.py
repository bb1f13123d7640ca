"""Which peers are blocked, kept as state a peer over snapshots of their transfers.

A refusal for good and a cancellation by hand block a peer until it is unblocked; other refusals block it for a while; what
concerns one file only, cancellations of our own and cancellations in bulk block nobody. Each failure counts once, by its
signature, however often snapshots repeat it. What a failure is gets decided by columns before the state; the state merges
blocks by rank and lets timers end them and forget signatures, so it doesn't grow for ever.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lacuna.sources.documents import source_user

COOLDOWN_S = 6 * 3600.0
#: Signatures are forgotten so long after a snapshot last held them; an older record that comes again would count anew.
KEEP_S = 90 * 86400.0
#: So many cancellations that ended within a second of the next one are no judgment of a peer.
BULK, BULK_GAP_S = 3, 1.0
#: Span of time that one task looks at for bulk cancellations.
SPAN_S = 600

# Texts of refusals that last, and of those that concern one file.
LASTING = r"(?i)\bbanned\b|verification required|blocked country"
FILE_ONLY = r"(?i)not shared|file read error|remote file error|disallowed extension|does not match expected size|size mismatch"
STORED = r"(?s)^\s*(Rejected|Aborted|Cancelled|TimedOut|Errored|Failed)\b(?:\s*\(retries:\s*\d+\))?\s*(?::\s*(.*))?$"

BLOCK = "reason string, blocked_at double, expires_at double, transfer_id string"


def peer_key(user: Column) -> Column:
    return F.lower(source_user(user))


def outcome(failure: Column, reason: Column) -> Column:
    """'block', 'cooldown' or 'file' for a failure; null where it says nothing of the peer."""
    text = F.trim(F.regexp_replace(F.coalesce(reason, F.lit("")), r"\s+", " "))
    refused = F.when(text.rlike(LASTING), "block").when(text.rlike(FILE_ONLY), "file").otherwise("cooldown")
    return F.when(failure == "Cancelled", "block").when(failure == "Aborted", "file").when(failure == "Rejected", refused)


def stored_outcome(reason: Column) -> Column:
    """The same from a stored reason; one of another form may be a deliberate block and is kept."""
    known = F.regexp_extract(reason, STORED, 1)
    return F.when(F.coalesce(known, F.lit("")) == "", "block").otherwise(outcome(known, F.regexp_extract(reason, STORED, 2)))


def description(failure: Column, attempts: Column, reason: Column) -> Column:
    text = F.substring(F.trim(F.regexp_replace(F.coalesce(reason, F.lit("")), r"\s+", " ")), 1, 240)
    tried = F.when(attempts > 0, F.concat(F.lit(" (retries: "), attempts.cast("string"), F.lit(")"))).otherwise("")
    return F.concat(failure, tried, F.when(text != "", F.concat(F.lit(": "), text)).otherwise(""))


def in_bulk(cancelled: DataFrame, *snapshot: str) -> DataFrame:
    """The rows with ``bulk``: whether ``ended`` (seconds) stands in a row of ``BULK`` or more with gaps of ``BULK_GAP_S`` at most.

    Two neighbours on either side decide it, so rows are looked at by spans of time, each with what lies just beside it, and
    no snapshot is sorted as a whole. Rows without ``ended`` are not in bulk.
    """
    reach = (BULK - 1) * BULK_GAP_S
    home = F.floor(F.col("ended") / SPAN_S)
    spans = F.array_distinct(F.array(home, F.floor((F.col("ended") - reach) / SPAN_S), F.floor((F.col("ended") + reach) / SPAN_S)))
    rows = cancelled.filter("ended is not null").withColumn("home", home).withColumn("span", F.explode(spans))
    w = Window.partitionBy(*snapshot, "span").orderBy("ended")
    close = lambda a, b: F.coalesce(b - a <= BULK_GAP_S, F.lit(False))
    at = [F.lag("ended", k).over(w) if k > 0 else F.lead("ended", -k).over(w) if k else F.col("ended") for k in range(BULK - 1, -BULK, -1)]
    steps = [close(a, b) for a, b in zip(at, at[1:], strict=False)]
    runs = [steps[i : i + BULK - 1] for i in range(len(steps) - BULK + 2)]
    bulk = F.lit(False)
    for run in runs:
        whole = F.lit(True)
        for step in run:
            whole = whole & step
        bulk = bulk | whole
    found = rows.withColumn("bulk", bulk).filter("span = home").drop("span", "home")
    return found.unionByName(cancelled.filter("ended is null").withColumn("bulk", F.lit(False)))


def policy_events(transfers: DataFrame) -> DataFrame:
    """What the state needs of each failure in snapshots of transfers (seen_at, user, path, id, failure, attempts, reason,
    enqueued_at, ended_at; times as timestamps): whom it concerns, its signature, outcome and whether something excuses it.

    A path that also has a transfer without failure in the same snapshot is protected. Rows without user or path take no part.
    """
    rows = transfers.select("seen_at", peer_key(F.col("user")).alias("peer"), F.regexp_replace("path", r"\\", "/").alias("path"), "id", "failure", "attempts", "reason", "enqueued_at", "ended_at")
    rows = rows.filter("peer <> '' and path <> ''")
    healthy = rows.filter("failure is null").select("seen_at", "peer", "path").distinct().withColumn("protected", F.lit(True))
    failed = rows.filter("failure in ('Rejected', 'Aborted', 'Cancelled')").withColumn("ended", F.col("ended_at").cast("double"))
    cancelled = in_bulk(failed.filter("failure = 'Cancelled'"), "seen_at")
    every = cancelled.unionByName(failed.filter("failure <> 'Cancelled'").withColumn("bulk", F.lit(False))).join(healthy, ["seen_at", "peer", "path"], "left")
    signature = F.sha2(F.to_json(F.struct("id", "path", "failure", "attempts", "reason", "enqueued_at", "ended_at")), 256)
    return every.select(
        "seen_at", "peer", F.lit("failure").alias("kind"), F.coalesce("id", F.lit("")).alias("transfer_id"), signature.alias("signature"), (F.col("failure") == "Cancelled").alias("cancelled"),
        F.coalesce(outcome(F.col("failure"), F.col("reason")), F.lit("ignored")).alias("outcome"), description(F.col("failure"), F.col("attempts"), F.col("reason")).alias("reason"),
        "ended", F.coalesce("protected", F.lit(False)).alias("protected"), "bulk",
    )


def commands(given: DataFrame) -> DataFrame:
    """Commands (seen_at, user, kind: internal, forget or unblock, transfer_id) as events."""
    no, none = F.lit(False), F.lit(None).cast("string")
    return given.select(
        "seen_at", peer_key(F.col("user")).alias("peer"), "kind", F.coalesce("transfer_id", F.lit("")).alias("transfer_id"), F.lit("").alias("signature"), no.alias("cancelled"),
        none.alias("outcome"), none.alias("reason"), F.lit(None).cast("double").alias("ended"), no.alias("protected"), no.alias("bulk"),
    )


def reclassified(blocks: DataFrame, now: Column) -> DataFrame:
    """Stored blocks (peer, reason, blocked_at, expires_at, transfer_id) under the present rules at ``now`` (seconds)."""
    kind, end = stored_outcome(F.col("reason")), F.col("blocked_at") + COOLDOWN_S
    kept = blocks.withColumn("kind", kind).filter((F.col("kind") == "block") | ((F.col("kind") == "cooldown") & (end > now)))
    return kept.withColumn("expires_at", F.when(F.col("kind") == "cooldown", end)).select("peer", "reason", "blocked_at", "expires_at", "transfer_id")


def _rank(block: tuple) -> int:
    reason, _, expires_at, _ = block
    return 0 if expires_at is not None else 1 if reason.startswith("Cancelled") else 2


def merged(old: tuple | None, new: tuple) -> tuple:
    """The block that holds: a lasting refusal before a cancellation, both before a cooldown; of equals the later one, of
    cooldowns the one that ends last."""
    if old is None or _rank(new) > _rank(old):
        return new
    return new if _rank(new) == _rank(old) and (_rank(new) or new[2] > old[2]) else old


class PeerBlocks(StatefulProcessor):
    """One peer: its block, the signatures that have counted, and cancellations announced as our own.

    The block is read from the state once and written once for all events of a batch, however many snapshots they are."""

    def __init__(self, cooldown_s: float = COOLDOWN_S, keep_s: float = KEEP_S):
        self.cooldown_s, self.keep_s = cooldown_s, keep_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.block = handle.getValueState("block", BLOCK)
        self.seen = handle.getMapState("seen", "signature string", "outcome string, at double")
        self.own = handle.getMapState("own", "transfer_id string", "at double")

    def _load(self) -> tuple | None:
        self.held = self.kept = tuple(self.block.get()) if self.block.exists() else None
        return self.held

    def _held(self) -> tuple | None:
        return self.held

    def _put(self, block: tuple | None) -> None:
        self.held = block

    def _store(self) -> None:
        if self.held == self.kept:
            return
        if self.held is None:
            self.block.clear()
            return
        self.block.update(self.held)
        if self.held[2] is not None:
            self.handle.registerTimer(int(self.held[2] * 1000))

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        self.held, self.kept = tuple(initialState[c] for c in ("reason", "blocked_at", "expires_at", "transfer_id")), None
        self._store()

    def _judged(self, e: Row, now: float) -> str:
        """What a failure that has not counted yet comes to; blocks where it does."""
        if e.cancelled and self.own.containsKey((e.transfer_id,)):
            self.own.removeKey((e.transfer_id,))
            return "internal"
        if e.protected or e.bulk:
            return "protected" if e.protected else "bulk"
        if e.outcome == "block":
            self._put(merged(self._held(), (e.reason, now if e.ended is None else e.ended, None, e.transfer_id)))
        elif e.outcome == "cooldown":
            start = now if e.ended is None else min(e.ended, now)
            if start + self.cooldown_s > now:
                self._put(merged(self._held(), (e.reason, start, start + self.cooldown_s, e.transfer_id)))
        return e.outcome

    def _snapshot(self, now: float, events: list[Row]) -> None:
        held = self._held()
        if held and held[2] is not None and held[2] <= now:
            self._put(None)
        for e in events:
            if e.kind == "internal":
                self.own.updateValue((e.transfer_id,), (now,))
            elif e.kind == "forget":
                self.own.removeKey((e.transfer_id,))
            elif e.kind == "unblock":
                self._put(None)
            else:
                known = self.seen.getValue((e.signature,)) if self.seen.containsKey((e.signature,)) else None
                self.seen.updateValue((e.signature,), (known[0] if known else self._judged(e, now), now))
        # a cancellation that proves to be one of many lifts the block that it made when it was seen alone
        held = self._held()
        if held and _rank(held) == 1 and any(e.kind == "failure" and e.bulk and (e.transfer_id == held[3] if held[3] else e.reason == held[0]) for e in events):
            self._put(None)

    def _row(self, key: tuple, at: float) -> Row:
        return Row(peer=key[0], at=at, **dict(zip(("reason", "blocked_at", "expires_at", "transfer_id"), self._held() or [None] * 4, strict=True)))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before, at = self._load(), 0.0
        order = {"internal": 0, "forget": 1, "unblock": 2, "failure": 3}
        events = sorted(rows, key=lambda e: (e.seen_at, order[e.kind], e.ended or 0.0, e.signature, e.transfer_id))
        for seen_at, group in groupby(events, key=lambda e: e.seen_at):
            at = seen_at.timestamp()
            self._snapshot(at, list(group))
        self._store()
        self.handle.registerTimer(int((at + self.keep_s) * 1000))
        if self._held() != before:
            yield self._row(key, at)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        for state, age in ((self.seen, lambda v: v[1]), (self.own, lambda v: v[0])):
            for k, v in list(state.iterator()):
                if age(v) + self.keep_s <= now:
                    state.removeKey(k)
        held = self._load()
        if held and held[2] is not None and held[2] <= now:
            self._put(None)
            self._store()
            yield self._row(key, now)


def blocks_stream(events: DataFrame, initial: DataFrame | None = None, cooldown_s: float = COOLDOWN_S, keep_s: float = KEEP_S, delay: str = "0 seconds") -> DataFrame:
    """A row (peer, at, reason, blocked_at, expires_at, transfer_id) for each peer whose block a batch or a timer changed; without
    reason it is free. All events of a snapshot have its seen_at and come in one batch; batches may hold many snapshots.
    Needs the RocksDB state store."""
    keyed = events.withWatermark("seen_at", delay).groupBy("peer")
    start = initial.groupBy("peer") if initial is not None else None
    return keyed.transformWithState(PeerBlocks(cooldown_s, keep_s), f"peer string, at double, {BLOCK}", "Update", "EventTime", initialState=start)


def run_blocks(events: DataFrame, folder: str, **how) -> DataFrame:
    """Runs a stream of events to the end of what is there; the newest row of each peer, blocked or free."""

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/epoch={epoch}")

    spark = events.sparkSession
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = blocks_stream(events, **how).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
        stream.awaitTermination()
    finally:
        spark.conf.set(store, before) if before else spark.conf.unset(store)
    rows = spark.read.schema(f"peer string, at double, {BLOCK}, epoch int").parquet(f"{folder}/changes")
    newest = rows.groupBy("peer").agg(F.max_by(F.struct("at", "reason", "blocked_at", "expires_at", "transfer_id"), F.struct("epoch", "at")).alias("x"))
    return newest.select("peer", "x.*")


def active(blocks: DataFrame, now: Column) -> DataFrame:
    """The blocks that hold at ``now`` (seconds)."""
    return blocks.filter(F.col("reason").isNotNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
