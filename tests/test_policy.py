"""Peer policy as a stream against a plain fold over snapshots."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lacuna.streaming import policy

START = datetime(2024, 5, 1, tzinfo=timezone.utc)
TRANSFER = "seen_at timestamp, user string, path string, id string, failure string, attempts int, reason string, enqueued_at timestamp, ended_at timestamp"
COMMAND = "seen_at timestamp, user string, kind string, transfer_id string"
REASONS = ["Banned", "Too many files", None, "File not shared.", "Overwhelmed, try again later"]


def made(rng, snapshots):
    """Snapshots in which records come again, some in bulk, some beside a healthy copy; and commands between them."""
    transfers, commands, records = [], [], []
    for k in range(snapshots):
        now = START + timedelta(hours=2 * k)
        for _ in range(rng.randrange(4)):
            ended = now - timedelta(seconds=rng.choice([30, 500, 30_000]) + 10 * len(records))
            failure = rng.choice(["Rejected", "Rejected", "Cancelled", "Aborted", "TimedOut"])
            records.append((rng.choice(["Ann", "bob (slow)", "Cy", "dee"]), f"a\\{rng.randrange(6)}.mp3", f"t{len(records)}", failure, rng.choice([None, 1]), rng.choice(REASONS), None, ended))
        if rng.random() < 0.3:
            base = now - timedelta(seconds=5)
            records += [(rng.choice(["Ann", "Cy", "dee"]), f"b/{i}.mp3", f"t{len(records) + i}", "Cancelled", None, None, None, base + timedelta(seconds=0.7 * i)) for i in range(rng.randint(2, 4))]
        seen = rng.sample(records, rng.randint(0, len(records)))
        transfers += [(now, *r) for r in seen]
        transfers += [(now, r[0], r[1], "ok", None, None, None, None, None) for r in seen if rng.random() < 0.1]
        for kind in ("internal", "forget", "unblock"):
            if rng.random() < 0.25 and records:
                r = rng.choice(records)
                commands.append((now, r[0], kind, r[2]))
    return transfers, commands


def kind_of(failure, reason):
    text = (reason or "").lower()
    if failure == "Rejected":
        return "block" if "banned" in text else "file" if "not shared" in text else "cooldown"
    return {"Cancelled": "block", "Aborted": "file"}[failure]


def plain(transfers, commands, initial=()):
    key = lambda u: u.split(" (")[0].lower()
    blocks, seen, own = {p: list(b) for p, *b in initial}, set(), set()
    for now in sorted({r[0] for r in transfers} | {c[0] for c in commands}):
        t = now.timestamp()
        mine = [r for r in transfers if r[0] == now]
        for _, user, kind, tid in sorted((c for c in commands if c[0] == now), key=lambda c: ["internal", "forget", "unblock"].index(c[2])):
            if kind == "unblock":
                blocks.pop(key(user), None)
            elif kind == "internal":
                own.add((key(user), tid))
            else:
                own.discard((key(user), tid))
        blocks = {p: b for p, b in blocks.items() if b[2] is None or b[2] > t}
        healthy = {(key(r[1]), r[2].replace("\\", "/")) for r in mine if r[4] is None}
        times = sorted(r[8].timestamp() for r in mine if r[4] == "Cancelled")
        bulk = {x for i in range(len(times) - 2) if times[i + 1] - times[i] <= 1 and times[i + 2] - times[i + 1] <= 1 for x in times[i : i + 3]}
        lifted = []
        for r in sorted((r for r in mine if r[4] in ("Rejected", "Aborted", "Cancelled")), key=lambda r: r[8]):
            _, user, path, tid, failure, attempts, reason, _, ended = r
            p, told = key(user), failure + (f" (retries: {attempts})" if attempts else "") + (f": {reason}" if reason else "")
            many = failure == "Cancelled" and ended.timestamp() in bulk
            if many:
                lifted.append((p, tid))
            if (p, r[2:]) in seen:
                continue
            seen.add((p, r[2:]))
            if failure == "Cancelled" and (p, tid) in own:
                own.discard((p, tid))
            elif (p, path.replace("\\", "/")) in healthy or many:
                pass
            elif (kind := kind_of(failure, reason)) == "block":
                old = blocks.get(p)
                if not (old and old[2] is None and not old[0].startswith("Cancelled") and failure == "Cancelled"):
                    blocks[p] = [told, ended.timestamp(), None, tid]
            elif kind == "cooldown" and (end := min(ended.timestamp(), t) + policy.COOLDOWN_S) > t:
                old = blocks.get(p)
                if old is None or (old[2] is not None and old[2] < end):
                    blocks[p] = [told, end - policy.COOLDOWN_S, end, tid]
        for p, tid in lifted:
            if p in blocks and blocks[p][2] is None and blocks[p][0].startswith("Cancelled") and blocks[p][3] == tid:
                del blocks[p]
    return {p: tuple(b) for p, b in blocks.items()}


def written_snapshots(spark, tmp, transfers, commands):
    events = policy.policy_events(spark.createDataFrame(transfers, TRANSFER)).unionByName(policy.commands(spark.createDataFrame(commands, COMMAND))).cache()
    for k, (now,) in enumerate(sorted(events.select("seen_at").distinct().collect())):
        events.filter(F.col("seen_at") == F.lit(now)).coalesce(1).write.parquet(f"{tmp}/in/{k:03}")
    return events.schema


def run(spark, tmp, schema, files, **how):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{tmp}/in/*")
    return policy.run_blocks(stream, f"{tmp}/run-{files}-{len(how)}", **how)


@pytest.mark.parametrize("seed", range(3))
def test_any_split_into_batches_gives_the_fold(spark, tmp_path, seed):
    transfers, commands = made(random.Random(seed), 14)
    schema, want = written_snapshots(spark, tmp_path, transfers, commands), plain(transfers, commands)
    end = max(r[0] for r in [*transfers, *commands]).timestamp()
    for files in (1, 4, 100):
        got = policy.active(run(spark, tmp_path, schema, files), F.lit(end)).collect()
        near = lambda v: None if v is None else round(v, 3)
        assert {r.peer: (r.reason, near(r.blocked_at), near(r.expires_at), r.transfer_id) for r in got} == {p: (b[0], near(b[1]), near(b[2]), b[3]) for p, b in want.items() if b[2] is None or b[2] > end}
    assert want


def test_state_shrinks_when_signatures_and_cooldowns_expire(spark, tmp_path):
    ended = START - timedelta(seconds=9)
    transfers = [(START, f"peer{i}", "a.mp3", f"t{i}", "Rejected", None, "Too many files", None, ended) for i in range(20)]
    transfers += [(START + timedelta(days=d), "late", "b.mp3", f"late{d}", "Aborted", None, None, None, ended) for d in (1, 2, 3)]
    schema = written_snapshots(spark, tmp_path, transfers, [])
    rows = run(spark, tmp_path, schema, 1, keep_s=86_000.0).collect()
    assert len(rows) == 20 and all(r.reason is None for r in rows)
    store = lambda name: spark.read.format("statestore").option("stateVarName", name).load(f"{tmp_path}/run-1-1/log")
    assert store("block").count() == 0 and store("seen").count() <= 2


def test_stored_blocks_start_under_the_present_rules(spark, tmp_path):
    now = START.timestamp()
    stored = [("a", "Rejected: Banned", now - 9e6, now - 1, None), ("b", "Rejected: Too many files", now - 60, None, "t1"), ("c", "Rejected: Too many files", now - 9e6, None, None), ("d", "Aborted", now, None, None), ("e", "by hand", None, None, None)]
    kept = policy.reclassified(spark.createDataFrame(stored, f"peer string, {policy.BLOCK}"), F.lit(now))
    want = {"a": None, "b": now - 60 + policy.COOLDOWN_S, "e": None}
    assert {r.peer: r.expires_at for r in kept.collect()} == want
    schema = written_snapshots(spark, tmp_path, [(START, "A", "x.mp3", "t9", "Cancelled", None, None, None, START), (START, "b", "x.mp3", "t8", "Cancelled", None, None, None, START)], [(START, "e", "unblock", None)])
    rows = run(spark, tmp_path, schema, 1, initial=kept)
    assert {r.peer: r.reason for r in rows.collect()} == {"b": "Cancelled", "e": None}


def test_bulk_spans(spark):
    rng = random.Random(5)
    rows = [(i % 2, 600.0 * rng.randint(1, 3) + rng.choice([-2, -1, 0, 0.5, 1, 1.5, 2.2]) + rng.random()) for i in range(60)] + [(0, None)]
    got = policy.in_bulk(spark.createDataFrame(rows, "s int, ended double"), "s").collect()
    assert len(got) == len(rows)
    for s in (0, 1):
        times = sorted(t for k, t in rows if k == s and t is not None)
        want = {x for i in range(len(times) - 2) if times[i + 1] - times[i] <= 1 and times[i + 2] - times[i + 1] <= 1 for x in times[i : i + 3]}
        assert {r.ended for r in got if r.s == s and r.bulk} == want
