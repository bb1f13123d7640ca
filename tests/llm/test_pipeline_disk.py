"""What the pipeline's stages move: texts, sets and postings are shuffled no more than they must be, with the same rows."""

from collections import Counter

import numpy as np

from lacuna.llm import mixing, similar
from tests.llm.test_similar import SCHEMA, plain_kept


def test_mixed_texts_stay_where_they_are(spark):
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 40))), ["a", "b", "c", None][int(rng.choice(4, p=[0.05, 0.15, 0.6, 0.2]))]) for k in range(3_000)]
    rows += [(k, rows[k][1], "z") for k in range(0, 60, 3)] + [(5, rows[5][1], rows[5][2])] * 2 + [(9_000, None, "a"), (9_001, " \t\n", "b"), (9_002, "\x0b\x1f", "b")]
    docs = spark.createDataFrame(rows, SCHEMA).cache()
    times = {}
    for r in mixing.mix(docs).collect():
        times[r.doc_id] = max(times.get(r.doc_id, 0), int(r.taken / r["size"] + 0.5) if r["size"] else 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16000")
    try:
        found = mixing.mixed_documents(docs)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert Counter(map(tuple, found.collect())) == Counter({r: times[r[0]] * n for r, n in Counter(rows).items() if times[r[0]]})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len({times[k] for k in range(3_000)}) > 2


def test_sketches_refuse_only_what_is_not_similar():
    rng = np.random.default_rng(6)
    allowed = Counter()
    for n in (1, 3, 60, 255, 257, 900, 1_024, 2_400, 5_000):
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        for part in (0.0, 0.02, 0.1, 0.3, 0.6, 1.0):
            for more in (0, n // 9):
                y = np.concatenate([x[int(part * n) :], rng.integers(0, 2**63, int(part * n) + more).astype(np.uint64)])
                a, b = np.unique(x), np.unique(y)
                open_ = similar._sketches_allow(similar._sketch(a), similar._sketch(b))
                alike = similar.similar(set(a.tolist()), set(b.tolist()))
                assert alike == similar._sets_similar(a.tobytes(), b.tobytes()) and (open_ or not alike)
                allowed[n >= 255 and part >= 0.3, open_] += 1
    assert not allowed[True, True] and allowed[True, False] and allowed[False, True]


def test_postings_dealt_once_equal_brute_force(spark, monkeypatch):
    """No posting is taken for hot, so all go the way that those of a large table go; some are large, and turns are taken."""
    rng = np.random.default_rng(11)
    word, base, rows, turns = lambda n: [f"v{k}" for k in rng.integers(0, 10**6, n)], [f"w{k}" for k in range(120)], [], []
    edited = lambda text, n: " ".join(f"edit{rng.integers(0, 10**6)}" if k in set(rng.integers(0, len(text), n).tolist()) else w for k, w in enumerate(text))
    rows += [(k, edited(base, int(rng.integers(1, 7))), "s") for k in range(60)]
    for _ in range(30):
        shared, own = word(12), word(90)
        rows += [(len(rows) + k, " ".join(word(9) + shared + word(9)), "s") for k in range(2)] + [(len(rows) + 2 + k, edited(own, k), "s") for k in range(4)]
    for name, value in (("_hot", lambda counted: np.array([], np.int64)), ("LARGE", 20), ("PAIRS_EACH", 0), ("PAIRS_KEPT", 50)):
        monkeypatch.setattr(similar, name, value)
    turn = similar._turn
    monkeypatch.setattr(similar, "_turn", lambda *a: turns.append(1) or turn(*a))
    found = similar.kept(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id for r in found), key=repr) == plain_kept(rows) and turns
