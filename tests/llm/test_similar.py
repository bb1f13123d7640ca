"""Near duplicates of the pipeline against brute force over all pairs."""

import numpy as np

import corpus_pipeline
from lacuna.llm import similar

SCHEMA = "doc_id long, text string, source string"


def plain_kept(rows):
    """Rows that stay: the first of each group by doc_id (null last)."""
    sets = [similar.shingles(x) for _, x, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both and 5 * both >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, (doc_id, _, _) in enumerate(rows):
        groups.setdefault(find(i), []).append((doc_id is None, doc_id))
    return sorted((min(g)[1] for g in groups.values()), key=repr)


def test_near_copies_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 3_000, n)]
    common, rows = word(40), []
    for _ in range(40):
        base = word(int(rng.integers(3, 250))) + common * int(rng.integers(0, 2))
        for edits in (0, 0, 1, 2, 4, 7):
            text = list(base)
            for k in rng.integers(0, len(text), edits):
                text[k] = f"edit{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(text), "s"))
    found = corpus_pipeline.deduplicated(spark, spark.createDataFrame(rows, SCHEMA), "")
    want = plain_kept(rows)
    assert len(want) < 200 and sorted((r.doc_id for r in found.collect()), key=repr) == want and found.columns == ["doc_id", "text", "source"]


def test_one_row_of_each_group_by_row_and_not_by_id(spark):
    rows = [
        (None, "only here and without an id at all", "s"), (None, "copied text of some words", "s"), (7, "copied text of some words", "s"), (7, "copied text of some words", "s"),
        (None, "both without an id are copies", "s"), (None, "both without an id are copies", "t"), (3, "first text under a shared id", "s"), (3, "second text has the same id", "s"),
        (9, None, "s"), (8, "", "s"), (5, "Copied  text of some WORDS", "s"),
    ]
    found = corpus_pipeline.deduplicated(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r.doc_id for r in found), key=repr) == plain_kept(rows) == [3, 3, 5, 8, None, None]
    assert len({r.text for r in found}) == len(found)


def test_turns_over_a_large_group_equal_brute_force(spark, monkeypatch):
    """Many near copies of one text, some similar to few others: turns are taken, and the result is that of all pairs."""
    rng = np.random.default_rng(7)
    base, rows, turns = [f"w{k}" for k in range(120)], [], []
    for _ in range(160):
        text = list(base)
        for k in rng.integers(0, len(text), int(rng.integers(1, 7))):
            text[k] = f"edit{rng.integers(0, 10**6)}"
        rows.append((len(rows), " ".join(text), "s"))
    monkeypatch.setattr(similar, "LARGE", 0)
    monkeypatch.setattr(similar, "PAIRS_EACH", 0)
    turn = similar._turn
    monkeypatch.setattr(similar, "_turn", lambda *a: turns.append(1) or turn(*a))
    found = similar.kept(spark.createDataFrame(rows, SCHEMA)).collect()
    want = plain_kept(rows)
    assert 1 < len(want) < 160 and sorted((r.doc_id for r in found), key=repr) == want
    assert turns


def test_a_turn_joins_only_rows_of_large_postings(spark, monkeypatch):
    """One large group beside many pairs that share a passage and are not similar: rows of their postings are joined once."""
    rng = np.random.default_rng(9)
    word, base, rows, joined = lambda n: [f"v{k}" for k in rng.integers(0, 10**6, n)], [f"w{k}" for k in range(120)], [], []
    for _ in range(60):
        text = list(base)
        for k in rng.integers(0, len(text), int(rng.integers(1, 7))):
            text[k] = f"edit{rng.integers(0, 10**6)}"
        rows.append((len(rows), " ".join(text), "s"))
    for _ in range(40):
        shared = word(12)
        rows += [(len(rows) + k, " ".join(word(9) + shared + word(9)), "s") for k in range(2)]
    monkeypatch.setattr(similar, "LARGE", 20)
    monkeypatch.setattr(similar, "PAIRS_EACH", 0)
    turn, join = similar._turn, similar.join_per_key
    turns = []
    monkeypatch.setattr(similar, "_turn", lambda *a: turns.append(len(joined)) or turn(*a))
    monkeypatch.setattr(similar, "join_per_key", lambda *a: joined.append(a[0].count() if a[2] == "hash" else 0) or join(*a))
    found = similar.kept(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id for r in found), key=repr) == plain_kept(rows)
    postings = joined[0]
    assert turns and max(joined[turns[0] :]) < postings - 2 * 40


def test_repeated_lines_and_words_lose_no_link(spark):
    """Copies with one of their own lines, a phrase or a word repeated many times are similar sets, whatever they weigh."""
    rng = np.random.default_rng(12)
    rows = []
    for _ in range(25):
        base = [f"w{k}" for k in rng.integers(0, 5_000, 200)]
        at = int(rng.integers(0, 180))
        for more in ([], base[at : at + 12] * 30, base[at : at + 3] * 60, [base[at]] * 600, [f"x{rng.integers(0, 10**6)}"] * 600):
            rows.append((len(rows), " ".join(base + more), "s"))
    found = similar.kept(spark.createDataFrame(rows, SCHEMA)).collect()
    want = plain_kept(rows)
    assert len(want) == 25 and sorted((r.doc_id for r in found), key=repr) == want


def test_columns_of_clashing_names_come_back_as_they_were(spark):
    rows = [(1, "one text of a few words here", 5, "a", 0.5, None), (2, "one text of a few words here", 6, "b", None, 7), (3, "another one", 7, None, 1.5, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key long, __in string, stays double, column_0 long")
    found = similar.kept(docs)
    assert found.columns == docs.columns and sorted(tuple(r) for r in found.collect()) == [rows[0], rows[2]]
