"""An audit deals each offer once, and compares titles elsewhere only in releases where both sides have some left."""

import random

from pyspark.sql import functions as F

from lacuna.operators import audit, matching

OFFICIAL = "release_id long, seq int, disc_number int, track_position int, absolute_position int, token string, title string, alt_titles array<string>, track_id string, recording_id string"
HELD = "release_id long, seq int, path string, disc_number int, number int, title string, track_ids array<string>, recording_ids array<string>"


def test_missing_tracks_are_not_cut_into_letters_and_nothing_is_checkpointed(spark, monkeypatch):
    sizes, write = [], audit.written

    def counted(df):
        found = write(df)
        sizes.append(found.count())
        return found

    monkeypatch.setattr(audit, "written", counted)
    monkeypatch.setattr(type(spark.range(0)), "checkpoint", lambda *a, **b: 1 / 0)
    places = [(r, i) for r in range(20) for i in range(1, 6)]
    official = spark.createDataFrame([(r, i, 1, i, i, str(i), f"Winter Morning Song {r} {i}", None, None, None) for r, i in places], OFFICIAL)
    held = spark.createDataFrame([(r, i, f"{r}/{i}", 1, i, f"Winter Morning Song {r} {i} (2009 Remaster)", None, None) for r, i in places if i < 4], HELD)
    blocks = []
    monkeypatch.setattr(audit, "_blocks", lambda rows, cut=audit._blocks: blocks.append(cut(rows)) or blocks[-1])
    tracks = audit.audit_tracks(official, held)
    assert {(r.release_id, r.seq): r.path for r in tracks.collect()} == {(r, i): f"{r}/{i}" if i < 4 else None for r, i in places}
    assert sum(x.count() for x in blocks) == 0 and max(sizes) <= 2 * len(places)


def test_ends_within_a_column_equal_ends_of_the_whole_table(spark):
    rng = random.Random(3)
    rows = list({(g, a, b): (g, a, b, rng.randrange(4)) for g in range(30) for a in range(8) for b in rng.choices(range(8), k=3)}.values())
    offers = spark.createDataFrame([*rows, *rows[:9], (None, 1, 1, 1), (1, None, 1, 1)], "g int, a int, b int, worth int")
    whole = matching.greedy_assignment(offers.na.drop().select(F.struct("g", "a").alias("a"), F.struct("g", "b").alias("b"), "worth"), "a", "b", "worth")
    want = sorted((r.a.g, r.a.a, r.b.b, r.worth) for r in whole.collect())
    for most in (0, 2_000_000):
        got = matching.greedy_assignment(offers, "a", "b", "worth", most, within="g")
        assert got.columns == ["g", "a", "b", "worth"] and sorted(tuple(r) for r in got.collect()) == want
