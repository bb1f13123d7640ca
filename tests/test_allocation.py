"""Allocation in order, choice of folders and covers against plain loops over random offers."""

import random

import pytest
from pyspark.sql import functions as F

from lacuna.operators import allocation

CLAIM = "release int, song int, file string, place int, note string"


def loop(rows):
    """Each song of each release in turn takes the best file that is left."""
    used, out = set(), {}
    for release, song, file, place, _ in sorted(rows, key=lambda r: (r[0], r[1], r[3], r[2])):
        if (release, song) not in out and file not in used:
            out[release, song] = (file, place)
            used.add(file)
    return out


@pytest.mark.parametrize("most", [0, 40, 50_000])
@pytest.mark.parametrize("files", [12, 60, 400])
def test_claims_in_order_equal_the_loop(spark, files, most):
    """Few files make one giant component in which everyone waits for others, many files make small ones."""
    rng = random.Random(files)
    rows = list({(r, s, f): (r, s, f"f{f}", rng.randrange(4), "x") for r in range(20) for s in range(6) for f in rng.choices(range(files), k=4)}.values())
    offers = spark.createDataFrame(rows, CLAIM)
    order = [F.col("release"), F.col("song"), F.col("place"), F.col("file")]
    got = allocation.allocate(offers, ["release", "song"], ["file"], order, most)
    assert got.columns == offers.columns
    assert {(r.release, r.song): (r.file, r.place) for r in got.collect()} == loop(rows)


def test_a_chain_in_which_each_waits_for_the_one_before(spark):
    rows = [(i, 0, f"f{i - d}", d, "x") for i in range(1, 30) for d in (1, 0)]
    got = allocation.allocate(spark.createDataFrame(rows, CLAIM), ["release", "song"], ["file"], [F.col("release"), F.col("song"), F.col("place")], most=0)
    assert {(r.release, r.song): (r.file, r.place) for r in got.collect()} == loop(rows)


def test_nulls_repeats_and_no_offers(spark):
    rows = [(1, 1, "a", 1, "x"), (1, 1, "a", 0, "y"), (None, 1, "b", 0, "x"), (2, 1, None, 0, "x"), (2, 1, "a", 0, "x")]
    got = allocation.allocate(spark.createDataFrame(rows, CLAIM), ["release", "song"], ["file"], [F.col("release"), F.col("place")])
    assert [tuple(r) for r in got.collect()] == [(1, 1, "a", 0, "y")]
    assert allocation.allocate(spark.createDataFrame([], CLAIM), ["release", "song"], ["file"], [F.col("release")]).count() == 0


OFFER = "release string, song int, song_order int, peer string, folder string, file string, rank int, context int, preferred boolean, placed boolean, health int, quality int"


def plain_folders(rows, complete=None):
    out = {}
    for release in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == release]
        known = len({r[1] for r in mine})
        folders = {}
        for r in sorted(mine, key=lambda r: (r[2], r[6])):
            held = folders.setdefault((r[3], r[4]), {})
            if r[1] not in held and all(r[5] != x[5] for x in held.values()):
                held[r[1]] = r
        ranked = []
        for (peer, folder), held in folders.items():
            files = list(held.values())
            if complete is not None and len(files) != complete[release]:
                continue
            context = max(x[7] for x in files) > 0
            placed = sum(x[9] for x in files) if known > 1 or context else 0
            ranked.append(((-context, -sum(x[8] for x in files), -len(files), -placed, min(x[10] for x in files), -sum(x[11] for x in files), peer.lower(), folder.lower()), peer, folder, held))
        for _, peer, folder, held in sorted(ranked, key=lambda x: x[0]):
            for song, x in held.items():
                out.setdefault((release, song), (peer, folder, x[5]))
    return out


def random_offers(rng):
    rows, health = {}, {}
    for release in ("r1", "r2", "r3"):
        for song in range(1 if release == "r3" else 9):
            for rank in range(30):
                peer, folder = rng.choice("PqRs"), rng.choice(["A", "b", "C"])
                file = f"{folder}{rng.randrange(8)}"
                same = health.setdefault((release, peer), rng.randrange(3))
                rows.setdefault((release, song, peer, folder, file), (release, song, song, peer, folder, file, rank, rng.choice([0, 0, 0, 1]), rng.random() < 0.4, rng.random() < 0.5, same, rng.randrange(5)))
    return list(rows.values())


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("most", [0, 50_000])
def test_best_folders_equal_the_loop(spark, seed, most):
    rows = random_offers(random.Random(seed))
    got = allocation.best_folders(spark.createDataFrame(rows, OFFER), most=most).collect()
    assert {(r.release, r.song): (r.peer, r.folder, r.file) for r in got} == plain_folders(rows)


def test_complete_releases_only(spark):
    rows = random_offers(random.Random(9))
    whole = {"r1": 7, "r2": 8, "r3": 1}
    got = allocation.best_folders(spark.createDataFrame(rows, OFFER), spark.createDataFrame(list(whole.items()), "release string, n_songs int")).collect()
    assert {(r.release, r.song): (r.peer, r.folder, r.file) for r in got} == plain_folders(rows, whole)


def plain_cover(rows):
    out = []
    for release in {r[0] for r in rows}:
        left, step = {s for r, _, s in rows if r == release}, 0
        folders = {f: {s for r, g, s in rows if (r, g) == (release, f)} for r, f, _ in rows if r == release}
        while left:
            best = min(folders, key=lambda f: (-len(folders[f] & left), f))
            step += 1
            gone = folders[best] & left
            out += [(release, best, s, len(gone), step) for s in gone]
            left -= gone
    return sorted(out)


@pytest.mark.parametrize("most", [0, 30, 50_000])
def test_cover_equals_the_loop(spark, most):
    rng = random.Random(6)
    rows = [(r, f"f{rng.randrange(9)}", s) for r in range(5) for s in range(25) for _ in range(3)]
    rows += [(7, f"c{i:02}", i + d) for i in range(15) for d in (0, 1)]
    got = allocation.cover(spark.createDataFrame([*rows, (None, "f", 1), (9, None, 1)], "album int, dir string, track int"), "album", "dir", "track", most)
    assert got.columns == ["album", "dir", "track", "n_filled", "step"] and sorted(tuple(r) for r in got.collect()) == plain_cover(rows)


def test_cover_of_a_long_chain_needs_no_rounds(spark, monkeypatch):
    # each folder shares a song with the next smaller one, so a round could take one folder only
    rows = [(1, f"d{i:03}", i * 1_000 + k) for i in range(200) for k in range(400 - i)] + [(1, f"d{i:03}", (i - 1) * 1_000) for i in range(1, 200)]
    assert len(rows) > allocation.MOST
    tables, write = [], allocation.written
    monkeypatch.setattr(allocation, "written", lambda df: tables.append(1) or write(df))
    got = allocation.cover(spark.createDataFrame(rows, "album int, dir string, track int"), "album", "dir", "track").collect()
    assert sorted(tuple(r) for r in got) == plain_cover(rows) and len(tables) <= 2
