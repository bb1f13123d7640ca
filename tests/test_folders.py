"""Speed of folders and coverage of releases against plain loops."""

import random

import pytest

from lacuna.operators import folders


def test_wrong_speed_equals_a_loop(spark):
    rng = random.Random(3)
    lengths = [(f"t{k}", float(rng.randint(100, 400))) for k in range(30) for _ in range(rng.randint(0, 3))] + [("t1", None), ("t2", 0.0)]
    known = {}
    for title, s in lengths:
        if s:
            known.setdefault(title, []).append(s)
    files = [("none", "t1", None), ("none", "t2", -5.0)]
    for folder in range(60):
        speed = rng.choice([0.7, 0.85, 0.9, 1.0, 1.1, 1.15, 1.4])
        files += [(f"f{folder}", f"t{k}", rng.choice(known.get(f"t{k}", [200.0])) * speed * rng.uniform(0.98, 1.03)) for k in rng.sample(range(34), rng.randint(1, 6))]
    want = {}
    for folder in {f for f, _, _ in files}:
        ratios = [min((s / x for x in known[t]), key=lambda r: abs(r - 1)) for f, t, s in files if f == folder and s and s > 0 and t in known]
        if len(ratios) > 1 and (max(ratios) < 0.88 or min(ratios) > 1.12) and max(ratios) / min(ratios) < 1.08:
            want[folder] = len(ratios)
    got = folders.wrong_speed(spark.createDataFrame(files, "folder string, title string, seconds double"), spark.createDataFrame(lengths, "title string, seconds double"))
    assert {r.folder: r.n_songs for r in got.collect()} == want and len(want) > 3


@pytest.mark.parametrize("most", [0, 50_000])
def test_directories_equal_a_loop(spark, most):
    rng = random.Random(4)
    songs = {"r1": 6, "r2": 3, "r3": 1}
    offers = [(r, f"d{d}", s, s, f"x{f}", f, rng.randint(1, 3), rng.choice([True, False, None])) for r, n in songs.items() for d in range(6) for s in range(n) for f in range(8) if rng.random() < 0.4]
    directories = [(f"d{d}", rng.choice([10.0, 30.0, None]), rng.random() < 0.5, rng.choice([True, False, None]), rng.choice([0.0, 7.0, 200.0, None]), rng.choice([True, False, None])) for d in range(6)]
    got = folders.evaluate_directories(
        spark.createDataFrame(offers, "release string, directory string, song int, expected int, file string, place int, tier int, positioned boolean"),
        spark.createDataFrame(list(songs.items()), "release string, n_songs int"),
        spark.createDataFrame(directories, "directory string, format_score double, preferred boolean, has_slot boolean, queue double, context boolean"), most,
    ).collect()
    want = {}
    for r, n in songs.items():
        for d, score, preferred, slot, queue, context in directories:
            used, found = set(), set()
            mine = [o for o in offers if o[0] == r and o[1] == d]
            for o in sorted(mine, key=lambda o: (-(o[6] + (0.5 if o[7] else -0.25 if o[7] is False else 0)), o[3], o[5])):
                if o[2] not in found and o[4] not in used:
                    found.add(o[2])
                    used.add(o[4])
            if found and (n > 3 or context):
                total = 100 * len(found) / n + (score or 0) + 20 * bool(slot) - min((queue or 0) / 2, 40) + 25 * preferred - (0 if context else 40)
                want[r, d] = (len(found), round(total, 9))
    assert {(x.release, x.directory): (x.n_matched, round(x.total_score, 9)) for x in got} == want and len(want) > 6
