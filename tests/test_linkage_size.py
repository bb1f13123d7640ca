"""Linkage of one large release writes no table of all its tracks with all its files, and compares each pair once."""

from lacuna.operators import likeness, linkage
from tests.test_linkage import ARTISTS, CATALOGUE, HELD, file, row

N = 40


def test_one_release_is_no_product(spark, monkeypatch):
    sizes, write = [], linkage.written

    def counted(df):
        found = write(df)
        sizes.append(found.count())
        return found

    monkeypatch.setattr(linkage, "written", counted)
    catalogue = [row(i, f"Song no {i}", n=str(i)) for i in range(N)]
    held = [file(f"m/{i:03}.mp3", f"Song no {i}", ["Ann Lee"], "Gold Hits") if i % 2 else file(f"m/{i:03}.mp3", None, ["Ann Lee"], "Gold Hits") for i in range(N)]
    found = linkage.linkage(spark.createDataFrame(catalogue, CATALOGUE), spark.createDataFrame([("ann", "Ann Lee")], ARTISTS), spark.createDataFrame(held, HELD))
    got = {r.seq: (r.method, r.path) for r in found.collect()}
    assert got == {i: ("release" if i % 2 else "number", f"m/{i:03}.mp3") for i in range(N)}
    assert max(sizes) <= 4 * N


def test_an_album_of_many_artists_is_no_product(spark, monkeypatch):
    sizes, write = [], linkage.written

    def counted(df):
        found = write(df)
        sizes.append(found.count())
        return found

    monkeypatch.setattr(linkage, "written", counted)
    # every artist has a release of that title, and no tag tells whose a file is
    catalogue = [row(i, f"Song no {i}", artist=f"a{i}") for i in range(N)]
    held = [file(f"m/{i:03}.mp3", f"Song no {i}", album="Gold Hits") for i in range(N)]
    artists = spark.createDataFrame([(f"a{i}", f"Some One{i}") for i in range(N)], ARTISTS)
    found = linkage.linkage(spark.createDataFrame(catalogue, CATALOGUE), artists, spark.createDataFrame(held, HELD))
    assert {r.seq: (r.method, r.path) for r in found.collect()} == {i: ("release", f"m/{i:03}.mp3") for i in range(N)}
    assert max(sizes) <= 4 * N


def test_small_groups_compare_all_and_lose_no_pair(spark):
    names = ["winter morning song", "winter morning sing", "winter", "wint", "", "a", "winter morning song"]
    left = spark.createDataFrame([(g, x) for g in range(9) for x in names[: g + 1]], "g int, key string")
    right = spark.createDataFrame([(g, x) for g in range(3, 12) for x in names], "g int, key string")
    pairs = likeness.like_pairs(left, right, per=["g"])
    got = sorted((r.g, r.a, r.b) for r in pairs.collect())
    songs = names[:2]
    assert [x for x in got if x[1] != x[2]] == [(g, a, b) for g in range(3, 9) for a in sorted(songs) for b in sorted(songs) if a != b]
    assert len([x for x in got if x[1] == x[2]]) == sum(len({*names[: g + 1]} - {""}) for g in range(3, 9))


def test_pairs_are_compared_after_their_repeats_are_gone(spark):
    names = spark.createDataFrame([("a", "winter morning song"), ("a", "winter morning sing")], "artist string, key string")
    pairs = likeness.like_pairs(names, names, per=["artist"])
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("RepartitionByExpression") and plan.count("ArrowEvalPython") == 1
    assert sorted((r.a, r.b) for r in pairs.collect() if r.a < r.b) == [("winter morning sing", "winter morning song")]
