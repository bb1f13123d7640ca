"""Names in texts against brute force over all pairs."""

import random
import re

import pytest

from lacuna.operators import naming

TEXT, NAME = "text_id long, words array<string>", "name_id string, words array<string>"


def inside(needle, hay):
    return [i + 1 for i in range(len(hay) - len(needle) + 1) if needle and hay[i : i + len(needle)] == needle]


@pytest.mark.parametrize("seed", range(3))
def test_names_in_texts_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    draw = lambda most: [rng.choice("abcde") for _ in range(rng.randrange(most))]
    texts = [(i, draw(30)) for i in range(60)] + [(90, None), (91, [])]
    names = [(f"n{i}", draw(6)) for i in range(40)] + [("same", ["a", "b"]), ("same too", ["a", "b"]), ("none", None)]
    found = naming.find_names(spark.createDataFrame(texts, TEXT), spark.createDataFrame(names, NAME))
    want = sorted((t, n, at, len(x)) for t, ws in texts for n, x in names for at in (inside(x or [], ws or [])))
    assert sorted(tuple(r) for r in found.collect()) == want
    kept = {(r.text_id, r.name_id) for r in naming.longest(found, spark.createDataFrame(names, NAME)).collect()}
    by_text, of = {}, dict(names)
    for t, n, _, _ in want:
        by_text.setdefault(t, set()).add(n)
    assert kept == {(t, n) for t, ns in by_text.items() for n in ns if not any(len(of[o]) > len(of[n]) and inside(of[n], of[o]) for o in ns)}


@pytest.mark.parametrize("few", [0, naming.FEW])
def test_few_names_come_to_the_texts(spark, monkeypatch, few):
    """Texts are not shuffled to meet few names; repeated rows and ids find the same either way."""
    monkeypatch.setattr(naming, "FEW", few)
    texts = [(1, ["a", "b", "c", "a", "b"]), (1, ["a", "b", "c", "a", "b"]), (1, ["a", "b"]), (None, ["c"]), (2, ["b", "c", "d"])]
    names = [("ab", ["a", "b"]), ("c", ["c"]), ("bcd", ["b", "c", "d"]), ("bcd", ["b", "c", "d"]), ("b", ["b"])]
    found = naming.find_names(spark.createDataFrame(texts, TEXT), spark.createDataFrame(names, NAME))
    want = {(i, n, at, len(x), tuple(ws)) for i, ws in texts for n, x in names for at in inside(x, ws)}
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted((w[:4] for w in want), key=repr)
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)", found._jdf.queryExecution().executedPlan().toString())
    assert not any(re.search(r"\bwords#", by) or re.fullmatch(r"text_no#\d+L?, \d+", by) for by in dealt) or not few


def test_folders_name_releases_by_whole_words(spark):
    files = ["/m/Abba/1992 - Gold Hits [FLAC]/01.mp3", "/m/Abba/Online Sessions/a.mp3", "/m/X/On/1.mp3", "C:\\m\\Gold\\Hits\\1.mp3", "bare.mp3", None]
    frame = spark.createDataFrame([(f,) for f in files], "path string")
    releases = spark.createDataFrame([("Gold Hits",), ("On",), ("Ön",), ("Sessions!",), ("",), (None,)], "title string")
    got = sorted((r.path, r.title) for r in naming.named_by_path(frame, releases).collect())
    assert got == sorted([(files[0], "Gold Hits"), (files[1], "Sessions!"), (files[2], "On"), (files[2], "Ön"), (files[3], "Gold Hits")])


def plain_place(words, own, keys, releases, lenient):
    bare = lambda ws: tuple(w[:-1] if lenient and len(w) >= 5 and w.endswith("s") else w for w in ws)
    if not words:
        return "loose"
    words, own = bare(words), bare(own)
    named = {bare(ws) for ws, _ in releases if bare(ws) != own and inside(bare(ws), words)}
    named = {n for n in named if not any(len(o) > len(n) and inside(n, o) for o in named)}
    held = {k for ws, ks in releases if bare(ws) in named for k in ks}
    return "unknown" if not named else "shares" if held & set(keys) else "other"


@pytest.mark.parametrize("lenient", [False, True])
def test_place_of_a_folder_equals_brute_force(spark, lenient):
    rng = random.Random(8)
    some = lambda least, most: [rng.choice(["first", "light", "lights", "gold", "hits", "night", "nights", "on"]) for _ in range(rng.randint(least, most))]
    releases = [(some(1, 3), [rng.randrange(9) for _ in range(rng.randrange(4))]) for _ in range(14)]
    asked = [(i, some(0, 5), some(0, 2), [rng.randrange(9) for _ in range(rng.randrange(3))]) for i in range(80)]
    got = naming.folder_place(
        spark.createDataFrame(asked, "ask_id long, words array<string>, own array<string>, keys array<long>"), spark.createDataFrame(releases, "words array<string>, keys array<long>"), lenient
    ).collect()
    assert {r.ask_id: r.place for r in got} == {i: plain_place(w, o, k, releases, lenient) for i, w, o, k in asked}
    assert len({r.place for r in got}) == 4
