"""Four-tier linkage: cases that must and must not be found, and a plain loop over random inventories."""

import random
import re
from difflib import SequenceMatcher

import pytest

from lacuna.functions import readings as grammar
from lacuna.functions.readings import title_key
from lacuna.functions.text import NUMBERED_VALUES
from lacuna.operators import likeness, linkage, readings

CATALOGUE = "seq long, artist_id string, release string, releases array<string>, title string, track_number string, recording_ids array<string>, track_ids array<string>, release_id string"
ARTISTS = "artist_id string, alias string"
HELD = "path string, artists array<string>, album_artist string, album string, title string, track_number string, recording_ids array<string>, track_ids array<string>, release_ids array<string>"


def row(seq, title, release="Gold Hits", n=None, rec=None, trk=None, more=None, artist="ann", rid=None):
    return (seq, artist, release, more, title, n, rec, trk, rid)


def file(path, title=None, artists=None, album=None, n=None, rec=None, trk=None, albumartist=None, rids=None):
    return (path, artists, albumartist, album, title, n, rec, trk, rids)


def run(spark, catalogue, held, artists=(("ann", "Ann Lee"), ("ann", "A. Lee"))):
    found = linkage.linkage(spark.createDataFrame(catalogue, CATALOGUE), spark.createDataFrame(list(artists), ARTISTS), spark.createDataFrame(held, HELD))
    return {r.seq: (r.method, r.path) for r in found.collect()}


def test_cases(spark):
    catalogue = [
        row(1, "First", rec=["r1"], trk=["t1"]), row(2, "Second", rec=["r2"]), row(3, "Harbour"), row(4, "Shore (Live)"), row(5, "Winter Morning Song", "Later"), row(6, "Part II", "Later"),
        row(7, "Lanterns", "On"), row(8, "Ferry", "Other", more=["Best Of Ferries"]), row(9, "Numbered", "Third", n="7"), row(10, "Quay", "Fourth"), row(11, None), row(12, "Song 4", "Later"), row(13, "Harbour", "Gold Hits"),
    ]
    held = [
        file("m/a/0.flac", "x", rec=["r2"], trk=["t1"]), file("m/a/1.flac", "y", rec=["r2"]), file("m/1992 - Gold Hits [FLAC]/3.flac", "Harbour (2009 Remaster)"), file("m/Bob/Gold Hits/4.flac", "Shore (Live)", ["Bob"]),
        file("m/x/5.flac", "Winter Morning Q", ["Ann Lee feat. Cher"]), file("m/A Lee/6.flac", "Part 2"), file("m/Online Sessions/7.flac", "Lanterns"), file("m/y/8.flac", "Ferry", album="Best of Ferries"),
        file("m/Third/07.flac", None), file("m/z/10.flac", "Quay", ["Ann Leeson"]), file(None, "Harbour", ["Ann Lee"]), file("m/x/12.flac", "Song 5", ["Ann Lee"]),
    ]
    got = run(spark, catalogue, held)
    assert got[1] == ("track", "m/a/0.flac") and got[2] == ("recording", "m/a/1.flac")  # row after row, not id after id
    assert got[3] == ("release", held[2][0]) and got[4] == (None, None)  # Bob's album of that name is not hers
    assert got[5] == ("fuzzy 85%", "m/x/5.flac") and got[6] == ("artist", "m/A Lee/6.flac")
    assert got[7] == (None, None) and got[8] == ("release", "m/y/8.flac") and got[9] == ("number", "m/Third/07.flac")
    assert got[10] == got[11] == got[12] == got[13] == (None, None)
    assert run(spark, [], []) == {} and run(spark, [row(1, "x")], []) == {1: (None, None)}


def ratio(a, b):
    return 0.0 if not a or not b else 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


def run_of(words, text):
    w, t = words.split(), text.split()
    return bool(w) and any(t[i : i + len(w)] == w for i in range(len(t) - len(w) + 1))


def agree(e, r):
    if e.version_type != r.version_type:
        return False
    a, b = e.version or "", r.version or ""
    if not a or not b or e.version_type in ("instrumental", "acapella"):
        return True
    if e.version_type in ("acoustic", "live", "demo"):
        a, b = (re.sub(readings.TAKE_WORDS, "", x).strip() for x in (a, b))
        if not a or not b:
            return True
    elif e.version_type in ("remix", "mix_edit", "vip"):
        c, d = (re.sub(readings.REMIX_WORDS, "", x).strip() for x in (a, b))
        a, b = (c, d) if c and d else (a, b)
    return a in b or b in a or ratio(a, b) >= 0.75


def plain(catalogue, held, aliases):
    keys = [title_key(a) for a in aliases]
    own_ids = {c[8] for c in catalogue if c[8]}
    files = sorted((h for h in held if h[0]), key=lambda h: h[0])
    numbers = lambda k: [n for w in k.split() if (n := NUMBERED_VALUES.get(w) or (str(int(w)) if w.isdigit() else None))]
    clash = lambda a, b: bool(numbers(a) and numbers(b) and numbers(a) != numbers(b))
    digits = lambda n: re.sub("[^0-9]", "", (n or "").split("/")[-1].split("-")[-1]).lstrip("0")
    title = lambda h: h[4] if (h[4] or "").strip() else None
    name = lambda h: h[0].rsplit("/", 1)[-1]
    parsed = lambda h: grammar.parts(grammar.tidy(title(h))) if title(h) else grammar.parts(grammar.likeliest(name(h)))
    whole = lambda h: title_key(grammar.tidy(title(h)) if title(h) else grammar.likeliest(name(h)))
    traced = lambda texts: any(run_of(k, title_key(t)) for t in texts if t for k in keys)
    narrow = lambda h: traced([*(h[1] or []), h[0]])
    wide = lambda h: narrow(h) or traced([h[2]]) or bool(set(h[8] or []) & own_ids)
    others = lambda h: any(x and x.lower() not in linkage.NOBODY.split("|") for x in [*(h[1] or []), h[2]]) and not wide(h)

    def folder(h, key):
        folders = h[0].rsplit("/", 1)[0] if "/" in h[0] else ""
        return key and (key in [title_key(f) for f in folders.split("/")] if len(key) < 3 else run_of(key, title_key(folders)))

    def sure(c, h):
        releases = [title_key(r) for r in [c[2], *(c[3] or [])] if r]
        like = max([ratio(r, title_key(h[3])) for r in releases], default=0)
        return (like > 0.7 or any(folder(h, r) for r in releases)) and (like >= 0.9 or not others(h))

    def fits(c, h):
        e, r = grammar.parts(grammar.tidy(c[4])), parsed(h)
        other = e.base != r.base and digits(c[5]) and digits(h[5]) and digits(c[5]) != digits(h[5])
        return e, r, agree(e, r) and not clash(e.base, r.base) and not other

    def same(c, h):
        e, r, ok = fits(c, h)
        return ok and ratio(e.base, r.base) > 0.9

    def bare(h):
        stem, t = name(h).rsplit(".", 1)[0], title(h) or ""
        return bool((stem.isdigit() and (not t or t.isdigit())) or (t.isdigit() and not re.search("[a-zA-Z]", stem)))

    def tier1(c, h):
        return "recording" if set(c[6] or []) & set(h[6] or []) else "track" if set(c[7] or []) & set(h[7] or []) else None

    def tier2(c, h):
        if not sure(c, h):
            return None
        n = h[5] or name(h).rsplit(".", 1)[0]
        return "number" if bare(h) and c[5] and digits(c[5]) == digits(n) != "" else "release" if same(c, h) else None

    def tier4(c, h):
        e, r, ok = fits(c, h)
        key = title_key(c[2])
        near = narrow(h) or (key and (key == title_key(h[3]) or (folder(h, key) and not others(h))))
        if bare(h) or not near or not ok or len(e.base) < 3 or clash(title_key(grammar.tidy(c[4])), whole(h)):
            return None
        best = max(ratio(e.base, r.base), ratio(title_key(grammar.tidy(c[4])), whole(h)))
        return f"fuzzy {int(best * 100 + 1e-9)}%" if best >= 0.85 else None

    found, used = {c[0]: (None, None) for c in catalogue}, set()
    for tier in (tier1, tier2, lambda c, h: "artist" if narrow(h) and same(c, h) else None, tier4):
        for c in sorted(catalogue):
            for h in files if found[c[0]] == (None, None) and (tier is tier1 or c[4]) else ():
                if h[0] not in used and (method := tier(c, h)):
                    found[c[0]] = (method, h[0])
                    used.add(h[0])
                    break
    return found


@pytest.mark.parametrize("seed", range(4))
def test_equals_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    titles = ["Harbour Lights", "Harbour Light", "Shore", "Shore (Live)", "Part II", "Part 2", "Song 4", "Song 5", "Winter Morning", "Winter Mornings", "Ferry (Bob Remix)", "Ferry (Rob Remix)", "On"]
    releases = ["Gold Hits", "Gold Hit", "Later Days", "On", "Best of Ann"]
    some = lambda values, most: [rng.choice(values) for _ in range(rng.randint(0, most))]
    catalogue = [
        row(i, rng.choice([*titles, None]), rng.choice(releases), rng.choice([None, "1", "02", "A3", "1-04"]), some([f"r{k}" for k in range(40)], 1), some([f"t{k}" for k in range(40)], 1), some(releases, 1), rid=rng.choice([None, "rel1"]))
        for i in range(25)
    ]
    held = [
        file(
            f"m/{rng.choice(['Ann Lee', 'Bob', 'x', 'a lee music'])}/{rng.choice(['Gold Hits [FLAC]', '1999 On', 'On', 'y', 'Later days'])}/{rng.choice(['', f'{i:02} - '])}{rng.choice(['', 'Ann - ', 'z'])}{rng.choice(titles) if rng.random() < 0.7 else i}.mp3",
            rng.choice([*titles, None, None, "", "7"]), rng.choice([None, ["Ann Lee"], ["Bob"], ["Ann Lee feat. Bob", "Cy"], ["Various Artists"]]), rng.choice([None, *releases, "Gold Hitz"]), rng.choice([None, "1", "2/9", "3", "4"]),
            some([f"r{k}" for k in range(40)], 1), some([f"t{k}" for k in range(40)], 1), rng.choice([None, "Ann Lee", "Bob", "VA"]), rng.choice([None, ["rel1"], ["rel2"]]),
        )
        for i in range(40)
    ]
    held = list({h[0]: h for h in held}.values())
    got = run(spark, catalogue, held)
    want = plain(catalogue, held, ["Ann Lee", "A. Lee"])
    assert got == want, [(k, got[k], want[k]) for k in want if got[k] != want[k]]
    assert len({(m or "none").split()[0] for m, _ in want.values()}) > 3


@pytest.mark.parametrize("least", [0.85, 0.9, 0.97])
def test_likeness_loses_no_pair(spark, least):
    rng = random.Random(int(least * 100))
    words = ["an", "ban", "nan", "a", "ab", "abc", "harbour", "harbor", "light", "lights", "x"]
    keys = list({" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(120)} | {"aaaaaaaa", "aaaaaaa", "aaaaaaab", "", "q"})
    rows = [(rng.randint(0, 1), k) for k in keys for _ in range(2)] + [(0, None)]
    frame = spark.createDataFrame(rows, "g int, key string")
    got = {(r.g, r.a, r.b): r.ratio for r in likeness.like_pairs(frame, frame, least, ["g"]).collect()}
    groups = {g: {k for x, k in rows if x == g and k} for g in (0, 1)}
    assert got == {(g, a, b): ratio(a, b) for g, ks in groups.items() for a in ks for b in ks if ratio(a, b) >= least}
    assert len(got) > len(groups[0]) + len(groups[1]) or least > 0.95
