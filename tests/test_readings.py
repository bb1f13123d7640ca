"""Readings of names: a table of cases, and joins over readings against loops over all pairs."""

import random
import re
from difflib import SequenceMatcher

import pytest

from lacuna.functions import readings as grammar
from lacuna.operators import readings

#: file name, base and version type of its likeliest title
FILES = """
04 - Harbour [FLAC] [901 kbps].flac | harbour |
04 - Harbour (24-96).flac | harbour |
02 - Ferry Song - 2009 Remaster.flac | ferry song |
02 - Ferry Song (Explicit).mp3 | ferry song |
9 - Ferry Song [Some-Site.net].mp3 | ferry song |
17 Some One - Quay - 7A - 98.5.flac | quay |
05 - Lanterns v2.flac | lanterns v2 |
05 - Lanterns [V2].flac | lanterns |
06 - Heatwave.flac | heatwave |
03-someone-small_boat.mp3 | small boat |
01_-_Some_One_-_Small_Boat.mp3 | small boat |
04-someone--lit_by_lamps-abc.mp3 | lit by lamps |
01-someone-song-remix-abc.mp3 | song | remix
01-song-remix.mp3 | song | remix
Some_Body-Open_Gate-Extended_Mix-0a1b2c3d.mp3 | open gate | mix_edit
02-Pick-Up.flac | pick up |
Someone - Album - 03 - Title.flac | title |
B2. Title.flac | title |
0102 - Harbour Lights.flac | harbour lights |
1 - 03. He Had a Boat.mp3 | he had a boat |
(02) Title.mp3 | title |
Someone - Album - 14 Shore (feat. Other One).flac | shore |
05 2 Of 9.flac | 2 of 9 |
05 - 9 (Someone Remix).flac | 9 | remix
03 - 7.39 (Original Cassette Demo).flac | 7 39 | demo
01 - 1987.flac | 1987 |
01 - ★.flac | ★ |
Ending ~TV size~.flac | ending | mix_edit
04 Shore - Live in Oslo.mp3 | shore | live
04 Shore – Unplugged Version.mp3 | shore | acoustic
04 Shore - Off Vocal.mp3 | shore | instrumental
04 Shore - A Cappella.mp3 | shore | acapella
04 Shore - Sped Up.mp3 | shore | speed
04 Shore - VIP Mix.mp3 | shore | vip
04 Someone - Night - Day.mp3 | day |
"""

#: catalogue title, base, version type and guests
TITLES = """
2 Of 9 | 2 of 9 | |
B1 Walker | b1 walker | |
SOUND.m4a | sound m4a | |
Hand of Wood - Intro | hand of wood intro | |
Fire - Someone Remix | fire | remix |
Night (feat. Olive) | night | | olive
Night ft. Ray-J | night | | ray j
Stay with Us | stay with us | |
Night (with A Guest) | night | | a guest
Night (Credits) | night credits | |
(Lyrics) | lyrics | |
Night Radio Edit | night | remix |
Night Remastered 2011 | night | |
Night & Day (Someone mix) | night and day | remix |
Part IV | part 4 | |
"""


def table(text):
    return [[c.strip() for c in line.split("|")] for line in text.strip().splitlines()]


def test_files_and_titles():
    for name, base, version in table(FILES):
        found = grammar.parts(grammar.likeliest(name))
        assert (name, found.base, found.version_type or "") == (name, base, version)
    for title, base, version, guests in table(TITLES):
        found = grammar.parts(grammar.tidy(title))
        assert (title, found.base, found.version_type or "", " ".join(found.guests)) == (title, base, version, guests)
    assert grammar.titles("2 Of 9.flac", True) == ["Of 9", "2 Of 9"] and grammar.titles("SOUND.m4a", False) == ["SOUND.m4a", "SOUND"]
    assert grammar.titles(None, True) == grammar.titles("  ", False) == [] and grammar.likeliest("") == ""


SAME = [
    ("2 Of 9", "05 - 2 Of 9.flac", 1), ("22/8", "23 22 8.mp3", 1), ("Coast (Some One remix)", "01 - Artist - Coast Some One Remix.flac", 1), ("Coast: By Night", "03 - Coast - By Night.flac", 1),
    ("007 (Old Town)", "05 - 007 (Old Town).flac", 1), ("Live", "11 - Artist - Live.flac", 1), ("Song (Live)", "Artist - Song - Live.flac", 1), ("Some Move", "01 1. Some Move.mp3", 1),
    ("Song", "2012-06-15 - Song.mp3", 1), ("Coal Train", "Artist_-_Coal_Train_320.mp3", 1), ("my bXXX Boat", "02 - my blue boat.mp3", 0.95), ("b**e boat", "blue boat.mp3", 0.95), ("my bXXX Boat", "my bXXX Boat.mp3", 1),
]
OTHER = [
    ("4 Long Days", "3 Long Days.flac"), ("Coast", "01 - Artist - Coast Some One Remix.flac"), ("Song", "05 - Song (Live).flac"), ("Live", "Artist - Song - Live.flac"), ("5. Ende", "05 6. Ende.mp3"),
    ("Night (Some One mix)", "03 - Night (Other Man Remix).flac"), ("Say [XXXXXX]", "01. Say [ABCDEF].mp3"), ("Cob", "05 - Cobweb.flac"),
]


def test_scores(spark):
    pairs = [(t, n) for t, n, _ in SAME] + OTHER + [(None, "x.mp3"), ("x", None), ("x", "")]
    got = {(r.title, r.name): r.score for r in readings.match_scores(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()}
    assert len(got) == len(SAME) + len(OTHER) + 1 and got["x", ""] == 0
    assert {(t, n): got[t, n] for t, n, _ in SAME} == {(t, n): s for t, n, s in SAME}
    assert all(got[p] < 0.8 for p in OTHER)


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
    return a in b or b in a or SequenceMatcher(None, a, b).ratio() >= 0.75


def plain_score(title, name):
    numbers = lambda x: {int(k) for k in re.findall(r"\b\d+\b", x.base)}
    best, offered = 0.0, grammar.readings(name, True)
    for e in grammar.readings(title, False):
        if numbers(e) and any(numbers(r) - numbers(e) for r in offered) and all(numbers(r) != numbers(e) for r in offered):
            continue
        for r in offered:
            x, y = e.full.replace(" ", ""), r.full.replace(" ", "")
            if e.version_type == r.version_type and x == y:
                return 1.0
            if agree(e, r):
                best = max(best, SequenceMatcher(None, e.base, r.base).ratio())
            elif r.version_type is None and e.version and y.endswith(e.version.replace(" ", "")):
                ratio = 1.0 if x == y else SequenceMatcher(None, e.full, r.full).ratio()
                best = max(best, ratio if ratio >= 0.9 else 0)
    return best


def made_up(rng):
    words = ["night", "coast", "boat", "2", "9", "lamp", "by", "day"]
    title = " ".join(rng.choices(words, k=rng.randint(1, 3)))
    version = rng.choice(["", "", " (Live)", " (Ann Remix)", " (Bob Remix)", " (Demo)", " (Live in Oslo)", " [FLAC]", " (2009 Remaster)", " Ann Remix"])
    head = rng.choice(["", "03 - ", "03 ", "3 ", "Artist - ", "A1. ", "1-03 "])
    return title + version, head + title + rng.choice([version, version, " (Live)", "", " - Album Version"]) + rng.choice([".mp3", ".flac", ""])


def test_scores_equal_a_loop_over_readings(spark):
    rng = random.Random(1)
    made = [made_up(rng) for _ in range(60)]
    pairs = [(t, n) for t, _ in made[:25] for _, n in made[:40] if not grammar.lone(t, False)]
    got = readings.match_scores(spark.createDataFrame(pairs, "title string, name string"), "title", "name").collect()
    assert len(got) == len(set(pairs)) and {(r.title, r.name): round(r.score, 9) for r in got} == {p: round(plain_score(*p), 9) for p in set(pairs)}


def test_any_reading_meets_any_other(spark):
    rng = random.Random(2)
    made = [made_up(rng) for _ in range(80)]
    titles, names = spark.createDataFrame([(t,) for t, _ in made] + [(None,)], "t string"), spark.createDataFrame([(n,) for _, n in made] + [("",)], "n string")
    got = {(r.title, r.name): (r.e_reading, r.r_reading) for r in readings.same_titles(titles, "t", names, "n").collect()}
    want = {}
    for t in {t for t, _ in made}:
        for n in {n for _, n in made}:
            for e in grammar.readings(t, False):
                for r in grammar.readings(n, True):
                    if e.version_type == r.version_type and e.full.replace(" ", "") == r.full.replace(" ", ""):
                        want.setdefault((t, n), (e.title, r.title))
    assert got == want and len(want) > 50


@pytest.mark.parametrize("seed", range(2))
def test_masked_titles_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    words = ["my", "blue", "blur", "boat", "black", "b", "9"]

    def hide(word):
        n = rng.randint(2, 3)
        if len(word) < 4 or rng.random() < 0.5:
            return word
        return word[0] + "X" * n + word[1 + n :] if rng.random() < 0.5 else word[0] + "*" * (len(word) - 2) + word[-1]

    names = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(80)]
    titles = list({" ".join(map(hide, rng.choice(names).split())) for _ in range(60)}) + ["star*", "XXXX", None]
    masked = readings.masked_titles(spark.createDataFrame([(t,) for t in titles], "t string"), "t")
    got = {(r.title, r.name) for r in readings.masked_matches(masked, readings.parsed(spark.createDataFrame([(n,) for n in names], "n string"), "n", False)).collect()}

    def pattern(title):
        parts = [re.sub(r"(?<=[a-z])(X{2,}|\*+(?=[a-z]))", lambda m: f"[a-z]{{{len(m[0])}}}", w) for w in title.split()]
        return re.compile(" ".join(parts)) if "[" in "".join(parts) else None

    want = {(t, n) for t in titles if t and (p := pattern(t)) for n in names if p.fullmatch(n)}
    assert got == want and len(want) > 20


def test_likeliest_alone(spark, monkeypatch):
    names = ["03 - A - Song (X Remix).mp3", "01-artist_1-large_gear-abc.mp3", "2 Of 9.flac", "A - b - LARGE Remix.mp3"]
    rows = spark.createDataFrame([(n,) for n in [*names, None, " "]], "name string")
    columns = ["name", "title", "base", "version_type", "version", "words"]
    every = {tuple(map(str, r)) for r in readings.parsed(rows, "name", True).filter("n = 0").select(columns).collect()}
    assert {tuple(map(str, r)) for r in readings.parsed(rows, "name", True, columns, likeliest=True).collect()} == every and len(every) == 4
    # no reading but the first is made
    read = []
    monkeypatch.setattr(grammar, "parts", lambda title: read.append(title) or title)
    assert [grammar.first_reading(n, True)[0] for n in names] == [grammar.titles(n, True)[0] for n in names] == read
