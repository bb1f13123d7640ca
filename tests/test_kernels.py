from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lacuna.functions.text import contiguous, filename_title, normalised, numerals, title_parts
from lacuna.operators.components import connected_components
from lacuna.operators.gaps import missing_numbers
from lacuna.operators.matching import greedy_assignment


def test_normalised():
    assert normalised("  Héllo,   WORLD! ") == "hello world"
    assert normalised("***") == "***"
    assert normalised("ひらがな") == normalised("ヒラガナ")
    assert normalised("ＡＢＣ") == "abc"
    assert normalised("十二") == "12"
    assert normalised(None) == ""


@given(st.text())
def test_normalised_is_stable_over_composition(text):
    import unicodedata

    assert normalised(unicodedata.normalize("NFC", text)) == normalised(unicodedata.normalize("NFD", text))


def test_numerals_and_names():
    assert numerals("movement ii") == "movement 2"
    assert numerals("civil mix") == "civil mix"
    assert [numerals(x) for x in ("I love you", "Part I", "Sonata (V)", "King Henry VIII", "X marks", "Vol. xx", "xxi")] == ["I love you", "Part 1", "Sonata (5)", "King Henry 8", "X marks", "Vol. 20", "xxi"]
    assert title_parts("Suite, Part II") == title_parts("Suite Part 2")
    assert filename_title("01 - Artist - Song.mp3") == "Song"
    assert filename_title("dir\\Song.flac") == "Song"
    assert title_parts("Dancing with You (Live at Home) [feat. Ann]") == ("dancing with you", ["live at home"], "ann")
    assert contiguous(["b", "c"], ["a", "b", "c"]) and not contiguous(["a", "c"], ["a", "b", "c"])


def test_missing_numbers(spark):
    held = spark.createDataFrame([(1, 1), (1, 3), (2, 1), (2, 2)], "k int, n int")
    assert [tuple(r) for r in missing_numbers(held, "k", "n").collect()] == [(1, 2)]


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (None, 1)], "a long, b long")
    found = {r.node: r.component for r in connected_components(links).collect()}
    assert found == {2: 2, 3: 2, 4: 2, 5: 2, 8: 8, 9: 8, 7: 7}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chain_of_links(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert connected_components(chain).agg(F.max("component")).first()[0] == 0


def test_greedy_assignment(spark):
    offers = spark.createDataFrame([("a", "x", 9), ("a", "y", 8), ("b", "x", 8), ("b", "z", 1), ("c", "y", 8)], "l string, r string, s int")
    assert sorted(tuple(r) for r in greedy_assignment(offers, "l", "r", "s").collect()) == [("a", "x", 9), ("b", "z", 1), ("c", "y", 8)]


def test_greedy_assignment_of_chains(spark):
    """A chain settles one pair after the other, in small parts and in large ones."""
    chain = [(f"a{i // 2}", f"x{(i + 1) // 2}", 100 - i) for i in range(17)]
    want, a, b = [], set(), set()
    for x, y, s in sorted(chain, key=lambda o: (-o[2], o[0], o[1])):
        if x not in a and y not in b:
            want.append((x, y, s))
            a.add(x)
            b.add(y)
    offers = spark.createDataFrame([*chain, ("a0", None, 500)], "l string, r string, s int")
    for most in (50_000, 0):
        assert sorted(tuple(r) for r in greedy_assignment(offers, "l", "r", "s", most).collect()) == sorted(want)


def test_greedy_assignment_of_many_pairs_in_one_round(spark, monkeypatch):
    from lacuna.operators import matching

    monkeypatch.setattr(matching, "connected_components", None)
    offers = spark.range(3_000).selectExpr("id as l", "id + 1 as r", "cast(id % 7 as int) as s")
    assert greedy_assignment(offers, "l", "r", "s").count() == 3_000
    closed = offers.union(offers.selectExpr("l", "r", "s - 10"))
    assert sorted(r.s for r in greedy_assignment(closed, "l", "r", "s").collect()) == sorted(i % 7 for i in range(3_000))
