"""Titles as sets of readings: each distinct name is parsed once, and any reading of one side may meet any of the other."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import readings as grammar
from lacuna.operators.lineage import written
from lacuna.operators.matching import matching_blocks_ratio

#: Beginnings of expected keys up to which all tasks get them. Decides on the plan, not on its result.
BEGINS = 200_000
#: What a title with masked letters scores against the one that spells them out, and what an unbracketed version needs.
MASKED, TAIL = 0.95, 0.90
#: Versions of one type agree from this similarity on.
AGREE = 0.75
# Words of a version that don't tell two of the type apart.
REMIX_WORDS = r"\b(remix|rmx|re-mix|flip|edit|bootleg|version|mix)\b"
TAKE_WORDS = r"\b(version|take|mix|live|acoustic|demo|rough|alt|alternate|alternative|unplugged|piano)\b"

_ROW = {
    "name": "string", "n": "int", "title": "string", "base": "string", "version_type": "string", "version": "string",
    "guests": "array<string>", "full": "string", "words": "array<string>", "lone": "string",
}


def parsed(names: DataFrame, name: str, filename: bool, columns: Sequence[str] = tuple(_ROW), likeliest: bool = False, begins: frozenset[str] | None = None) -> DataFrame:
    """name, n (0: the likeliest) and the parts of every reading of every distinct name; ``words`` are those of the whole
    title, ``lone`` its key if it could be a title that is a version's name. Null and empty names have no readings.

    Only the ``columns`` are made and leave Python; with ``likeliest`` only the likeliest title of a name is read, with
    ``begins`` none of which the key cannot begin so, see ``grammar.readings_from``."""
    whole = grammar.first_reading if likeliest else grammar.readings
    of = (lambda x: enumerate(whole(x, filename))) if begins is None else lambda x: grammar.readings_from(x, filename, begins)
    told = {"name": lambda x, n, r: x, "n": lambda x, n, r: n, "words": lambda x, n, r: grammar.title_key(r.title).split(), "lone": lambda x, n, r: grammar.lone(x, filename)}
    makers = [told.get(c) or (lambda x, n, r, c=c: getattr(r, c)) for c in columns]
    kinds = [pa.list_(pa.string()) if _ROW[c].startswith("array") else pa.int32() if _ROW[c] == "int" else pa.string() for c in columns]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(x, n, r) for x in batch.column(0).to_pylist() for n, r in of(x)]
            yield pa.RecordBatch.from_arrays([pa.array([make(*row) for row in rows], kind) for make, kind in zip(makers, kinds, strict=True)], list(columns))

    # a name takes longer to parse than to move, so names are dealt to as many tasks as a shuffle has
    dealt = names.select(F.col(name).alias("name")).filter("name is not null").repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name")
    return dealt.distinct().mapInArrow(run, ", ".join(f"{c} {_ROW[c]}" for c in columns))


def _compact(c: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), " ", "")


def _numbers(c: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\b(\d+)\b")), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))))


def _versions_agree(rows: DataFrame) -> DataFrame:
    """The rows with ``agree``: whether the versions of both sides (e_ and r_) are the same one."""
    e, r = F.col("e_version_type"), F.col("r_version_type")
    left, right = F.coalesce("e_version", F.lit("")), F.coalesce("r_version", F.lit(""))
    rest = lambda c, words: F.trim(F.regexp_replace(c, words, ""))
    mixes, takes = e.isin("remix", "mix_edit", "vip"), e.isin("acoustic", "live", "demo")
    named = (rest(left, REMIX_WORDS) != "") & (rest(right, REMIX_WORDS) != "")
    of = lambda c: F.when(mixes & named, rest(c, REMIX_WORDS)).when(takes, rest(c, TAKE_WORDS)).otherwise(c)
    told = rows.withColumns({"v": of(left), "w": of(right)})
    free = (left == "") | (right == "") | e.isin("instrumental", "acapella") | (takes & ((F.col("v") == "") | (F.col("w") == "")))
    inside = F.contains("v", "w") | F.contains("w", "v")
    open_ = e.eqNullSafe(r) & e.isNotNull() & ~free & ~inside
    ratio = matching_blocks_ratio("x", "y")
    told = told.withColumns({"x": F.when(open_, F.col("v")), "y": F.when(open_, F.col("w"))}).withColumn("ratio", ratio)
    agree = e.eqNullSafe(r) & (e.isNull() | free | inside | F.coalesce(F.col("ratio") >= AGREE, F.lit(False)))
    return told.withColumn("agree", agree).drop("v", "w", "x", "y", "ratio")


def _unmasks(masked: str, words: str) -> Column:
    """Whether words spell out a masked title: of the same lengths, equal where visible, letters where masked."""

    def word(m: Column, w: Column) -> Column:
        ends = F.split(m["seen"], " ")
        hidden = F.substring(w, F.length(ends[0]) + 1, m["length"] - F.length(ends[0]) - F.length(ends[1]))
        return F.when(m["hidden"], w.startswith(ends[0]) & w.endswith(ends[1]) & hidden.rlike("^[a-z]+$")).otherwise(m["seen"] == w) & (F.length(w) == m["length"])

    same = F.size(masked) == F.size(words)
    return same & F.forall(F.zip_with(masked, words, lambda m, w: F.coalesce(word(m, w), F.lit(False))), lambda ok: ok)


def masked_titles(titles: DataFrame, title: str) -> DataFrame:
    """title and masked (seen, hidden, length of each word) of the distinct titles that mask letters."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(x, m) for x in batch["title"] if (m := grammar.masked(x)) is not None]
            yield pd.DataFrame({"title": [x for x, _ in rows], "masked": [[{"seen": s, "hidden": h, "length": n} for s, h, n in m] for _, m in rows]})

    distinct = titles.select(F.col(title).alias("title")).filter(F.col(title).rlike(r"X{2}|\*")).distinct()
    return distinct.mapInPandas(run, "title string, masked array<struct<seen string, hidden boolean, length int>>")


def _anchor(shape: Column, place: Column, word: Column) -> Column:
    return F.struct(shape.alias("shape"), place.cast("int").alias("place"), word.alias("word"))


def masked_matches(masked: DataFrame, offered: DataFrame) -> DataFrame:
    """title and name of every offered reading (name, words) that spells out a masked title.

    A wildcard index: a masked title is posted once, under the lengths of its words and its longest visible word with its
    place, or under the first letter of its first word where no word is visible. Offered titles of a shape that some masked
    title has are looked up under each of their words, so no title meets all others; what meets is verified letter by letter.
    """
    lengths = F.transform("masked", lambda m: m["length"])
    places = F.transform("masked", lambda m, i: F.struct(F.when(m["hidden"], -1).otherwise(m["length"]).alias("size"), (-i).alias("at"), m["seen"].alias("seen")))
    best = F.array_max(places)
    posted = masked.withColumn("best", best).select(
        "title", "masked", _anchor(lengths, F.when(F.col("best.size") > 0, -F.col("best.at")).otherwise(-1), F.when(F.col("best.size") > 0, F.col("best.seen")).otherwise(F.substring(F.col("masked")[0]["seen"], 1, 1))).alias("anchor")
    )
    shape = F.transform("words", F.length)
    found = offered.select("name", "words").filter(F.size("words") > 0).distinct().withColumn("shape", shape)
    found = found.join(posted.select(F.col("anchor.shape").alias("shape")).distinct(), "shape", "left_semi")
    looked = F.concat(F.array(_anchor(F.col("shape"), F.lit(-1), F.substring(F.col("words")[0], 1, 1))), F.transform("words", lambda w, i: _anchor(F.col("shape"), i, w)))
    met = found.select("name", "words", F.explode(looked).alias("anchor")).join(posted, "anchor")
    return met.filter(_unmasks("masked", "words")).select("title", "name").distinct()


def same_titles(expected: DataFrame, title: str, offered: DataFrame, name: str) -> DataFrame:
    """title, name, e_reading and r_reading of every pair of names of which some readings are the same title in the same
    version; the likeliest readings of those (of the expected title first) are given.

    Readings meet by version type and key without spaces, so no pair is formed that does not match.
    """
    side = lambda rows, p: rows.select(F.col("name").alias(p), F.struct("n", "title").alias(f"{p}_reading"), F.coalesce("version_type", F.lit("")).alias("kind"), _compact("full").alias("key"))
    columns = ["name", "n", "title", "version_type", "full"]
    # expected titles are written, so that Spark knows whether they are few enough to go to the files
    e = written(side(parsed(expected, title, False, columns), "e"))
    # readings of files are not taken apart where no expected key begins like them, as long as these beginnings are few
    begins = e.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(grammar.BEGIN)), lambda i: F.substr("key", F.lit(1), i))).alias("b")).distinct().limit(BEGINS + 1).collect()
    r = side(parsed(offered, name, True, columns, begins=frozenset(x.b for x in begins) if len(begins) <= BEGINS else None), "r")
    best = e.join(r, ["kind", "key"]).groupBy("e", "r").agg(F.min(F.struct("e_reading", "r_reading")).alias("best"))
    return best.select(F.col("e").alias("title"), F.col("r").alias("name"), F.col("best.e_reading.title").alias("e_reading"), F.col("best.r_reading.title").alias("r_reading"))


def match_scores(pairs: DataFrame, title: str, name: str, filename: bool = True) -> DataFrame:
    """title, name and score (0 to 1) of each distinct pair: the best similarity of any reading of one to any of the other.

    Readings count whose versions agree, or where an unbracketed tail is the version; an expected reading whose numbers no
    offered one has, while some has others, does not count. A title that is a version's name meets a last field of that name.
    A title that masks letters scores ``MASKED`` against one that spells them out. Pairs with a null are left out.
    """
    asked = pairs.select(F.col(title).alias("title"), F.col(name).alias("name")).na.drop().distinct()
    side = lambda rows, p, key: rows.select([F.col(c).alias(key if c == "name" else f"{p}_{c}") for c in rows.columns])
    offered = parsed(asked, "name", filename)
    rows = asked.join(side(parsed(asked, "title", False), "e", "title"), "title").join(side(offered, "r", "name"), "name")
    rows = rows.withColumns({"e_numbers": _numbers("e_base"), "r_numbers": _numbers("r_base"), "e_compact": _compact("e_full"), "r_compact": _compact("r_full"), "tail": _compact("e_version")})
    per = Window.partitionBy("title", "name", "e_n")
    others = F.max(F.size(F.array_except("r_numbers", "e_numbers")) > 0).over(per)
    same = F.max(F.col("r_numbers") == F.col("e_numbers")).over(per)
    rows = rows.withColumns({"others": others, "same": same}).filter((F.size("e_numbers") == 0) | ~F.col("others") | F.col("same"))
    rows = _versions_agree(rows)
    equal = F.col("e_compact") == F.col("r_compact")
    tailed = ~F.col("agree") & F.col("r_version_type").isNull() & (F.col("tail") != "") & F.col("r_compact").endswith(F.col("tail"))
    rows = rows.withColumns({"x": F.when(F.col("agree"), F.col("e_base")).when(tailed, F.col("e_full")), "y": F.when(F.col("agree"), F.col("r_base")).when(tailed, F.col("r_full")), "tailed": tailed})
    rows = rows.withColumn("ratio", matching_blocks_ratio("x", "y"))
    told = F.when(F.col("tailed") & (F.col("ratio") < TAIL), 0.0).otherwise(F.col("ratio"))
    whole = (equal & (F.col("e_version_type").eqNullSafe(F.col("r_version_type")) | F.col("tailed"))) | (F.lit(filename) & (F.col("e_lone") == F.col("r_lone")))
    best = rows.groupBy("title", "name").agg(F.max(F.when(whole, 1.0).otherwise(F.coalesce(told, F.lit(0.0)))).alias("score"))
    hidden = masked_titles(asked, "title")
    spelled = asked.join(hidden, "title").join(offered.select("name", "words"), "name").filter(_unmasks("masked", "words")).select("title", "name").distinct().withColumn("spelled", F.lit(MASKED))
    found = asked.join(best, ["title", "name"], "left").join(spelled, ["title", "name"], "left")
    return found.select("title", "name", F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce("spelled", F.lit(0.0))).alias("score"))
