"""Audit of releases: official tracks against held files, one to one, in passes of falling certainty.

Official rows have release_id, seq, disc_number, track_position, absolute_position, token, title, alt_titles, track_id and
recording_id; held rows have release_id, seq, path, disc_number, number, title, track_ids and recording_ids. ``seq`` is the
order within a release and breaks ties. All releases are audited in one job; offers are joined on a release together with
an id, a position or two letters of a title, never on the release alone.

Versions of titles agree as in ``readings``: a remaster is no version, two remixes of one name are one. Null titles match nothing; a held row without title
or number is an extra; a release without official rows has no audit; a release without held rows misses all its tracks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators import readings
from lacuna.operators.lineage import written
from lacuna.operators.matching import greedy_assignment, matching_blocks_ratio

#: Least similarity at the file's own position, and elsewhere.
AT_POSITION, ELSEWHERE = 0.70, 0.85


def _key(kind: str, *parts: Column) -> Column:
    """One text for a position; null where a part is null."""
    filled = F.lit(True)
    for p in parts:
        filled = filled & p.isNotNull()
    return F.when(filled, F.concat_ws("|", F.lit(kind), *[p.cast("string") for p in parts]))


def _sort(key: Column) -> Column:
    return F.substring_index(key, "|", 1)


def _keys(*keys: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*keys)))


def official_positions(official: DataFrame) -> DataFrame:
    """Adds ``keys``: place on the medium, place on the whole release, printed number, and side with number."""
    disc = F.coalesce(F.col("disc_number"), F.lit(1))
    token = F.upper(F.trim("token"))
    printed = F.when(token.rlike("^[0-9]+$"), F.expr("try_cast(trim(token) as int)"))
    side = F.when(token.rlike("^[A-Z][0-9]+$"), F.substring(token, 1, 1))
    on_side = F.when(side.isNotNull(), F.expr("try_cast(substring(trim(token), 2) as int)"))
    return official.withColumn("keys", _keys(_key("medium", disc, F.col("track_position")), _key("absolute", F.col("absolute_position")), _key("medium", disc, printed), _key("side", side, on_side)))


def held_positions(held: DataFrame) -> DataFrame:
    """Adds ``keys``; a release whose files carry no disc number is numbered through, so its numbers are absolute as well."""
    number = F.when(F.col("number") > 0, F.col("number"))
    medium = _key("medium", F.coalesce("disc_number", F.lit(1)), number)
    own, other = held.filter("disc_number is not null"), held.filter("disc_number is null")
    # only releases of files without a disc number are looked up
    tagged = own.join(other.select("release_id").distinct(), "release_id", "left_semi").select("release_id").distinct().withColumn("tagged", F.lit(True))
    rest = other.join(tagged, "release_id", "left").withColumn("keys", _keys(medium, F.when(F.col("tagged").isNull(), _key("absolute", number)))).drop("tagged")
    return own.withColumn("keys", _keys(medium)).unionByName(rest)


def _bases(rows: DataFrame, title: str, titles: DataFrame) -> DataFrame:
    return rows.join(titles.withColumnRenamed("name", title), title)


def _parsed(titles: DataFrame) -> DataFrame:
    """name, base, version_type and version of each distinct title that has a base."""
    return readings.parsed(titles.filter("title <> ''"), "title", False, ["name", "base", "version_type", "version"], likeliest=True).filter("base <> ''")


def _blocks(titles: DataFrame) -> DataFrame:
    """Two letters in a row that a base title has: titles alike by 0.85 share some, or are equal."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("base") - 1, F.lit(1))), lambda i: F.substring(F.col("base"), i, F.lit(2)))
    return titles.withColumn("block", F.explode(F.array_distinct(grams)))


def _scored(pairs: DataFrame) -> DataFrame:
    """Each pair with the score of its titles (o_title, h_title): bases equal, likeness of the bases. Pairs of which versions
    differ, and titles without a base, are left out. Distinct titles are parsed and distinct pairs of them compared once."""
    both = written(pairs.select("o_title", "h_title").distinct())
    titles = written(_parsed(both.select(F.col("o_title").alias("title")).union(both.select("h_title"))))
    side = lambda p: titles.select(F.col("name").alias(f"{p}_title"), *[F.col(c).alias(f"{p}_{c}") for c in ("base", "version_type", "version")])
    of = both.join(side("o").withColumnsRenamed({"o_version_type": "e_version_type", "o_version": "e_version"}), "o_title")
    of = of.join(side("h").withColumnsRenamed({"h_version_type": "r_version_type", "h_version": "r_version"}), "h_title")
    agreed = readings._versions_agree(of).filter("agree").withColumn("equal", F.col("o_base") == F.col("h_base"))
    agreed = agreed.withColumns({"x": F.when(~F.col("equal"), F.col("o_base")), "y": F.when(~F.col("equal"), F.col("h_base"))})
    likeness = F.when(F.col("equal"), 1.0).otherwise(F.coalesce("ratio", F.lit(0.0)))
    told = agreed.withColumn("ratio", matching_blocks_ratio("x", "y", once=True)).select("o_title", "h_title", F.struct("equal", likeness.alias("likeness")).alias("score"))
    return pairs.join(written(told), ["o_title", "h_title"]).drop("o_title", "h_title")


def matched(official: DataFrame, held: DataFrame) -> DataFrame:
    """release_id, o and h (seq of either end) and the pass that joined them: ids, position or title.

    Both tables are read several times. What passes leave is looked up by its numbers, and titles are compared elsewhere only
    in releases in which both sides have some left."""
    o = official_positions(official).withColumnRenamed("seq", "o")
    o = o.withColumn("titles", F.array_distinct(F.array_compact(F.concat(F.array("title"), F.coalesce("alt_titles", F.array().cast("array<string>"))))))
    h = held_positions(held).withColumnRenamed("seq", "h")
    ends, of_o, of_h = ["release_id", "o", "h"], ["release_id", "o"], ["release_id", "h"]
    free = lambda rows, taken, end: rows.join(taken.select(*end), end, "left_anti")
    settled = lambda offers, how: written(greedy_assignment(offers, "o", "h", "score", within="release_id").select(*ends, F.lit(how).alias("pass")))

    # only sorts of keys that files have are dealt, and a pair comes from the first key that both have, so no table of pairs is
    # kept to find repeats; an end with one key meets once
    sorts = [r.sort for r in h.select(F.explode(F.transform("keys", _sort)).alias("sort")).distinct().collect()]
    o_keys = o.select(*of_o, "titles", F.filter("keys", lambda k: _sort(k).isin(sorts)).alias("keys"))
    several = F.when(F.size("keys") > 1, F.col("keys"))
    by_key = o_keys.select(*of_o, "titles", several.alias("o_keys"), F.explode("keys").alias("key")).join(h.select(*of_h, "title", several.alias("h_keys"), F.explode("keys").alias("key")), ["release_id", "key"])
    at = written(by_key.filter(F.coalesce(F.col("key") == F.array_intersect("o_keys", "h_keys")[0], F.lit(True))).select(*ends, "titles", "title"))
    placed = lambda pairs: pairs.join(at.join(pairs.select(*ends).distinct(), ends, "left_semi").select(*ends, F.lit(True).alias("at")), ends, "left")
    by_track = written(o.select(*of_o, F.col("track_id").alias("id")).filter("id is not null").join(h.select(*of_h, F.explode("track_ids").alias("id")), ["release_id", "id"]).select(*ends).distinct())
    named = by_track.select(*of_h).distinct()
    by_recording = o.select(*of_o, F.col("recording_id").alias("id")).filter("id is not null").join(h.select(*of_h, F.explode("recording_ids").alias("id")), ["release_id", "id"]).select(*ends).distinct()
    by_recording = written(free(by_recording, named, of_h).select(*ends))
    recorded = placed(by_recording)
    # A repeated recording goes to the position that its file carries, where one of its tracks has that position.
    somewhere = recorded.filter("at").select(*of_h).distinct().withColumn("somewhere", F.lit(True))
    recorded = recorded.join(somewhere, of_h, "left").filter("at or somewhere is null").select(*ends, F.lit(0).alias("track"))
    ids = placed(written(by_track.withColumn("track", F.lit(1)).union(recorded)))
    first = settled(ids.select(*ends, F.struct("track", F.coalesce("at", F.lit(False)).alias("at")).alias("score")), "ids")

    # A file whose ids name a track or recording of the release is no other track's.
    known = written(named.union(by_recording.select(*of_h)).distinct())
    left = free(free(free(at, first, of_o), first, of_h), known, of_h)
    untitled = F.coalesce(F.trim("title").rlike("^[0-9]*$"), F.lit(True))
    near = left.filter(~untitled).select(*ends, F.explode("titles").alias("o_title"), F.col("title").alias("h_title")).filter("o_title <> ''")
    bare = left.filter(untitled).select(*ends, F.struct(F.lit(True).alias("equal"), F.lit(1.0).alias("likeness")).alias("score"))
    second = settled(_scored(near).filter(F.col("score.likeness") >= AT_POSITION).select(*ends, "score").unionByName(bare), "position")

    done = first.union(second)
    spare = written(free(free(free(h.filter(~untitled).select(*of_h), first, of_h), second, of_h), known, of_h))
    theirs = written(h.join(spare, of_h, "left_semi").select(*of_h, F.col("title").alias("h_title")))
    missed = o.join(theirs.select("release_id").distinct(), "release_id", "left_semi").select(*of_o, F.explode("titles").alias("o_title"))
    ours = written(free(free(missed, first, of_o), second.join(theirs.select("release_id").distinct(), "release_id", "left_semi"), of_o))
    titles = written(_parsed(ours.select(F.col("o_title").alias("title")).union(theirs.select("h_title"))))
    letters = _blocks(titles.select("name", "base")).select("name", "block")
    blocked = _bases(ours, "o_title", letters).join(_bases(theirs, "h_title", letters), ["release_id", "block"]).select(*ends, "o_title", "h_title").distinct()
    far = placed(written(_scored(written(blocked)).filter(F.col("score.likeness") >= ELSEWHERE).select(*ends, "score")))
    facts = far.join(h.join(spare, of_h, "left_semi").select(*of_h, (F.coalesce("number", F.lit(0)) > 0).alias("numbered"), F.col("disc_number").alias("h_disc")), of_h)
    facts = facts.join(o.join(ours.select(*of_o).distinct(), of_o, "left_semi").select(*of_o, F.coalesce("disc_number", F.lit(1)).alias("disc")), of_o)
    # A numbered file at another position needs the very title; a file tagged with another disc is another track.
    fits = facts.filter("at or ((not numbered or score.equal) and (h_disc is null or h_disc = disc))").select(*ends, "score")
    return done.union(settled(fits, "title"))


def audit_tracks(official: DataFrame, held: DataFrame) -> DataFrame:
    """Every official track, found or missing, and every held row that no track took, as an extra."""
    pairs = matched(official, held)
    files = held.select("release_id", F.col("seq").alias("h"), "title", "path").join(pairs, ["release_id", "h"], "left")
    found = official.select("release_id", F.col("seq").alias("o"), "title").join(files.filter("o is not null").select("release_id", "o", "pass", "path"), ["release_id", "o"], "left")
    found = found.select("release_id", F.col("o").cast("long").alias("seq"), "title", F.when(F.col("pass").isNull(), "missing").otherwise("found").alias("status"), F.lit(False).alias("is_extra"), "pass", "path")
    spare = files.filter("o is null").join(official.select("release_id").distinct(), "release_id", "left_semi")
    extra = spare.select("release_id", F.col("h").cast("long").alias("seq"), "title", F.lit("found").alias("status"), F.lit(True).alias("is_extra"), F.lit(None).cast("string").alias("pass"), "path")
    return found.unionByName(extra)


def audit_releases(tracks: DataFrame) -> DataFrame:
    """Figures of each release over its official tracks; unverified where files are held and not one is on the tracklist."""
    own = ~F.col("is_extra")
    per = tracks.groupBy("release_id").agg(F.count_if(own).alias("expected"), F.count_if(own & (F.col("status") == "found")).alias("found"), F.count_if("is_extra").alias("extras"))
    missing = F.col("expected") - F.col("found")
    status = F.when((F.col("found") == 0) & (F.col("extras") > 0), "unverified").when(missing > 0, "has_missing").otherwise("complete")
    percent = F.when(F.col("expected") == 0, 100.0).otherwise(F.bround(F.col("found") * 100 / F.col("expected"), 1))
    return per.select("release_id", "expected", "found", missing.alias("missing"), "extras", percent.alias("percent"), status.alias("status"))
