"""Linkage of an inventory with the catalogues of artists, in four tiers of falling certainty.

Catalogue rows have seq (their order), artist_id, release, releases (other titles it is on), title, track_number,
recording_ids, track_ids and release_id. Artists have artist_id and alias. Held rows have path, artists, album_artist, album,
title, track_number, recording_ids, track_ids and release_ids. Each catalogue row in its turn takes the first free path, tier
after tier; what is taken leaves both sides.

1. ``recording`` and ``track``: a held id is the row's, whichever of the two.
2. ``release``: the title is the same and the release is confirmed: by an album that is alike by more than ``ALBUM`` or a
   folder that names it, unless the file credits only others and the album is not alike by ``OWN_ALBUM``. A file that has only
   a number needs the number and the release (``number``).
3. ``artist``: an alias stands in the tags or the path, and the title is the same.
4. ``fuzzy``: an alias, or the release by album or folder; titles alike by ``FUZZY`` or more, with or without their versions.

Titles are the same if their versions agree, their bases are equal or alike by more than ``TITLE``, no numbers in them differ
and, where the bases differ, no track numbers. Evidence is found first, by joins on words in a row; titles meet only within
an artist or a release that has evidence, by their rarest pairs of letters, so neither is a join of all rows of an artist,
and a file of an album meets no artist of whom it has no title. Tags, albums, folders and titles are looked up once for all
files that share them. Albums of files without a trace of the artist are compared with releases that share a word with them.

Rows without seq or path take no part; null and empty titles match nothing but by ids; names without letters, digits or
symbols are no evidence; repeated paths are one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import readings as grammar
from lacuna.functions.text import NUMBERED_VALUES
from lacuna.operators import allocation, naming, readings
from lacuna.operators.likeness import like_pairs
from lacuna.operators.lineage import written as _write
from lacuna.operators.matching import matching_blocks_ratio

#: Least likeness of an album (exclusive), of one that needs no artist, of a title (exclusive), of a fuzzy title.
ALBUM, OWN_ALBUM, TITLE, FUZZY = 0.7, 0.9, 0.9, 0.85
#: Names that credit nobody.
NOBODY = "various artists|various|va|v.a.|v.a|v. a.|v a|v/a|compilation|compilations|unknown artist"

#: First words of aliases up to which a path is looked through for these before it is searched.
FIRSTS = 64

#: Written tables take some ten times the memory once they are read: columns of titles and paths repeat and compress well.
COMPRESSED = 10.0


def written(df: DataFrame) -> DataFrame:
    """As a table, planned by what its sources take in memory, so that only tables that are small there are broadcast."""
    conf, factor = df.sparkSession.conf, "spark.sql.sources.fileCompressionFactor"
    before = conf.get(factor)
    conf.set(factor, str(max(COMPRESSED, float(before))))
    try:
        return _write(df)
    finally:
        conf.set(factor, before)


def _keyed(values: DataFrame, column: str) -> DataFrame:
    """The rows with the key of a column's text."""

    @F.pandas_udf("string")
    def keyed(s):
        return s.map(grammar.title_key)

    # not deterministic to Spark, or it would move filters on keys to where values are not distinct yet
    return values.withColumn("key", keyed.asNondeterministic()(column))


def _keys(values: DataFrame, column: str) -> DataFrame:
    """value and key of each distinct value that has a key."""
    # a key takes longer to make than a value to move, so distinct values are dealt to as many tasks as a shuffle has
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = values.select(F.col(column).alias("value")).filter("value is not null").distinct().repartition(tasks, F.xxhash64("value"))
    return _keyed(some, "value").filter("key <> ''")


def _words(keys: DataFrame, name: str) -> DataFrame:
    return keys.select(F.col("key").alias(name), naming.words("key").alias("words")).distinct()


def _named(keys: DataFrame, aliases: DataFrame) -> DataFrame:
    """value and artist_id where an alias stands in the value."""
    found = naming.find_names(_words(keys, "text_id"), _words(aliases, "name_id")).select(F.col("text_id").alias("key"), F.col("name_id").alias("alias_key")).distinct()
    return keys.join(found, "key").join(aliases.select(F.col("key").alias("alias_key"), "artist_id"), "alias_key").select("value", "artist_id").distinct()


def _on_paths(paths: DataFrame, aliases: DataFrame) -> DataFrame:
    """path and artist_id where an alias stands in a path; each path is given once, so paths stay where they are.

    Keys of ASCII paths without a word of the letters I, V and X need no numerals and are made by Spark, others by the grammar."""
    path = F.col("path")
    plain = (F.octet_length(path) == F.length(path)) & path.rlike("[a-zA-Z0-9]") & ~path.rlike(r"(?i)\b[ivx]+\b")
    key = F.trim(F.regexp_replace(F.lower(F.replace(path, F.lit("&"), F.lit(" and "))), "[^a-z0-9]+", " "))
    keys = paths.filter(plain).select("path", key.alias("key")).union(_keyed(paths.filter(~plain), "path"))
    texts = keys.select(F.col("path").alias("text_id"), naming.words("key").alias("words"))
    # where aliases begin with few words, paths without any of these are not searched
    first = aliases.select(naming.words("key")[0].alias("word")).filter("word is not null").distinct().limit(FIRSTS + 1).collect()
    if len(first) <= FIRSTS:
        texts = texts.filter(F.arrays_overlap("words", F.array(*[F.lit(r.word) for r in first]).cast("array<string>")))
    found = naming.find_names(texts, _words(aliases, "name_id")).select(F.col("text_id").alias("path"), F.col("name_id").alias("key"))
    return found.join(aliases, "key").select("path", "artist_id")


def _traced(h: DataFrame, artists: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The held rows with the artists by track artists or path (``narrow``); and by these, the album artist or the id of a
    release (``wide``), and whether the tags credit anybody. Tags are looked up once for all files that have the same."""
    aliases = written(artists.select("artist_id", "alias").join(_keys(artists, "alias").withColumnRenamed("value", "alias"), "alias").select("artist_id", "key").distinct())
    tags = written(h.select("tag").distinct())
    credit, album_artist = F.explode("tag.artists"), F.col("tag.album_artist")
    told = written(_named(_keys(tags.select(credit.alias("value")).union(tags.select(album_artist.alias("value"))), "value"), aliases))
    of = lambda value, narrow: tags.select("tag", value.alias("value")).join(told, "value").select("tag", "artist_id", F.lit(narrow).alias("narrow"))
    ids = tags.select("tag", F.explode("tag.release_ids").alias("release_id")).join(catalogue.select("release_id", "artist_id").na.drop().distinct(), "release_id").select("tag", "artist_id", F.lit(False))
    names = F.concat(F.coalesce("tag.artists", F.array()), F.array("tag.album_artist"))
    credited = F.exists(names, lambda x: F.coalesce((F.trim(x) != "") & ~F.lower(F.trim(x)).rlike(f"^(?:{NOBODY.replace('.', chr(92) + '.')})$"), F.lit(False)))
    by_tag = of(credit, True).union(of(album_artist, False)).union(ids).groupBy("tag").agg(F.collect_set(F.when(F.col("narrow"), F.col("artist_id"))).alias("tag_narrow"), F.collect_set("artist_id").alias("tag_wide"))
    by_path = _on_paths(h.select("path"), aliases).groupBy("path").agg(F.collect_set("artist_id").alias("on_path"))
    rows = h.join(written(tags.withColumn("credited", credited).join(by_tag, "tag", "left")), "tag").join(written(by_path), "path", "left")
    all_ = lambda a, b: F.when(b.isNull(), a).when(a.isNull(), b).otherwise(F.array_union(a, b))
    return rows.withColumns({p: F.coalesce(all_(F.col(f"tag_{p}"), F.col("on_path")), F.array().cast(rows.schema["on_path"].dataType)) for p in ("narrow", "wide")}).drop("tag_narrow", "tag_wide", "on_path")


def _releases_of(h: DataFrame, titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """album, release_key and likeness; and folder and release_key: which releases an album or a folder may confirm. Both are
    found once for all files that share it; titles have artist_id, title and release_key."""
    folders = written(h.select(naming.folder("path").alias("folder")).filter("folder <> ''").distinct())
    folders = naming.named_by_folder(folders, titles)
    folders = folders.join(titles.select("title", "release_key").distinct(), "title").select("folder", "release_key").distinct()
    albums = written(_keys(h, "album").withColumnsRenamed({"value": "album", "key": "album_key"}))
    releases = titles.select("artist_id", "release_key").distinct()
    word = lambda c: F.explode(F.array_distinct(naming.words(c))).alias("word")
    sharing = albums.select("album_key").distinct().select("album_key", word("album_key")).join(releases.select("release_key").distinct().select("release_key", word("release_key")), "word")
    traced = h.select("album", F.explode("wide").alias("artist_id")).filter("album is not null").distinct().join(albums, "album").select("album_key", "artist_id").distinct()
    near = traced.join(releases, "artist_id").select("album_key", "release_key").union(sharing.select("album_key", "release_key")).distinct()
    like = near.withColumn("likeness", F.when(F.col("album_key") == F.col("release_key"), 1.0).otherwise(matching_blocks_ratio("release_key", "album_key", once=True))).filter(F.col("likeness") > ALBUM)
    return written(albums.join(like, "album_key").select("album", "release_key", "likeness")), written(folders)


def _parsed(names: DataFrame) -> DataFrame:
    """name, tagged, base, version_type, version, key and title_id of each distinct name; untagged names are those of files."""
    told = None
    for tagged in (True, False):
        some = readings.parsed(names.filter(F.col("tagged") == F.lit(tagged)), "name", not tagged, ["name", "base", "version_type", "version", "words"], likeliest=True)
        some = some.select("name", F.lit(tagged).alias("tagged"), "base", "version_type", "version", F.array_join("words", " ").alias("title_key"))
        some = some.withColumn("title_id", F.xxhash64("base", "version_type", "version", "title_key", F.col("version").isNull()))
        told = some if told is None else told.union(some)
    return told


def _numbers(key: str) -> Column:
    values = F.create_map(*[F.lit(x) for pair in NUMBERED_VALUES.items() for x in pair])
    numbers = F.transform(naming.words(key), lambda w: F.coalesce(F.try_element_at(values, w), F.when(w.rlike("^[0-9]+$"), F.regexp_replace(w, "^0+(?=.)", ""))))
    return F.filter(numbers, lambda n: n.isNotNull())


def _differ(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & (a != b)


def _number(c: str, whole: bool = False) -> Column:
    """The digits of a track number behind its last slash and dash, without zeros in front; of all of it where none are there."""
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")
    last = digits(F.regexp_extract(F.col(c), "([^/-]*)$", 1))
    found = F.when(last != "", last).otherwise(digits(F.col(c))) if whole else last
    return F.nullif(F.regexp_replace(found, "^0+(?=.)", ""), F.lit(""))


def _only_number(stem: Column) -> Column:
    """Whether a held row names its track by a number alone."""
    title, bare = F.coalesce(F.trim("title"), F.lit("")), r"(?i)^(?:track|trk)[\s._\-]*\d{1,3}$"
    return ((stem.rlike(r"^\d+$") | stem.rlike(bare)) & ((title == "") | title.rlike(r"^\d+$") | title.rlike(bare))) | (title.rlike(r"^\d+$") & ~stem.rlike("[a-zA-Z]"))


def linked(catalogue: DataFrame, artists: DataFrame, held: DataFrame) -> DataFrame:
    """seq, path and method of every pair."""
    title, file_name = F.nullif(F.trim("title"), F.lit("")), F.substring_index(F.replace("path", F.lit("\\"), F.lit("/")), "/", -1)
    h = held.filter("path is not null").dropDuplicates(["path"]).withColumn("file_name", file_name).withColumn("stem", F.trim(F.regexp_replace("file_name", r"\.[^.]*$", "")))
    h = written(h.select(
        "path", F.struct("artists", "album_artist", "release_ids").alias("tag"), "album", "track_number", "recording_ids", "track_ids",
        F.coalesce(title, "file_name").alias("name"), title.isNotNull().alias("tagged"), _only_number(F.col("stem")).alias("bare"),
    ))
    c = written(catalogue.filter("seq is not null"))
    taken = None

    def settle(offers: DataFrame) -> None:
        nonlocal taken
        if taken is not None:
            offers = offers.join(taken.select("path"), "path", "left_anti")
        got = allocation.allocate(offers, ["seq"], ["path"], [F.col("seq"), F.col("path"), F.col("method")]).select("seq", "path", "method")
        taken = written(got if taken is None else taken.union(got))

    def free(rows: DataFrame) -> DataFrame:
        return rows.join(taken.select("seq"), "seq", "left_anti")

    offers = None
    for method, ids in (("recording", "recording_ids"), ("track", "track_ids")):
        some = c.select("seq", F.explode(ids).alias("id")).join(h.select("path", F.explode(ids).alias("id")), "id").select("seq", "path", F.lit(method).alias("method"))
        offers = some if offers is None else offers.union(some)
    settle(offers)

    # what an album or a folder may name comes from the whole catalogue, titles only from rows that are still free
    on = c.filter("artist_id is not null").select("seq", "artist_id", F.explode(F.array_compact(F.array_distinct(F.concat(F.array("release"), F.coalesce("releases", F.array()))))).alias("title"), (F.col("title") == F.col("release")).alias("main"))
    on = written(on.join(_keys(on, "title").withColumnsRenamed({"value": "title", "key": "release_key"}), "title"))
    traced = _traced(h, artists, c)
    albums, folders = _releases_of(traced, on.select("artist_id", "title", "release_key").distinct())
    by_artist = traced.select("path", "name", "tagged", "bare", "track_number", F.explode("narrow").alias("artist_id"))
    told = ["path", "name", "tagged", "bare", "track_number", "credited", "wide", "release_key", "likeness", "folder"]
    by_album = traced.join(albums, "album").withColumn("folder", F.lit(False)).select(*told)
    by_folder = traced.withColumn("at", naming.folder("path")).join(folders.withColumnRenamed("folder", "at"), "at").withColumn("likeness", F.lit(0.0)).withColumn("folder", F.lit(True)).select(*told)
    by_release = by_album.union(by_folder)

    names = ["name", "tagged"]
    scopes = by_artist.select(F.lit(False).alias("by_release"), F.col("artist_id").cast("string").alias("scope"), *names).union(by_release.select(F.lit(True), "release_key", *names)).distinct()
    scopes = written(scopes)
    r = written(scopes.join(_parsed(scopes.select(*names).distinct()), names))
    open_ = written(free(c).select("seq", "artist_id", "track_number", title.alias("name"), F.lit(True).alias("tagged")))
    open_ = written(open_.join(_parsed(open_), names).drop(*names))
    releases = free(on.select("seq", "artist_id", "release_key", "main").distinct())
    e = open_.filter("artist_id is not null").withColumn("scope", F.col("artist_id").cast("string")).select(F.lit(False).alias("by_release"), "*", F.lit(None).cast("boolean").alias("main"))
    e = written(e.union(open_.drop("artist_id").join(releases, "seq").withColumn("scope", F.col("release_key")).select(F.lit(True), *[c for c in e.columns[1:]])))
    at = ["by_release", "scope"]
    named = _titles(e, r).join(r.select(*at, F.col("title_id").alias("r_title_id"), *names), [*at, "r_title_id"])
    named = named.join(e.select(*at, F.col("title_id").alias("e_title_id"), "seq", "artist_id", "main", _number("track_number").alias("e_number")), [*at, "e_title_id"])
    named = written(named.drop("e_title_id", "r_title_id"))

    # whether two titles with no number in common may be one: their bases are equal or a track number is not told
    tracks = F.col("same_base") | F.coalesce(F.col("e_number") == _number("track_number"), F.lit(True))
    other = F.col("credited") & ~F.array_contains("wide", F.col("artist_id"))
    sure, first = (F.col("likeness") >= OWN_ALBUM) | ~other, F.col("main") & ((F.col("likeness") == 1.0) | (F.col("folder") & ~other))

    def of_artists(some: DataFrame) -> DataFrame:
        some = some.filter("not by_release").withColumnRenamed("scope", "artist_key").drop("artist_id")
        return by_artist.withColumn("artist_key", F.col("artist_id").cast("string")).join(some, ["artist_key", *names]).filter(tracks)

    def of_releases(some: DataFrame) -> DataFrame:
        return by_release.join(some.filter("by_release").withColumnRenamed("scope", "release_key"), ["release_key", *names]).filter(tracks)

    # by text or by number; a release meets only files of the same one, never all of its own
    c_numbers = open_.filter("base <> ''").select("seq", F.lower(F.trim("track_number")).alias("text"), _number("track_number", True).alias("number")).filter("text <> ''")
    bare = by_release.filter("bare").withColumn("n", F.coalesce("track_number", F.regexp_replace(file_name, r"\.[^.]*$", ""))).withColumns({"text": F.lower(F.trim("n")), "number": _number("n", True)})
    either = F.explode(F.array_compact(F.array(F.concat(F.lit("text "), "text"), F.concat(F.lit("number "), "number")))).alias("at")
    numbered = releases.join(c_numbers.select("seq", either), "seq").join(bare.select("path", "credited", "wide", "release_key", "likeness", "folder", either), ["release_key", "at"])
    exact = of_releases(named.filter("same"))
    settle(exact.filter(sure).select("seq", "path", F.lit("release").alias("method")).union(numbered.filter(sure).select("seq", "path", F.lit("number"))))
    settle(of_artists(written(free(named.filter("same and not by_release")))).select("seq", "path", F.lit("artist").alias("method")))
    fuzzy = written(free(named.filter("best is not null")))
    rows = of_artists(fuzzy).select("seq", "path", "bare", "best").union(of_releases(fuzzy).filter(first).select("seq", "path", "bare", "best")).filter("not bare")
    settle(rows.select("seq", "path", F.concat(F.lit("fuzzy "), F.floor(F.col("best") * 100 + 1e-9).cast("string"), F.lit("%")).alias("method")))
    return taken


def _titles(e: DataFrame, r: DataFrame) -> DataFrame:
    """Within each artist and each release (``by_release``, ``scope``), the pairs of distinct titles of which bases or whole
    titles are alike by ``FUZZY`` or more, whose versions agree and whose bases differ in no number: whether they have one base
    and are the ``same``, and the ``best`` likeness of those that are long and like enough. Titles are known by title_id.

    Titles with numbers meet those of the same numbers and those without any, so a catalogue of numbered titles is no join of
    all its titles."""
    told, at = ["title_id", "base", "version_type", "version", "title_key"], ["by_release", "scope"]
    left, right = (side.select(*at, *[F.col(x).alias(f"{p}_{x}") for x in told]).filter(f"{p}_base is not null").distinct() for side, p in ((e, "e"), (r, "r")))

    def blocks(side: DataFrame, p: str, key: str) -> DataFrame:
        numbers = F.array_join(_numbers(f"{p}_base"), " ")
        bare, other = ("e", "r") if p == "e" else ("r", "e")
        met = F.array(F.concat(F.lit("="), numbers), F.when(numbers == "", f"{bare} has none").otherwise(f"{other} has none"))
        return side.select(*at, F.explode(met).alias("block"), F.col(f"{p}_{key}").alias("key"))

    found = None
    for key in ("base", "title_key"):
        like = written(like_pairs(blocks(left, "e", key), blocks(right, "r", key), FUZZY, [*at, "block"]).drop("block").distinct())
        some = like.join(left.select(*at, "e_title_id", F.col(f"e_{key}").alias("a")), [*at, "a"]).join(right.select(*at, "r_title_id", F.col(f"r_{key}").alias("b")), [*at, "b"])
        some = some.select(*at, "e_title_id", "r_title_id", *[(F.col("ratio") if k == key else F.lit(0.0)).alias(n) for k, n in (("base", "base_like"), ("title_key", "key_like"))])
        found = some if found is None else found.union(some)
    pairs = found.groupBy(*at, "e_title_id", "r_title_id").agg(F.max("base_like").alias("base_like"), F.max("key_like").alias("key_like"))
    pairs = pairs.join(left, [*at, "e_title_id"]).join(right, [*at, "r_title_id"]).filter(~_differ(_numbers("e_base"), _numbers("r_base")))
    best = F.greatest("base_like", "key_like")
    able = (best >= FUZZY) & (F.length("e_base") >= 3) & ~_differ(_numbers("e_title_key"), _numbers("r_title_key"))
    agreed = readings._versions_agree(pairs).filter("agree")
    return agreed.select(*at, "e_title_id", "r_title_id", (F.col("e_base") == F.col("r_base")).alias("same_base"), (F.col("base_like") > TITLE).alias("same"), F.when(able, best).alias("best"))


def linkage(catalogue: DataFrame, artists: DataFrame, held: DataFrame) -> DataFrame:
    """Every catalogue row: seq, status (found or missing), method and path."""
    return catalogue.select("seq").join(linked(catalogue, artists, held).hint("merge"), "seq", "left").select("seq", F.when(F.col("path").isNull(), "missing").otherwise("found").alias("status"), "method", "path")
