"""Readers of catalogue documents, peer responses and transfer histories, and what is stale in a cache of files.

Schemas are given and never inferred, so optional keys do not vanish; a malformed document fails the read. Numbers come as
text or as integers and are read as text. Live services are left out: their recorded documents are the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The names and nesting of the documents' fields.
_RECORDING = "struct<id string, title string, length string>"
_TRACK = f"struct<id string, number string, position string, title string, length string, recording {_RECORDING}>"
RELEASE = (
    "id string, title string, date string, country string, disambiguation string, "
    "`release-group` struct<id string, title string, `primary-type` string, `secondary-type-list` array<string>>, "
    f"`medium-list` array<struct<position string, format string, `track-list` array<{_TRACK}>>>"
)
RESPONSE = (
    "query string, username string, hasFreeUploadSlot boolean, queueLength int, uploadSpeed bigint, "
    "files array<struct<filename string, size bigint, extension string, isLocked boolean, length double, bitRate int, bitDepth int, sampleRate int>>"
)
_TRANSFER = "struct<id string, filename string, size bigint, state string, attempts int, exception string, requestedAt string, enqueuedAt string, startedAt string, endedAt string>"
DOWNLOADS = f"username string, directories array<struct<directory string, files array<{_TRANSFER}>>>"
FAILURES = ("Cancelled", "Aborted", "Rejected", "TimedOut", "Errored")


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one or a list in each file, under the given schema."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def official_tracks(releases: DataFrame) -> DataFrame:
    """One row for each track of each medium: positions, printed title, the recording's other title, ids and seconds."""
    media = releases.select(F.col("id").alias("release_id"), F.posexplode("medium-list").alias("m_index", "m"))
    media = media.withColumn("disc_number", F.coalesce(F.expr("try_cast(m.position as int)"), F.lit(1)))
    rows = media.select("release_id", "m_index", "disc_number", F.posexplode("m.track-list").alias("t_index", "t"))
    before = releases.select(F.col("id").alias("release_id"), F.posexplode(F.expr("transform(`medium-list`, (m, i) -> aggregate(slice(`medium-list`, 1, i), 0, (n, x) -> n + greatest(size(x.`track-list`), 0)))")).alias("m_index", "before"))
    title = F.coalesce(F.nullif(F.trim("t.title"), F.lit("")), F.nullif(F.trim("t.recording.title"), F.lit("")), F.lit("Unknown Track"))
    other = F.nullif(F.trim("t.recording.title"), F.lit(""))
    seconds = F.coalesce(F.expr("try_cast(t.length as double)"), F.expr("try_cast(t.recording.length as double)")) / 1000
    place = F.col("t_index") + 1
    return rows.join(before, ["release_id", "m_index"]).select(
        "release_id", (F.col("before") + place).alias("seq"), "disc_number", place.alias("track_position"), (F.col("before") + place).alias("absolute_position"),
        F.coalesce("t.number", "t.position").alias("token"), title.alias("title"),
        F.when(other.isNotNull() & (F.lower(other) != F.lower(title)), F.array(other)).otherwise(F.array().cast("array<string>")).alias("alt_titles"),
        F.col("t.id").alias("track_id"), F.col("t.recording.id").alias("recording_id"), F.bround(seconds, 1).alias("seconds"),
    )


def source_user(user: Column) -> Column:
    """A peer's name without the remark in brackets that search results append."""
    return F.trim(F.regexp_replace(F.coalesce(user, F.lit("")), r"\s*\(.*?\)$", ""))


def peer_files(responses: DataFrame) -> DataFrame:
    """One row for each unlocked file that a peer offers; names that differ in case only are one file, the smallest kept."""
    rows = responses.select(source_user(F.col("username")).alias("user"), "hasFreeUploadSlot", "queueLength", "uploadSpeed", F.explode("files").alias("f")).filter("not coalesce(f.isLocked, false) and f.filename is not null")
    path = F.regexp_replace("f.filename", r"\\", "/")
    flat = rows.select("user", F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("directory"), F.regexp_extract(path, "[^/]*$", 0).alias("name"), path.alias("path"), "f.size", F.col("f.length").alias("seconds"), F.col("f.bitRate").alias("bit_rate"), F.col("hasFreeUploadSlot").alias("has_slot"), F.col("queueLength").alias("queue"), F.col("uploadSpeed").alias("speed"))
    kept = [c for c in flat.columns if c not in ("user", "path")]
    one = flat.groupBy("user", F.lower("path").alias("__k")).agg(F.min(F.struct("path", *kept)).alias("f"))
    return one.select("user", "f.*")


def peer_directories(files: DataFrame) -> DataFrame:
    """Files, bytes and best speed of each directory of each peer."""
    return files.groupBy("user", "directory").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"), F.max("speed").alias("speed"), F.bool_or("has_slot").alias("has_slot"), F.min("queue").alias("queue"))


def moment(text: str) -> Column:
    """A time with up to 7 digits of a second, UTC unless it names a zone; unset ones (year 1970 or before) are null."""
    at = F.try_to_timestamp(text)
    return F.when(F.year(at) > 1970, at)


def terminal_failure(states: Column) -> Column:
    """The failure that ended a transfer, by fixed precedence; null while it runs and where it succeeded."""
    named = F.coalesce(*[F.when(F.array_contains(states, s), s) for s in FAILURES])
    return F.when(F.array_contains(states, "Completed") & ~F.array_contains(states, "Succeeded"), named)


def transfers(downloads: DataFrame) -> DataFrame:
    """One row for each transfer: user, path, states, failure and when it last moved."""
    files = downloads.select("username", F.explode("directories").alias("d")).select("username", F.explode("d.files").alias("f"))
    rows = files.select(source_user(F.col("username")).alias("user"), F.regexp_replace("f.filename", r"\\", "/").alias("path"), "f.*")
    states = F.transform(F.split(F.coalesce("state", F.lit("")), ","), lambda s: F.trim(s))
    last = F.greatest(*[moment(c) for c in ("requestedAt", "enqueuedAt", "startedAt", "endedAt")])
    return rows.select("user", "path", "id", "size", "attempts", F.col("exception").alias("reason"), F.array_sort(F.array_distinct(states)).alias("states"), terminal_failure(states).alias("failure"), last.alias("last_moved"))


def to_read(listing: DataFrame, cache: DataFrame, version: int) -> DataFrame:
    """Files of the listing (path, mtime, size_bytes) without a current row in the cache.

    A row is current if its time and size are the file's, its disc is known, and its extractor is ``version`` or newer. Rows
    of the cache that hold null in any of these are not current. Repeated paths of the listing stay repeated.
    """
    good = cache.filter(F.col("disc_number").isNotNull() & (F.col("extractor_version") >= version)).select("path", "mtime", "size_bytes").distinct()
    return listing.join(good, ["path", "mtime", "size_bytes"], "left_anti")
