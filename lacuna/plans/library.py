"""Named queries of the library: linkage of held files with a catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.operators import audit, folders
from lacuna.operators import linkage as linking
from lacuna.operators.lineage import written
from lacuna.plans.catalogue import query, t


@query("""WITH m AS (SELECT l_partkey, min('m/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '.mp3') AS path FROM lineitem GROUP BY 1)
SELECT p_partkey AS seq, CASE WHEN path IS NULL THEN 'missing' ELSE 'found' END AS status, CASE WHEN path IS NULL THEN NULL ELSE ['recording', 'release', 'artist'][p_partkey % 4 + 1] END AS method, path
FROM part LEFT JOIN m ON l_partkey = p_partkey AND p_partkey % 4 < 3""")
def linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a catalogue of brands, lines as files: some have the recording's id, some album and artist, some the artist
    only, and those of every fourth part credit another artist."""
    part = t(spark, sf_dir, "part").withColumn("song", F.concat(F.col("p_name"), F.lit(" no "), F.col("p_partkey").cast("string")))
    none, kind = F.lit(None).cast("array<string>"), F.col("p_partkey") % 4
    catalogue = part.select(
        F.col("p_partkey").alias("seq"), F.col("p_brand").alias("artist_id"), F.col("p_type").alias("release"), none.alias("releases"), F.col("song").alias("title"),
        F.lit(None).cast("string").alias("track_number"), F.array(F.concat(F.lit("r"), F.col("p_partkey").cast("string"))).alias("recording_ids"), none.alias("track_ids"), F.lit(None).cast("string").alias("release_id"),
    )
    lines = t(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    path = F.concat(F.lit("m/"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string"), F.lit(".mp3"))
    held = lines.select(
        path.alias("path"), F.array(F.when(kind == 3, F.lit("Somebody Else")).otherwise(F.col("p_brand"))).alias("artists"), F.lit(None).cast("string").alias("album_artist"),
        F.when(kind == 1, F.col("p_type")).alias("album"), F.concat(F.col("song"), F.lit(" (2009 Remaster)")).alias("title"), F.lit(None).cast("string").alias("track_number"),
        F.when(kind == 0, F.array(F.concat(F.lit("r"), F.col("p_partkey").cast("string")))).alias("recording_ids"), none.alias("track_ids"), none.alias("release_ids"),
    )
    artists = part.select(F.col("p_brand").alias("artist_id"), F.col("p_brand").alias("alias")).distinct()
    return linking.linkage(catalogue, artists, held)


@query("""WITH k AS (SELECT DISTINCT p_name || ' ' || p_partkey % 500 AS title, p_retailprice AS s FROM part WHERE p_retailprice > 0),
f AS (SELECT DISTINCT l_suppkey, l_orderkey % 10 AS disc, p_name || ' ' || p_partkey % 500 AS title, p_retailprice * CASE l_suppkey % 7 WHEN 0 THEN 0.7 WHEN 1 THEN 1.3 WHEN 2 THEN 0.92 ELSE 1.0 END AS seconds FROM lineitem JOIN part ON l_partkey = p_partkey),
r AS (SELECT l_suppkey, disc, title, seconds, arg_min(seconds / s, abs(seconds / s - 1)) AS ratio FROM f JOIN k USING (title) GROUP BY ALL),
p AS (SELECT l_suppkey, disc, count(*) AS n_songs, min(ratio) AS low, max(ratio) AS high FROM r GROUP BY ALL)
SELECT l_suppkey, disc, n_songs FROM p WHERE n_songs >= 2 AND (high < 0.88 OR low > 1.12) AND high / low < 1.08""")
def wrong_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of lines, in which some suppliers run too fast or too slow for the known lengths (prices) of their names."""
    part = t(spark, sf_dir, "part").withColumn("title", F.concat_ws(" ", "p_name", (F.col("p_partkey") % 500).cast("string")))
    lines = t(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    kind = F.col("l_suppkey") % 7
    speed = F.when(kind == 0, 0.7).when(kind == 1, 1.3).when(kind == 2, 0.92).otherwise(1.0)
    files = lines.select(F.struct("l_suppkey", (F.col("l_orderkey") % 10).alias("disc")).alias("folder"), "title", (F.col("p_retailprice") * speed).alias("seconds")).distinct()
    found = folders.wrong_speed(files, part.select("title", F.col("p_retailprice").alias("seconds")))
    return found.select("folder.l_suppkey", "folder.disc", "n_songs")


@query("""WITH x AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem), f AS (SELECT l_orderkey, l_linenumber, l_partkey, min(l_returnflag) AS flag FROM x GROUP BY ALL)
SELECT l_orderkey AS release_id, count(*) AS expected, count(*) FILTER (flag <> 'R') AS found, count(*) FILTER (flag = 'R') AS missing, CASE WHEN count(*) FILTER (flag = 'R') > 0 THEN 'has_missing' ELSE 'complete' END AS status
FROM f GROUP BY 1""")
def audited_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as releases, lines as tracks; files of returned lines are not held, the others are named as remasters."""
    parts = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").join(parts, "l_partkey")
    # lines and their places are made where an order's lines are dealt to, and written once for both sides
    lines = lines.repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber", "l_partkey", "p_name").agg(F.min("l_returnflag").alias("flag"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    tracks = written(lines.select("l_orderkey", place.alias("place"), F.concat(F.col("p_name"), F.lit(" no "), F.col("l_partkey").cast("string")).alias("name"), "flag"))
    text, ids = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    official = tracks.select(
        F.col("l_orderkey").alias("release_id"), F.col("place").alias("seq"), F.lit(1).alias("disc_number"), F.col("place").alias("track_position"), F.col("place").alias("absolute_position"),
        F.col("place").cast("string").alias("token"), F.col("name").alias("title"), ids.alias("alt_titles"), text.alias("track_id"), text.alias("recording_id"),
    )
    held = tracks.filter("flag <> 'R'").select(
        F.col("l_orderkey").alias("release_id"), F.col("place").alias("seq"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("place").cast("string")).alias("path"), F.lit(1).alias("disc_number"),
        F.col("place").alias("number"), F.concat(F.col("name"), F.lit(" (2009 Remaster)")).alias("title"), ids.alias("track_ids"), ids.alias("recording_ids"),
    )
    return audit.audit_releases(audit.audit_tracks(official, held)).select("release_id", "expected", "found", "missing", "status")
