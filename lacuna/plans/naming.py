"""Named queries of titles: what the names of files are read as, which titles they match, and titles with masked letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import readings
from lacuna.plans.catalogue import query, t


def _file_name() -> Column:
    """A line's part as a file: four ways to write place, artist, title and version, by its number."""
    name, kind, artist = F.col("p_name"), F.col("p_type"), F.concat(F.lit("Artist "), F.col("l_suppkey").cast("string"))
    place = F.lpad(F.col("l_linenumber").cast("string"), 2, "0")
    scene = F.lower(F.concat_ws("-", place, F.regexp_replace(artist, " ", "_"), F.regexp_replace(name, " ", "_")))
    plain = F.concat(place, F.lit(" - "), artist, F.lit(" - "), name, F.lit(" ("), kind, F.lit(" Remix) [FLAC].flac"))
    noted = F.concat(place, F.lit(". "), name, F.lit(" (2009 Remaster).mp3"))
    dashed = F.concat(artist, F.lit(" - "), name, F.lit(" - "), kind, F.lit(" Remix.mp3"))
    n = F.col("l_linenumber") % 4
    return F.when(n == 0, plain).when(n == 1, F.concat(scene, F.lit("-abc.mp3"))).when(n == 2, dashed).otherwise(noted)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber")
    parts = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    return lines.join(parts, "l_partkey").withColumn("file", _file_name())


FILES = """SELECT p_name, p_type, l_linenumber % 4 AS form, CASE l_linenumber % 4
    WHEN 0 THEN lpad(l_linenumber::VARCHAR, 2, '0') || ' - Artist ' || l_suppkey || ' - ' || p_name || ' (' || p_type || ' Remix) [FLAC].flac'
    WHEN 1 THEN lower(lpad(l_linenumber::VARCHAR, 2, '0') || '-artist_' || l_suppkey || '-' || replace(p_name, ' ', '_')) || '-abc.mp3'
    WHEN 2 THEN 'Artist ' || l_suppkey || ' - ' || p_name || ' - ' || p_type || ' Remix.mp3'
    ELSE lpad(l_linenumber::VARCHAR, 2, '0') || '. ' || p_name || ' (2009 Remaster).mp3' END AS file FROM lineitem JOIN part ON l_partkey = p_partkey"""


@query(f"""SELECT DISTINCT file, lower(p_name) AS base, CASE WHEN form IN (0, 2) THEN 'remix' ELSE '' END AS version_type,
    CASE WHEN form IN (0, 2) THEN lower(p_type) || ' remix' ELSE '' END AS version FROM ({FILES})""")
def file_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest title of each distinct file name, and its version."""
    found = readings.parsed(_files(spark, sf_dir), "file", True, ["name", "base", "version_type", "version"], likeliest=True)
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return found.select(F.col("name").alias("file"), "base", empty("version_type"), empty("version"))


@query(f"""WITH f AS (SELECT file, p_name, p_type, form FROM ({FILES}))
SELECT lower(p_name) AS title, count(DISTINCT file) FILTER (form IN (1, 3)) AS n_files FROM f GROUP BY 1 HAVING n_files > 0
UNION ALL SELECT lower(p_name) || ' (' || lower(p_type) || ' remix)', count(DISTINCT file) FROM f WHERE form IN (0, 2) GROUP BY 1""")
def files_of_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct files hold each title, plain or as a remix, by any reading of their names."""
    parts = t(spark, sf_dir, "part")
    name = F.lower("p_name")
    titles = parts.select(name.alias("title")).union(parts.select(F.concat(name, F.lit(" ("), F.lower("p_type"), F.lit(" remix)"))))
    found = readings.same_titles(titles, "title", _files(spark, sf_dir), "file")
    return found.groupBy("title").agg(F.count("*").alias("n_files"))


@query("""WITH p AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part),
m AS (SELECT a, a || ' ' || b[1:1] || 'XX' || b[4:] AS title, b FROM p WHERE len(b) >= 4)
SELECT m.title, p.p_name AS name FROM m JOIN p ON p.a = m.a AND len(p.b) = len(m.b) AND p.b[1:1] = m.b[1:1] AND p.b[4:] = m.b[4:] GROUP BY ALL""")
def masked_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names whose second word has two letters masked, and the names that spell them out."""
    names = t(spark, sf_dir, "part").select("p_name").distinct()
    first, second = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    titles = names.filter(F.length(second) >= 4).select(F.concat_ws(" ", first, F.concat(F.substring(second, 1, 1), F.lit("XX"), F.substr(second, F.lit(4)))).alias("title"))
    return readings.masked_matches(readings.masked_titles(titles, "title"), readings.parsed(names, "p_name", False))


@query()
def title_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names scored against the file names of all that share a word with them."""
    names = t(spark, sf_dir, "part").select("p_name").distinct()
    words = names.select("p_name", F.explode(F.split("p_name", " ")).alias("word"))
    both = words.join(words.withColumnRenamed("p_name", "other"), "word").select("p_name", F.concat(F.lit("03 - "), F.col("other"), F.lit(" (Original Mix) [320 kbps].mp3")).alias("file"))
    return readings.match_scores(both, "p_name", "file").withColumnsRenamed({"title": "p_name", "name": "file"})
