"""Folders as copies of releases: how much of a release a folder covers, and whether it runs at the wrong speed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators.allocation import MOST, allocate

#: A folder is slow or fast if the length of all its songs is off by more, on one side, within a narrow spread.
SLOW, FAST, SPREAD, LEAST_SONGS = 0.88, 1.12, 1.08, 2


def wrong_speed(files: DataFrame, lengths: DataFrame) -> DataFrame:
    """folder, n_songs, low and high (of its files' lengths over known ones) of the folders that run at the wrong speed.

    Files have folder, title and seconds, lengths have title and seconds of every release. Each title's different lengths are
    gathered once, each file takes the one that is nearest to its own, and a folder is judged if two files or more have one.
    Null, zero and negative lengths, and titles without lengths, say nothing.
    """
    known = lengths.filter("seconds > 0").groupBy("title").agg(F.array_sort(F.collect_set(F.col("seconds").cast("double"))).alias("known"))
    timed = files.filter("seconds > 0").select("folder", "title", F.col("seconds").cast("double").alias("seconds"))
    ratios = F.transform("known", lambda s: F.struct(F.abs(F.col("seconds") / s - 1).alias("off"), (F.col("seconds") / s).alias("ratio")))
    nearest = timed.join(known, "title").select("folder", F.array_min(ratios)["ratio"].alias("ratio"))
    per = nearest.groupBy("folder").agg(F.count("*").alias("n_songs"), F.min("ratio").alias("low"), F.max("ratio").alias("high"))
    return per.filter((F.col("n_songs") >= LEAST_SONGS) & ((F.col("high") < SLOW) | (F.col("low") > FAST)) & (F.col("high") / F.col("low") < SPREAD))


def evaluate_directories(offers: DataFrame, songs: DataFrame, directories: DataFrame, most: int = MOST) -> DataFrame:
    """release, directory, n_matched, match_ratio and total_score of every directory that holds songs of a release.

    Offers have release, directory, song, expected (place of a title of the song), file, place (of the file), tier (1 to 3) and
    positioned (whether the file has the song's number; null: unknown). In a directory, the best offer first, each song gets one
    file and each file serves one song; a right number adds a half, a wrong one takes a quarter. Songs have release and n_songs;
    directories have directory, format_score, preferred, has_slot, queue and context. Releases of up to three songs need
    context. Null ends of offers take no part, null numbers of directories count as 0, null slots and contexts as none.
    """
    strength = F.col("tier") + F.when(F.col("positioned"), 0.5).when(~F.col("positioned"), -0.25).otherwise(0.0)
    taken = allocate(offers, ["release", "directory", "song"], ["release", "directory", "file"], [-strength, F.col("expected"), F.col("place")], most)
    per = taken.groupBy("release", "directory").agg(F.count("*").alias("n_matched")).join(songs, "release").join(directories, "directory")
    none, no = F.lit(0.0), F.lit(False)
    context = F.coalesce("context", no)
    ratio = F.col("n_matched") / F.col("n_songs")
    total = (
        ratio * 100 + F.coalesce(F.col("format_score").cast("double"), none) + F.when(F.coalesce("has_slot", no), 20).otherwise(0) - F.least(F.coalesce("queue", none) / 2, F.lit(40.0))
        + F.when(F.coalesce("preferred", no), 25).otherwise(0) - F.when(context, 0).otherwise(40)
    )
    return per.filter((F.col("n_songs") > 3) | context).select("release", "directory", "n_matched", ratio.alias("match_ratio"), total.cast("double").alias("total_score"))
