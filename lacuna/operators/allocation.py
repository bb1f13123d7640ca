"""Choices in order: who takes which offer, and which folders fill a release."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.lineage import written

#: Open offers that one task may settle in sequence.
MOST = 50_000
#: Offers of one release that one task may cover in a loop; more are cut down in rounds first.
COVER_MOST = 10_000_000


def _sequence(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The numbers of the offers that are taken one after the other, as they come, while both ends are free."""
    used_left, used_right = set(), set()
    for batch in batches:
        taken = []
        for one, two, n in batch[["left", "right", "n"]].itertuples(index=False, name=None):
            if one not in used_left and two not in used_right:
                used_left.add(one)
                used_right.add(two)
                taken.append(n)
        yield pd.DataFrame({"n": pd.Series(taken, dtype="int32")})


def allocate(offers: DataFrame, left: Sequence[str], right: Sequence[str], order: Sequence[Column], most: int = MOST) -> DataFrame:
    """The offers that would be taken one after the other by ``order`` (then by left and right) while both ends are free.

    With an order that starts with what orders the left ends, each left end in its turn takes the best that earlier ones left
    over. In a round, every offer that comes first at both of its ends is taken: whatever the sequence takes before it touches
    neither end. Offers of taken ends go, so rounds shrink what is open and each takes some; when ``most`` offers or fewer are
    open, one task takes the rest in sequence. Ends are lists of columns; columns of offers are returned. Of repeated pairs of
    ends, the first offer counts. An end with a null takes no part; no offers give no rows.
    """
    whole = offers.filter(F.concat(*[F.array(F.col(c).isNull()) for c in (*left, *right)]) == F.array(*[F.lit(False)] * (len(left) + len(right))))
    keyed = lambda rows: rows.select(F.struct(*left).alias("left"), F.struct(*right).alias("right"), F.struct(*order).alias("at"), F.struct("*").alias("row"))
    table = written(whole)
    taken, n, open_ = [], table.count(), keyed(table)
    while n > most:
        # only the right ends that come first somewhere are looked at from their side, so a round shuffles no open offer
        # where left ends have many offers each
        best = written(open_.groupBy("left").agg(F.min_by(F.struct("right", "row"), F.struct("at", "right")).alias("x")).select("left", "x.*"))
        rivals = open_.select("left", "right", "at").join(best.select("right").distinct(), "right", "left_semi")
        winners = rivals.groupBy("right").agg(F.min_by("left", F.struct("at", "left")).alias("left"))
        both = written(best.join(winners, ["left", "right"]).select("left", "right", "row"))
        taken.append(both)
        # left ends that took nothing are all whose offers stay open
        lost = written(best.select("left").join(both.select("left"), "left", "left_anti"))
        n = lost.count()
        if n:
            table = written(open_.join(lost, "left", "left_semi").join(both.select("right"), "right", "left_anti").select("row.*"))
            n, open_ = table.count(), keyed(table)
    if n:
        ranked = open_.select(F.to_json("left").alias("left"), F.to_json("right").alias("right"), F.row_number().over(Window.orderBy("at", "left", "right")).alias("n"), "row")
        ranked = written(ranked)
        numbers = ranked.select("left", "right", "n").repartition(1).sortWithinPartitions("n").mapInPandas(_sequence, "n int")
        taken.append(ranked.join(numbers, "n"))
    rows = [t.select("row.*") for t in taken] or [offers.limit(0)]
    found = rows[0]
    for more in rows[1:]:
        found = found.union(more)
    return found


def _held(offers: DataFrame, most: int) -> DataFrame:
    """The file of each song in each folder. Only folders that have a file for several songs need turns; in all others each
    song has its best file, whatever the others take."""
    folder = ["release", "peer", "folder"]
    whole = offers.filter(" and ".join(f"{c} is not null" for c in (*folder, "song", "file")))
    shared = whole.groupBy(*folder, "file").agg(F.min("song").alias("low"), F.max("song").alias("high")).filter("low <> high").select(*folder).distinct()
    shared = written(shared)
    row = F.struct(*[c for c in offers.columns if c not in (*folder, "song")])
    free = whole.join(shared, folder, "left_anti").groupBy(*folder, "song").agg(F.min_by(row, F.struct("song_order", "rank", "file")).alias("row")).select(*folder, "song", "row.*").select(*offers.columns)
    if shared.isEmpty():
        return written(free)
    turns = allocate(whole.join(shared, folder, "left_semi"), [*folder, "song"], [*folder, "file"], [F.col("song_order"), F.col("rank")], most)
    return written(free.unionByName(turns))


def best_folders(offers: DataFrame, complete: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """The file that fills each song of each release, all folders of all peers compared before any is chosen.

    Offers have release, song, song_order, peer, folder, file, rank (of files, smallest first), context, preferred, placed,
    health (smallest first) and quality. In a folder each song in turn takes the best file that is left. Folders are ordered
    by context, preferred files, songs, files in their place (if the release has several songs or the folder has context),
    health, quality and name; they are taken in this order until nothing remains, which gives each song the first folder that
    has it. With ``complete`` (release, n_songs), only folders that fill a whole release count. A null release, song, peer,
    folder or file takes no part.
    """
    held = _held(offers, most)
    songs = offers.groupBy("release").agg(F.count_distinct("song").alias("known"))
    total = lambda c: F.sum(F.col(c).cast("long"))
    per = held.groupBy("release", "peer", "folder").agg(
        F.coalesce(F.max("context") > 0, F.lit(False)).alias("in_context"), total("preferred").alias("preferred"), F.count("*").alias("n"),
        total("placed").alias("placed"), F.min("health").alias("health"), total("quality").alias("quality"),
    )
    if complete is not None:
        per = per.join(complete, "release").filter("n = n_songs")
    per = per.join(songs, "release")
    placed = F.when((F.col("known") > 1) | F.col("in_context"), F.coalesce("placed", F.lit(0))).otherwise(0)
    falling = [~F.col("in_context"), -F.coalesce("preferred", F.lit(0)), -F.col("n"), -placed, F.col("health"), -F.coalesce("quality", F.lit(0))]
    turn = Window.partitionBy("release").orderBy(*falling, F.lower("peer"), F.lower("folder"), "peer", "folder")
    per = per.select("release", "peer", "folder", F.row_number().over(turn).alias("place"))
    first = held.select("release", "song", "peer", "folder", "file").join(per, ["release", "peer", "folder"]).groupBy("release", "song").agg(F.min_by(F.struct("peer", "folder", "file"), "place").alias("of"))
    return first.select("release", "song", "of.*")


def _ends(offers: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of offers in the order of one end, and where each of its ``n`` values begins there."""
    return np.argsort(offers, kind="stable").astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(offers, minlength=n))])


def _cover_each(rows: pa.Table) -> pa.Table:
    """Folder after folder of one release: the one with most of the songs that are left, the smaller name first."""
    numbered = []
    for c in ("folder", "song"):
        coded = rows.column(c).combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int32)
        rank[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
        numbered.append((rank[coded.indices.to_numpy()], coded.dictionary.take(order)))
    (folder, folders), (song, songs) = numbered
    by_folder, of_folder = _ends(folder, len(folders))
    by_song, of_song = _ends(song, len(songs))
    left, free = np.diff(of_folder), np.ones(len(songs), bool)
    waiting = list(zip((-left).tolist(), range(len(folders)), strict=True))
    heapq.heapify(waiting)
    taken, filled = [], []
    while waiting:
        n, f = heapq.heappop(waiting)
        if left[f] != -n:
            # counts only fall, so a folder waits again at its new count
            if left[f]:
                heapq.heappush(waiting, (-int(left[f]), f))
            continue
        gone = song[by_folder[of_folder[f] : of_folder[f + 1]]]
        gone = gone[free[gone]]
        free[gone] = False
        for s in gone.tolist():
            left[folder[by_song[of_song[s] : of_song[s + 1]]]] -= 1
        taken.append(np.full(len(gone), f, np.int32))
        filled.append(gone)
    who, what = np.concatenate(taken), np.concatenate(filled)
    n_filled = np.bincount(who, minlength=len(folders))[who].astype(np.int64)
    release = rows.column("release").slice(0, len(who))
    return pa.table({"release": release, "folder": folders.take(pa.array(who)), "song": songs.take(pa.array(what)), "n_filled": n_filled})


def cover(offers: DataFrame, release: str, folder: str, song: str, most: int = COVER_MOST) -> DataFrame:
    """release, folder, song, n_filled and step: the folder that fills each song if in every step the folder with most songs
    that are left (of equals the smaller one) is taken, and the rest are counted again.

    All releases go at once. A folder that is first among all folders with which it shares a song is taken whatever the others
    do, since counts only fall; a round takes all of these and counts only what is left. A release with ``most`` offers or fewer
    left is settled by one task in a loop, in arrays of some 50 bytes an offer. The order of steps is that of the counts at which folders were taken.
    Nulls take no part.
    """
    named = offers.select(F.col(release).alias("release"), F.col(folder).alias("folder"), F.col(song).alias("song")).na.drop().distinct()
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema.fields)
    open_, found = written(named), None
    while True:
        sizes = open_.groupBy("release").agg(F.count("*").alias("n"))
        small = open_.join(sizes.filter(F.col("n") <= most).select("release"), "release", "left_semi")
        settled = small.groupBy("release").applyInArrow(_cover_each, f"{kinds}, n_filled long").select("release", "folder", "song", "n_filled")
        found = settled if found is None else found.union(settled)
        large = written(open_.join(sizes.filter(F.col("n") > most).select("release"), "release", "left_semi").select("release", "folder", "song"))
        if large.isEmpty():
            break
        counts = large.groupBy("release", "folder").agg(F.count("*").alias("n"))
        keyed = large.join(counts, ["release", "folder"])
        first = keyed.groupBy("release", "song").agg(F.min_by("folder", F.struct(-F.col("n"), "folder")).alias("first"))
        judged = keyed.join(first, ["release", "song"]).groupBy("release", "folder").agg(F.count("*").alias("n_filled"), F.bool_and(F.col("folder") == F.col("first")).alias("leads"))
        filled = written(large.join(judged.filter("leads").drop("leads"), ["release", "folder"]).select("release", "folder", "song", "n_filled"))
        found = found.union(filled)
        open_ = written(large.join(filled.select("release", "song"), ["release", "song"], "left_anti").select("release", "folder", "song"))
    steps = Window.partitionBy("release").orderBy(F.desc("n_filled"), "folder")
    return found.withColumn("step", F.dense_rank().over(steps)).toDF(release, folder, song, "n_filled", "step")
