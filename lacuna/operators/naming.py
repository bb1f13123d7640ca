"""Which of many names stand in which of many texts, as whole words in a row, and what that says of a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import text as titles
from lacuna.operators.lineage import written

#: Words of a name by which texts are searched first.
HEAD = 2
#: Characters of all names up to which every task gets the names, each counted with so many more. Decides on the plan, not on its result.
FEW, EACH = 8 << 20, 64


def _joined(words: Column) -> Column:
    return F.concat_ws(" ", words)


def find_names(texts: DataFrame, names: DataFrame) -> DataFrame:
    """text_id, name_id, start (from 1) and n_words for every place at which the words of a name stand in a row in a text.

    Both tables have an id and ``words``. Texts give their first words at each position, which meet the heads of names; only
    where a head stands is a text cut to the lengths that names with this head have, and these cuts meet whole names. So no
    text meets a name with which it does not share its head, and both joins are by equality. Up to ``FEW`` characters of names
    go to every task, and texts are cut where they are; of more names, places are dealt by head and go back to their texts.
    Null or empty names and texts find nothing; names of equal words are all found; repeated text_ids find what each of them
    holds.
    """
    named = names.select("name_id", F.size("words").alias("n_words"), _joined(F.slice("words", 1, HEAD)).alias("head"), _joined("words").alias("phrase")).filter("n_words > 0")
    heads, phrases = named.select("head", "n_words").distinct(), named.select("name_id", "phrase").distinct()
    held = texts.select("text_id", "words", F.xxhash64("text_id", "words").alias("text_no")).filter(F.size("words") > 0)
    at = lambda n: F.transform(F.sequence(F.lit(1), F.size("words")), lambda i: F.struct(i.alias("start"), _joined(F.slice("words", i, n)).alias("head")))
    places, inside = F.inline(F.concat(*[at(n) for n in range(1, HEAD + 1)])), F.col("start") + F.col("n_words") - 1 <= F.col("size")
    if named.agg(F.coalesce(F.sum(F.length("phrase") + EACH), F.lit(0))).first()[0] <= FEW:
        heads, phrases = F.broadcast(heads), F.broadcast(phrases)
        cuts = held.select("text_id", "text_no", "words", F.size("words").alias("size"), places).join(heads, "head").filter(inside)
    else:
        hits = held.select("text_no", F.size("words").alias("size"), places).join(heads, "head").filter(inside).select("text_no", "start", "n_words").distinct()
        each = hits.groupBy("text_no").agg(F.collect_list(F.struct("start", "n_words")).alias("hits"))
        cuts = held.join(each, "text_no").select("text_id", "text_no", "words", F.inline("hits"))
    cuts = cuts.select("text_id", "text_no", "start", "n_words", _joined(F.slice("words", F.col("start"), F.col("n_words"))).alias("phrase"))
    return cuts.join(phrases, "phrase").select("text_no", "text_id", "name_id", "start", "n_words").distinct().drop("text_no")


def longest(found: DataFrame, names: DataFrame, *per: str) -> DataFrame:
    """Of the names found for a text (and ``per``), those that no longer one of them holds: First Light names no Light.

    What was found is written once, so that the texts are not searched twice.
    """
    inside = find_names(names.select(F.col("name_id").alias("text_id"), "words"), names)
    sizes = names.select(F.col("name_id").alias("outer"), F.size("words").alias("outer_words")).distinct()
    inside = inside.select(F.col("text_id").alias("outer"), F.col("name_id").alias("inner"), "n_words").join(sizes, "outer").filter("outer_words > n_words").select("outer", "inner").distinct()
    rows = written(found.select(*per, "text_id", "name_id").distinct())
    covered = rows.join(inside, rows.name_id == inside.outer).select(*per, "text_id", F.col("inner").alias("name_id"))
    return rows.join(covered, [*per, "text_id", "name_id"], "left_anti")


def words(key: str | Column) -> Column:
    """The words of a normalised title."""
    return F.filter(F.split(key, " "), lambda w: w != "")


def folder(path: str) -> Column:
    """The folders of a file's path; empty where it has none."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.substring(plain, F.lit(1), F.length(plain) - F.length(F.substring_index(plain, "/", -1)) - 1)


def named_by_folder(folders: DataFrame, releases: DataFrame) -> DataFrame:
    """folder and title of every release that a path of folders names; folders are distinct, see ``named_by_path``."""
    texts = titles.with_key(folders.select("folder"), "folder", "key")
    keyed = titles.with_key(releases.select("title").filter("title is not null").distinct(), "title", "key").filter("key <> ''")
    long_, short = keyed.filter(F.length("key") >= 3), keyed.filter(F.length("key") < 3)
    found = find_names(
        texts.select(F.col("folder").alias("text_id"), words("key").alias("words")), long_.select(F.col("title").alias("name_id"), words("key").alias("words"))
    ).select(F.col("text_id").alias("folder"), F.col("name_id").alias("title"))
    parts = texts.select("folder", F.explode(F.split("folder", "/")).alias("part")).filter("part <> ''")
    whole = titles.with_key(parts, "part", "key").join(short, "key").select("folder", "title")
    return found.union(whole).distinct()


def named_by_path(files: DataFrame, releases: DataFrame) -> DataFrame:
    """path and title of every release that a folder of the file's path names.

    A title counts where its words stand in a row in the folders; one of one or two letters only as a whole folder. Every
    folder path and title is normalised once. Files without folders and titles without a key name nothing.
    """
    paths = files.select("path", folder("path").alias("folder")).filter("folder <> ''").distinct()
    return paths.join(named_by_folder(paths.select("folder").distinct(), releases), "folder").select("path", "title").distinct()


def singular(word: Column) -> Column:
    """A word of five letters or more without its last s."""
    return F.when((F.length(word) >= 5) & word.endswith("s"), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def folder_place(asked: DataFrame, releases: DataFrame, lenient: bool = False) -> DataFrame:
    """ask_id and place: what a copy's folder says of the song that is asked for.

    Asked rows have ask_id, words (significant ones of the folder), own (those of the release asked for) and keys of the song;
    releases have words and keys of their songs. Releases of other words than ``own`` that the folder names count, the longest
    of them; 'shares' if one has a key of the song, 'other' if none has, 'unknown' if no release is named, 'loose' if the
    folder has no words. ``lenient`` reads plurals as singulars. Null words and keys are empty.
    """
    bare = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), singular if lenient else lambda w: w)
    asks = asked.select("ask_id", bare("words").alias("words"), _joined(bare("own")).alias("own"), "keys")
    known = releases.select(bare("words").alias("words"), "keys").filter(F.size("words") > 0).withColumn("name_id", _joined("words"))
    names = known.select("name_id", "words").distinct()
    found = find_names(asks.select(F.col("ask_id").alias("text_id"), "words"), names).select("text_id", "name_id").distinct()
    others = found.join(asks.select(F.col("ask_id").alias("text_id"), "own"), "text_id").filter("name_id <> own").drop("own")
    named = longest(others, names).withColumnRenamed("text_id", "ask_id")
    held = known.select("name_id", F.explode("keys").alias("key")).distinct()
    sharing = named.join(asks.select("ask_id", F.explode("keys").alias("key")), "ask_id").join(held, ["name_id", "key"], "left_semi").select("ask_id").distinct()
    marked = asks.join(named.select("ask_id").distinct().withColumn("named", F.lit(True)), "ask_id", "left").join(sharing.withColumn("shares", F.lit(True)), "ask_id", "left")
    place = F.when(F.size("words") == 0, "loose").when(F.col("named").isNull(), "unknown").when(F.col("shares"), "shares").otherwise("other")
    return marked.select("ask_id", place.alias("place"))
