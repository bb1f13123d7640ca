"""Collocations of 2 to 5 words by hierarchical pair naming.

Texts are cut into blocks of one language. In a block, each position holds the name of the k-gram that begins there, if that
k-gram is frequent. A (k+1)-gram is the pair of the names at two neighbouring positions; each block counts its distinct
pairs and deals them to hash buckets, where those of all blocks meet: counts are summed by pair, frequent pairs get names,
and the names go back to the blocks, whose positions are renamed. So a shuffle carries a pair once for each block that has
it, packed by bucket, and only pairs of frequent k-grams are looked at. Words get their names the same way.

A pair is two pointers, to the phrase without its last word and to the phrase without its first. What the cuts need is handed
down along them: a phrase's first parts are those of the first pointer and that phrase itself, its last parts likewise by
the second. A longer phrase has no more occurrences than a phrase in it, so of all that contain a phrase one of those with
a single word more, which point to it, occurs most often, and it decides whether the phrase is dropped.

Defined results: null text counts as empty, null lang as 'und', which it shares with a lang of that name; text without words
adds nothing; repeated rows count as often as they occur; of equal scores and counts the smaller phrase in UTF-8 is first;
an empty table gives no rows; other columns, however named, are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.anchors import mixed
from lacuna.llm.packed import packed, packed_words, unpacked, unpacked_words
from lacuna.operators.lineage import written

#: Blocks that a task holds open are cut at so many bytes of text together; bounds memory, not results.
BLOCK_BYTES = 16 << 20
#: Hash buckets at least; a task holds the keys of one bucket at a time, so there are as many as shuffle partitions if these are more.
BUCKETS = 256
LEAST, LONGEST, FIRST, COVERED = 100, 5, 2_000, 100

#: Marks the end of a piece; no UTF-8 text holds this byte.
_END = b"\xff"


def _bytewise() -> bytes:
    """A-Z to a-z, and what ends a piece to the mark."""
    table = bytearray(range(256))
    table[ord("A") : ord("Z") + 1] = range(ord("a"), ord("z") + 1)
    for byte in b".,;:!?\n\x0b\x0c\r":
        table[byte] = _END[0]
    return bytes(table)


class _Block:
    def __init__(self):
        self.table, self.places, self.size = {_END: 0}, [], 0

    def add(self, words: list[bytes], size: int) -> None:
        table = self.table
        self.places.append(np.fromiter((table.setdefault(w, len(table)) for w in words), np.int32, len(words)))
        self.size += size


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, lang, places (numbers of words from 1, 0 between pieces), names (the block's distinct words in order of number)
    and n_words."""
    bytewise, names = _bytewise(), ["block", "lang", "places", "names", "n_words"]

    def run(batches):
        first, opened, n, size = TaskContext.get().partitionId() << 32, {}, 0, 0

        def closed(lang):
            block = opened.pop(lang)
            places = np.concatenate(block.places)
            row = [first | n, lang, packed(places), packed_words(list(block.table)[1:]), int(np.count_nonzero(places))]
            types = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int64())
            return block.size, pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, types, strict=True)], names)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_py().encode()
                words = raw.translate(bytewise).replace(_END, b" \xff ").split()
                if words:
                    opened.setdefault(lang, _Block()).add([*words, _END], len(raw) + 1)
                    size += len(raw) + 1
                while size >= block_bytes:
                    gone, row = closed(max(opened, key=lambda x: opened[x].size))
                    n, size = n + 1, size - gone
                    yield row
        for lang in list(opened):
            yield closed(lang)[1]
            n += 1

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "block long, lang string, places binary, names binary, n_words long")


def _paired(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of neighbours that both have a name (first, second), how often each occurs, and each position's
    number among them, from 1; 0 where there is no pair."""
    both = np.flatnonzero((places[:-1] > 0) & (places[1:] > 0))
    pairs, inverse, counts = np.unique(places[both] << 32 | places[both + 1], return_inverse=True, return_counts=True)
    numbers = np.zeros(len(places), np.int64)
    numbers[both] = inverse + 1
    return pairs >> 32, pairs & 0xFFFFFFFF, counts, numbers


class _Words:
    """The distinct words of a block as keys: how they are dealt to hash buckets, packed, and summed up over blocks."""

    def __init__(self, places: np.ndarray, names: bytes):
        self.numbers, self.words = places, np.array(unpacked_words(names), object)
        self.counts = np.bincount(places, minlength=len(self.words) + 1)[1:]

    def order(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The keys by bucket, and the bucket of each."""
        bucket = np.fromiter(map(zlib.crc32, self.words), np.int64, len(self.words)) % buckets
        order = np.argsort(bucket, kind="stable")
        return order, bucket[order]

    def pack(self, which: np.ndarray) -> bytes:
        return packed_words(self.words[which].tolist())

    @staticmethod
    def summed(packs: list[bytes], counts: np.ndarray, langs: list[str]) -> tuple[np.ndarray, np.ndarray, list]:
        """The number of each key among the distinct ones, their sums, and what gives their columns."""
        table = {}
        keys = ((lang, word) for lang, pack in zip(langs, packs, strict=True) for word in unpacked_words(pack))
        of = np.fromiter((table.setdefault(k, len(table)) for k in keys), np.int64, len(counts))
        return of, np.bincount(of, counts, len(table)).astype(np.int64), list(table)

    @staticmethod
    def described(keys: list, which: np.ndarray) -> list[list]:
        return [[keys[i][0] for i in which.tolist()], [keys[i][1].decode() for i in which.tolist()], [None] * len(which), [None] * len(which)]


class _Pairs:
    """The distinct pairs of a block, likewise; a pair is two names."""

    def __init__(self, places: np.ndarray, names: bytes):
        first, second, self.counts, self.numbers = _paired(places)
        names = unpacked(names)
        self.a, self.b = names[first - 1], names[second - 1]

    def order(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        mixture = mixed(self.a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + self.b.astype(np.uint64))
        bucket = (mixture % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((self.b, self.a, bucket))
        return order, bucket[order]

    def pack(self, which: np.ndarray) -> bytes:
        return packed(np.concatenate([np.diff(self.a[which], prepend=0), self.b[which]]))

    @staticmethod
    def summed(packs: list[bytes], counts: np.ndarray, langs: list[str]) -> tuple[np.ndarray, np.ndarray, list]:
        halves = [unpacked(p).reshape(2, -1) for p in packs]
        a, b = np.concatenate([np.cumsum(x[0]) for x in halves]), np.concatenate([x[1] for x in halves])
        order = np.lexsort((b, a))
        first = np.flatnonzero((np.diff(a[order], prepend=-1) != 0) | (np.diff(b[order], prepend=-1) != 0))
        of = np.empty(len(a), np.int64)
        of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(a))))
        return of, np.bincount(of, counts, len(first)).astype(np.int64), [a[order[first]], b[order[first]]]

    @staticmethod
    def described(keys: list, which: np.ndarray) -> list[list]:
        return [[None] * len(which), [None] * len(which), keys[0][which].tolist(), keys[1][which].tolist()]


def _runs(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal values."""
    starts = np.flatnonzero(np.diff(sorted_values, prepend=-1)).tolist()
    return list(zip(starts, [*starts[1:], len(sorted_values)], strict=False))


def _dealt(state: DataFrame, kind: type, buckets: int) -> DataFrame:
    """The distinct keys of each block with their counts, in a pack for each hash bucket."""
    names = ["bucket", "block", "lang", "keys", "counts"]
    types = (pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary())

    def run(batches):
        for batch in batches:
            for block, lang, places, listed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, rows = kind(unpacked(places), listed), []
                order, bucket = keys.order(buckets)
                for i, j in _runs(bucket):
                    rows.append((int(bucket[i]), block, lang, keys.pack(order[i:j]), packed(keys.counts[order[i:j]])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names)

    return state.select("block", "lang", "places", "names").mapInArrow(run, "bucket int, block long, lang string, keys binary, counts binary")


def _frequent(state: DataFrame, kind: type, least: int) -> tuple[DataFrame, DataFrame, int]:
    """The keys whose counts sum up to ``least`` or more, each named by an id; the ids of each pack's keys, by block and
    bucket, with their places in the pack; and the number of buckets.

    An id is the key's number within its bucket and the bucket, so ids need no further agreement.
    """
    buckets = max(BUCKETS, int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fields = ("block long, bucket int, places binary, ids binary, id long, f long, lang string, word string, a long, b long").split(", ")
    names = [f.split()[0] for f in fields]
    types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]] for f in fields]

    def run(packs: pa.Table) -> pa.Table:
        # in the order of blocks, so that a repeated task gives the same ids
        packs = packs.sort_by("block")
        bucket, counted = packs.column("bucket")[0].as_py(), [unpacked(c) for c in packs.column("counts").to_pylist()]
        of, sums, keys = kind.summed(packs.column("keys").to_pylist(), np.concatenate(counted), packs.column("lang").to_pylist())
        ids = np.full(len(sums), -1)
        which = np.flatnonzero(sums >= least)
        ids[which] = np.arange(len(which)) * buckets + bucket
        rows, at = [], 0
        for block, counts in zip(packs.column("block").to_pylist(), counted, strict=True):
            mine = ids[of[at : at + len(counts)]]
            at += len(counts)
            if (found := np.flatnonzero(mine >= 0)).size:
                rows.append((block, bucket, packed(found), packed(mine[found]), *[None] * 6))
        n = [None] * len(which)
        grams = [n, n, n, n, ids[which].tolist(), sums[which].tolist(), *kind.described(keys, which)]
        replies = zip(*rows, strict=True) if rows else [[]] * len(fields)
        return pa.Table.from_arrays([pa.array([*r, *g], k) for r, g, k in zip(replies, grams, types, strict=True)], names)

    both = written(_dealt(state, kind, buckets).groupBy("bucket").applyInArrow(run, ", ".join(fields)))
    return both.filter("id is not null").select("id", "f", "lang", "word", "a", "b"), both.filter("id is null").select("block", "bucket", "places", "ids"), buckets


def _renamed(state: DataFrame, kind: type, replies: DataFrame, buckets: int) -> DataFrame:
    """block, lang, places and names: each position's number in the list of the block's frequent names, 0 where it has none."""

    def run(mine: pa.Table, found: pa.Table) -> pa.Table:
        rows = []
        for block, lang, places, listed in zip(*(c.to_pylist() for c in mine.columns), strict=True) if len(found) else ():
            keys = kind(unpacked(places), listed)
            order, bucket = keys.order(buckets)
            start, to, names, n = {int(bucket[i]): i for i, _ in _runs(bucket)}, np.zeros(len(order) + 1, np.int64), [], 0
            for number, at, ids in zip(*(found.column(c).to_pylist() for c in ("bucket", "places", "ids")), strict=True):
                at = order[start[number] + unpacked(at)]
                to[at + 1] = n + 1 + np.arange(len(at))
                names.append(unpacked(ids))
                n += len(at)
            rows.append((block, lang, packed(to[keys.numbers]), packed(np.concatenate(names))))
        types = (pa.int64(), pa.string(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(types)], ["block", "lang", "places", "names"])

    held = state.select("block", "lang", "places", "names").groupBy("block").cogroup(replies.groupBy("block"))
    return held.applyInArrow(run, "block long, lang string, places binary, names binary")


def _described(pairs: DataFrame, shorter: DataFrame) -> DataFrame:
    """The frequent pairs with lang, phrase and its last word, and the counts of their first and last parts by length."""
    first = shorter.select(F.col("id").alias("a"), "lang", F.col("phrase").alias("head"), F.concat("firsts", F.array("f")).alias("firsts"))
    rest = shorter.select(F.col("id").alias("b"), "last", F.concat("rests", F.array("f")).alias("rests"))
    return pairs.join(first, "a").join(rest, "b").select("id", "a", "b", "f", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "firsts", "rests")


def mined(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """All phrases of 2 to ``longest`` words that occur ``least`` times or more (lang, phrase, f, firsts, rests, and covered,
    the count of the commonest longer one that holds it); and lang, n, the words of each language."""
    state = written(blocks(docs, block_bytes))
    totals = state.groupBy("lang").agg(F.sum("n_words").alias("n"))
    grams, replies, buckets = _frequent(state, _Words, least)
    none = F.array().cast("array<bigint>")
    grams = grams.select("id", "f", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), none.alias("firsts"), none.alias("rests"))
    state, found = written(_renamed(state, _Words, replies, buckets)), []
    for length in range(2, longest + 1):
        pairs, replies, buckets = _frequent(state, _Pairs, least)
        longer = written(_described(pairs.select("id", "a", "b", "f"), grams))
        if length > 2:
            held = longer.select(F.col("a").alias("id"), "f").union(longer.select(F.col("b").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("covered"))
            found.append(grams.join(held, "id", "left"))
        grams = longer
        if length < longest:
            state = written(_renamed(state, _Pairs, replies, buckets))
    found.append(grams.withColumn("covered", F.lit(None).cast("long")))
    columns = ["lang", "phrase", "f", "firsts", "rests", F.coalesce("covered", F.lit(0)).alias("covered")]
    whole = found[0].select(*columns)
    for more in found[1:]:
        whole = whole.union(more.select(*columns))
    return whole, totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST, covered: int = COVERED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``first`` best phrases; ``longest`` is 2 or more.

    A phrase is dropped if a longer one that holds it has ``covered`` % of its occurrences or more. Products are decimals of
    38 digits; a product beyond them raises.
    """
    phrases, totals = mined(docs, least, longest, block_bytes)
    kept = phrases.filter(100 * F.col("covered") < covered * F.col("f")).join(totals, "lang")
    cut = F.expr(
        """array_min(transform(sequence(1, size(firsts)), k -> named_struct(
            'score', (1000 * cast(f as decimal(38, 0)) * cast(n as decimal(20, 0))) div (cast(firsts[k - 1] as decimal(20, 0)) * cast(rests[size(firsts) - k] as decimal(20, 0))),
            'k', k, 'l', firsts[k - 1], 'r', rests[size(firsts) - k])))"""
    )
    scored = kept.withColumn("cut", cut).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
