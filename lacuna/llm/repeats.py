"""Removal of repeated passages by content-chosen anchors; this is not bucket-pointer refinement of all suffixes.

A byte goes when a string of ``length`` bytes that covers it starts anywhere else too. Of all suffixes, only anchors are
sorted: the gram with the smallest hash of every window of ``length`` bytes, so that equal windows have equal anchors at
equal offsets (about one suffix in 70 bytes). The steps:

1. Initial buckets: anchors by the hash of their gram. Buckets of one suffix are dropped.
2. Refinement by what lies at the other offsets of the anchor's windows: suffixes whose whole surroundings are equal make
   a class. All windows of a class with two members or more are repeated.
3. Recursion where a bucket still has a lone class: one member of each class of the bucket is compared window by window.

Spark counts and joins buckets and classes; each is pre-aggregated, and neither a bucket nor a class is gathered, but for
buckets of at most ``GATHER`` classes in step 3 (larger ones are counted row by row). What a task needs to know about the
corpus comes as a filter of fixed size that may let too much pass, and never too little, so it changes no result.

Equality is that of 64-bit hashes; no bytes are compared afterwards.

Defined results: null text counts as empty; texts under ``length`` bytes keep all; repeated rows are documents of their
own, so each of them loses what repeats; ties need no rule; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.anchors import Rolled, anchors, mixed
from lacuna.llm.common import id_text
from lacuna.operators.lineage import written

LENGTH, GRAM = 200, 64
#: Bits of the filter that goes to every task: 8 MB, whatever the corpus.
FILTER_BITS = 1 << 26
#: Classes of a bucket that one task may hold together.
GATHER = 5_000
#: Rows of surroundings that one step of a task compares at once.
STEP = 2_000


def _u64(column) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64)


class Filter:
    """Set of 64-bit hashes in a fixed number of bits, two bits each."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return h % np.uint64(FILTER_BITS), (h >> np.uint64(32)) % np.uint64(FILTER_BITS)

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for b in self.bits(h):
            found &= (self.words[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1) == 1
        return found


def _filter(hashes: DataFrame, column: str) -> Filter:
    """Gather the filter's 64-bit words: at most FILTER_BITS / 64 rows come to the driver, as many as the filter has."""
    h = F.col(column)
    bit = [F.pmod(h.bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(FILTER_BITS)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(FILTER_BITS))]
    pairs = hashes.select(F.explode(F.array(*bit)).alias("b")).select(F.shiftright("b", 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("m"))
    got = pairs.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    words = np.zeros(FILTER_BITS // 64, np.uint64)
    words[got.column("w").to_numpy()] = got.column("m").to_numpy().view(np.uint64)
    return Filter(words)


def _suffixes(texts, length: int, gram: int):
    """Of each text that is long enough: its place, its bytes, its rolling hash and its anchors."""
    for i, x in enumerate(texts):
        data = np.frombuffer((x.as_py()).encode(), np.uint8)
        if len(data) >= length:
            rolled = Rolled(data)
            yield i, data, rolled, anchors(rolled, length, gram)


def _arrays(parts: list[list[np.ndarray]], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = [np.concatenate(p) if p else np.array([], np.int64) for p in zip(*parts, strict=True)] if parts else [np.array([], np.int64)] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _place(row: np.ndarray, first: np.ndarray) -> np.ndarray:
    return mixed(row.astype(np.uint64) + first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """row, start, stop: byte ranges of ``docs`` (row long, text string) that repeated windows cover; they may overlap."""
    context = docs.sparkSession.sparkContext

    def buckets(batches):
        for batch in batches:
            yield _arrays([[a[0]] for _, _, _, a in _suffixes(batch.column("text"), length, gram)], [pa.int64()], ["bucket"])

    counted = docs.select("text").mapInArrow(buckets, "bucket long").groupBy("bucket").agg(F.count("*").alias("n"))
    shared = context.broadcast(_filter(counted.filter("n > 1"), "bucket").words)

    def surroundings(batches):
        known = Filter(shared.value)
        for batch in batches:
            rows, parts = _u64(batch.column("row")), []
            for i, _, rolled, (grams, place, first, last) in _suffixes(batch.column("text"), length, gram):
                if len(k := np.flatnonzero(known.has(grams))):
                    grams, place, first, last = grams[k], place[k], first[k], last[k]
                    around = mixed(rolled.of(first, last + length) + mixed(((place - first) << 32 | (last - first)).astype(np.uint64)))
                    parts.append([grams, around, np.full(len(k), rows[i]), first, last])
            yield _arrays(parts, [pa.int64()] * 5, ["bucket", "around", "row", "first", "last"])

    members = written(docs.select("row", "text").mapInArrow(surroundings, "bucket long, around long, row long, first long, last long"))
    classes = written(members.groupBy("bucket", "around").agg(F.count("*").alias("n"), F.min(F.struct("row", "first")).alias("one")))
    whole = members.join(classes.filter("n > 1").select("bucket", "around"), ["bucket", "around"]).select("row", F.col("first").alias("start"), (F.col("last") + length).alias("stop"))
    open_buckets = classes.groupBy("bucket").agg(F.count("*").alias("k"), F.count_if(F.col("n") == 1).alias("lone")).filter("k > 1 and lone > 0")
    ones = written(classes.join(open_buckets, "bucket").select("bucket", "k", "one.row", "one.first"))
    if ones.isEmpty():
        return whole

    def hashes(batches):
        for batch in batches:
            yield _arrays([[_place(_u64(batch.column("row")), _u64(batch.column("first")))]], [pa.int64()], ["h"])

    wanted = context.broadcast(_filter(ones.select("row", "first").mapInArrow(hashes, "h long"), "h").words)

    def cut(batches):
        known = Filter(wanted.value)
        for batch in batches:
            rows, parts, around = _u64(batch.column("row")), [], []
            for i, data, _, (grams, _, first, last) in _suffixes(batch.column("text"), length, gram):
                k = np.flatnonzero(known.has(_place(np.full(len(first), rows[i]), first)))
                if len(k):
                    parts.append([grams[k], np.full(len(k), rows[i]), first[k]])
                    around += [data[a : b + length].tobytes() for a, b in zip(first[k], last[k], strict=True)]
            out = _arrays(parts, [pa.int64()] * 3, ["bucket", "row", "first"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(around, pa.binary())], ["bucket", "row", "first", "around"])

    pieces = docs.select("row", "text").mapInArrow(cut, "bucket long, row long, first long, around binary")
    pieces = pieces.join(ones.select("bucket", "row", "first", "k").distinct(), ["bucket", "row", "first"]).dropDuplicates(["bucket", "row", "first"])
    pieces = written(pieces)
    few = pieces.filter(F.col("k") <= GATHER).select("bucket", "row", "first", "around").repartition("bucket").sortWithinPartitions("bucket")

    def compared(batches):
        held: list[tuple] = []
        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in ("bucket", "row", "first", "around")), strict=True):
                if len(held) >= STEP and x[0] != held[-1][0]:
                    yield _repeated(held, length)
                    held = []
                held.append(x)
        if held:
            yield _repeated(held, length)

    found = whole.union(few.mapInArrow(compared, "row long, start long, stop long"))
    many = pieces.filter(F.col("k") > GATHER)
    if not many.isEmpty():
        found = found.union(_counted(many, length))
    return found


def _windows(around: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each window of each piece, and which piece and which window of it."""
    sizes = np.array([len(x) for x in around])
    n = sizes - length + 1
    piece = np.repeat(np.arange(len(around)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(np.cumsum(sizes) - sizes, n) + k
    return Rolled(np.frombuffer(b"".join(around), np.uint8)).of(start, start + length), piece, k


def _repeated(held: list[tuple], length: int) -> pa.RecordBatch:
    h, piece, k = _windows([x[3] for x in held], length)
    _, back, counts = np.unique(h, return_inverse=True, return_counts=True)
    twice = counts[back] > 1
    row, first = np.array([x[1] for x in held], np.int64), np.array([x[2] for x in held], np.int64)
    at = np.flatnonzero(twice)
    new = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(piece[at], prepend=-1) != 0))
    end = np.append(new[1:], len(at)) - 1 if len(at) else new
    a, b = at[new], at[end]
    return _arrays([[row[piece[a]], first[piece[a]] + k[a], first[piece[b]] + k[b] + length]], [pa.int64()] * 3, ["row", "start", "stop"])


def _counted(pieces: DataFrame, length: int) -> DataFrame:
    """The same for buckets of any size: a row for each window, counted and joined by its hash."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                part = batch.slice(i, STEP)
                h, piece, k = _windows(part.column("around").to_pylist(), length)
                yield _arrays([[h, _u64(part.column("row"))[piece], _u64(part.column("first"))[piece] + k.astype(np.uint64)]], [pa.int64()] * 3, ["h", "row", "start"])

    windows = written(pieces.mapInArrow(run, "h long, row long, start long"))
    twice = windows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    return windows.join(twice, "h").select("row", "start", (F.col("start") + length).alias("stop"))


def _kept(raw: bytes, spans: list | None) -> tuple[bytes, int]:
    """What is left, and how many maximal runs went."""
    out, at, runs = [], 0, 0
    for start, stop in sorted((s["start"], s["stop"]) for s in spans or ()):
        if start > at or not runs:
            out.append(raw[at:start])
            runs += 1
        at = max(at, stop)
    return b"".join((*out, raw[at:])), runs


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, n_spans for every row."""
    rows = id_text(docs).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    spans = repeated_spans(rows, length, gram).distinct().groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def run(batches):
        for batch in batches:
            raw = [x.as_py().encode() for x in batch.column("text")]
            kept = [_kept(r, s.as_py()) for r, s in zip(raw, batch.column("spans"), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([k[0] for k in kept], pa.binary()), pa.array([len(r) for r in raw], pa.int64()), pa.array([len(r) - len(k[0]) for r, k in zip(raw, kept, strict=True)], pa.int64()), pa.array([k[1] for k in kept], pa.int64())],
                ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    return rows.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
