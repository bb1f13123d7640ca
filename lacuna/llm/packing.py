"""Best-fit packing of documents into sequences, by hierarchical residual packing.

A task encodes its texts, cuts long ones into pieces and packs each batch of pieces by best fit, largest first. Nearly full
sequences are done where they are. The others go up a tree of nodes: in a round, each node takes the underfull bins of its
children, fits them into one another as they are, opens those that are still underfull, fits their pieces again, and hands
up what is not nearly full. The tree is as wide as its rows need (``NODE`` pieces a node) and at least halves each round; it
ends at its root, or where a node would get more than ``CROWDED`` times as many pieces because most fit nowhere, as they are
then. So no task holds more than that on average. What travels is a key and a length for each piece, never its ids.

A piece's ids are bytes in its task only (of little-endian machines); its row has their digest. Words are encoded once a worker,
as far as ``WORDS`` of them are remembered, by the same splitter and model as ``bpe``.

Defined results: null or empty text is one piece, the end mark alone; rows that share doc_id, or have none, are documents of
their own; equal lengths are packed in the order of rows; an empty table gives no rows; other columns are not looked at.
Numbers of sequences depend on how the rows are dealt to tasks; lengths, places and digests do not.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.bpe import Encoder, Splitter, _definition
from lacuna.llm.common import id_text
from lacuna.operators.lineage import written

CAPACITY, END = 1_024, 2
#: A sequence is nearly full, and done, if so few of its places are free.
FREE = 4
#: Pieces of a batch in a task, and of a node of the tree: bound memory and may change which pieces meet, not what is packed.
BATCH, NODE, CROWDED = 100_000, 20_000, 4
#: Words whose ids a worker remembers.
WORDS = 400_000


class _Words(dict):
    """The ids of a word as bytes, encoded when first asked for."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS:
            self.clear()
        self[word] = ids = array("I", self.encoder.word_ids(word)).tobytes()
        return ids


@lru_cache(maxsize=1)
def _words(definition: str, special: tuple[tuple[str, int], ...]) -> _Words:
    """One a worker process, so that tasks after the first know the common words."""
    return _Words(Encoder(definition, dict(special)))


def cut(tokens: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of each piece; all but the first are full where there are several."""
    first = (tokens - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, tokens, capacity))]


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each item, largest first, each into the fullest bin that has room for it."""
    bins, rooms, mask, n = np.empty(len(sizes), np.int64), [[] for _ in range(capacity + 1)], 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        if room := mask >> size:
            room = (room & -room).bit_length() - 1 + size
            at = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            room, at, n = capacity, n, n + 1
        bins[i] = at
        if room > size:
            rooms[room - size].append(at)
            mask |= 1 << (room - size)
    return bins


def refit(bins: np.ndarray, sizes: np.ndarray, capacity: int = CAPACITY, free: int = FREE) -> np.ndarray:
    """The new bin of each piece: bins are fitted into one another, then those still underfull are opened and fitted again."""
    bins = np.unique(bins, return_inverse=True)[1]
    bins = best_fit(np.bincount(bins, sizes).astype(np.int64), capacity)[bins]
    under = np.flatnonzero(np.bincount(bins, sizes)[bins] < capacity - free)
    opened = best_fit(sizes[under], capacity)
    if len(np.unique(opened)) <= len(np.unique(bins[under])):
        bins[under] = opened + bins.max(initial=-1) + 1
    return np.unique(bins, return_inverse=True)[1]


def _placed(bins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each piece's offset in its bin, in the order of rows, and the fill of its bin."""
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(sizes[order])
    first = np.flatnonzero(np.diff(bins[order], prepend=-1))
    offsets = np.empty(len(bins), np.int64)
    offsets[order] = ends - sizes[order] - np.repeat((ends - sizes[order])[first], np.diff(np.append(first, len(bins))))
    return offsets, np.bincount(bins, sizes)[bins].astype(np.int64) if len(bins) else offsets


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, key long, node long, sequence_id long, offset long, fill long"
_NAMES = [x.split()[0] for x in _PIECE.split(", ")]
_TYPES = [pa.int32() if x.endswith(" int") else pa.int64() for x in _PIECE.split(", ")]


def _local(docs: DataFrame, tokenizer_path: str, capacity: int, end: int, batch_pieces: int) -> DataFrame:
    """All pieces with their place in a sequence of their own batch."""
    definition, special = _definition(tokenizer_path)
    model = docs.sparkSession.sparkContext.broadcast(definition)
    mark = end.to_bytes(4, "little")

    def fitted(rows: list[tuple], number: int) -> pa.RecordBatch:
        doc, piece, start, length, crc = (list(x) for x in zip(*rows, strict=True))
        sizes = np.array(length, np.int64)
        bins, part = np.empty(len(sizes), np.int64), np.flatnonzero(sizes < capacity)
        bins[part] = best_fit(sizes[part], capacity)
        whole = np.flatnonzero(sizes == capacity)
        bins[whole] = bins[part].max(initial=-1) + 1 + np.arange(len(whole))
        offsets, fill = _placed(bins, sizes)
        first = number << 24
        columns = [doc, piece, start, sizes, crc, first + np.arange(len(sizes)), np.full(len(sizes), number), first + bins, offsets, fill]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _TYPES, strict=True)], _NAMES)

    def run(batches: Iterable[pa.RecordBatch]):
        splitter, words, rows, number = Splitter(special), _words(model.value, tuple(special.items())), [], TaskContext.get().partitionId() << 16
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = b"".join(map(words.__getitem__, splitter.words(text.as_py()))) + mark
                rows += ((doc_id, i, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cut(len(ids) // 4, capacity)))
                if len(rows) >= batch_pieces:
                    yield fitted(rows, number)
                    rows, number = [], number + 1
        if rows:
            yield fitted(rows, number)

    return id_text(docs).mapInArrow(run, _PIECE)


def _round(bins: DataFrame, number: int, width: int, capacity: int, free: int) -> DataFrame:
    """The underfull bins' pieces with a new place each, packed by node."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key")
        sizes, node = rows.column("length").to_numpy(), rows.column("node")[0].as_py()
        fitted = refit(rows.column("sequence_id").to_numpy(), sizes, capacity, free)
        offsets, fill = _placed(fitted, sizes)
        ids = -1 - (number << 50 | node << 24) - fitted
        return pa.Table.from_arrays([rows.column("key"), rows.column("node"), rows.column("length"), *map(pa.array, (ids, offsets, fill))], ["key", "node", "length", "sequence_id", "offset", "fill"])

    up = bins.select("key", F.pmod("node", F.lit(width)).alias("node"), "length", "sequence_id")
    return up.groupBy("node").applyInArrow(run, "key long, node long, length long, sequence_id long, offset long, fill long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, free: int = FREE, batch: int = BATCH, node: int = NODE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    pieces = written(_local(docs, tokenizer_path, capacity, end, batch))
    under = F.col("fill") < capacity - free
    open_bins = pieces.filter(under).select("key", F.abs(F.xxhash64("node") % (1 << 26)).alias("node"), "length", "sequence_id")
    moved, n, width, number = [], open_bins.count(), 1 << 26, 0
    while n:
        width = min(width // 2, 1 << max(0, -(-n // node) - 1).bit_length())
        fitted = written(_round(open_bins, number, width, capacity, free))
        left = fitted.filter(under).count()
        last = width == 1 or left > CROWDED * node * (width // 2)
        n = 0 if last else left
        moved.append((fitted if last else fitted.filter(~under)).select("key", "sequence_id", "offset"))
        open_bins, number = fitted.filter(under), number + 1
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    done = pieces.filter(~under).select(columns)
    for places in moved:
        done = done.union(pieces.filter(under).drop("sequence_id", "offset").join(places, "key").select(columns))
    return done
