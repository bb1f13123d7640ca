"""BPE encoding and decoding over a table of distinct words.

Encoding takes three steps in Spark:

1. Texts are split into words. A block of texts (about ``BLOCK_BYTES``, always whole texts) lists its distinct words once,
   and each of its texts becomes the places of its words in that list.
2. A list is cut into packs by a hash of the word. Packs of one hash bucket meet in one task, bucket after bucket: the word
   table, in which each distinct word is encoded once. A task holds the words of one bucket at a time; ``BUCKETS`` bounds them.
3. The ids go back to the blocks in packs, and to the texts by block and place.

So a shuffle carries a word once for each block that has it, not once for each time it occurs. Lists and places come from two
readings of the rows. Rows that come ``from_files`` are in the same order in both; others are written to a table first. A
digest of a block's texts goes along with both, so that another order would fail and never give wrong ids.

Decoding joins ids to the vocabulary's table of pieces, which is fixed (50,257 entries) and goes to all tasks.

Defined results: null text counts as empty; an empty text has no ids; the string of a special token in a text gives that
token's id, as the tokenizers library does; repeated rows give repeated rows; other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from lacuna.llm.common import id_text
from lacuna.operators.lineage import written

#: A block is closed at so many bytes of text, or so many distinct words; bounds memory, not results.
BLOCK_BYTES, BLOCK_WORDS = 12 << 20, 150_000
#: Hash buckets of the word table, at least; a task holds the words of one bucket at a time.
BUCKETS = 256
#: Packs that leave a task at once.
LISTED = 64

#: Fixed value: the vocabulary's word pattern, with its most frequent alternative first (alternatives start differently).
WORDS = r" ?\p{L}+|'(?:s|t|re|ve|m|ll|d)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same classes for texts within U+0000..U+01BF that hold no numbers but 0-9, for the faster engine.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ƿ"
_SPACES = "\t-\r \x85\xa0"
_NEAR = re.compile(rf" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^{_SPACES}0-9{_LETTERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
_FAR = re.compile("[^\\0-ƺ]|[\xb2\xb3\xb9\xbc-\xbe]")


def _bytes_of_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, others from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Splitter:
    """Splits texts into words; a special token is a word of its own, which no other word equals."""

    def __init__(self, special: dict[str, int]):
        import regex

        self.special = special
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.far = regex.compile(WORDS)

    def words(self, text: str) -> list[str]:
        if self.split_special is not None and any(s in text for s in self.special):
            return [w for x in self.split_special.split(text) for w in ([x] if x in self.special else self._plain(x))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        return (self.far if not text.isascii() and _FAR.search(text) else _NEAR).findall(text)


class Encoder:
    """Ids of a word, by a byte-level BPE file of the tokenizers library."""

    def __init__(self, definition: str, special: dict[str, int]):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.special, self.model = special, Tokenizer.from_str(definition).model
        self.chars = {b: c for c, b in _bytes_of_chars().items()}

    def word_ids(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        chars = word.encode().decode("latin-1").translate(self.chars)
        return [t.id for t in self.model.tokenize(chars)]


class Pieces:
    """The table of pieces: where the bytes of each id lie in one block, and how many they are."""

    def __init__(self, definition: str, special: dict[str, int]):
        from tokenizers import Tokenizer

        byte, bpe = _bytes_of_chars(), Tokenizer.from_str(definition)
        pieces = dict.fromkeys(range(bpe.get_vocab_size(with_added_tokens=True)), b"")
        for token, i in bpe.get_vocab(with_added_tokens=True).items():
            pieces[i] = token.encode() if token in special else bytes(byte[c] for c in token)
        self.block = np.frombuffer(b"".join(pieces[i] for i in range(len(pieces))), np.uint8)
        self.lengths = np.array([len(pieces[i]) for i in range(len(pieces))])
        self.starts = np.cumsum(self.lengths) - self.lengths

    def text(self, ids: np.ndarray) -> str:
        return _gathered(self.block, self.starts, self.lengths, ids).tobytes().decode("utf-8", "replace")


def _gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of values that begin at starts and have these lengths, in the order of which."""
    n = lengths[which]
    at = np.repeat(starts[which] - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return values[at]


def _definition(path: str) -> tuple[str, dict[str, int]]:
    """The tokenizer's file and its special tokens."""
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    return definition, {x["content"]: x["id"] for x in json.loads(definition)["added_tokens"]}


class _Blocks:
    """Gives each text of a task its block and the places of its words in the block's list of distinct words."""

    def __init__(self, special: dict[str, int], bounds: tuple[int, int]):
        self.splitter, self.part, self.number = Splitter(special), TaskContext.get().partitionId() << 32, -1
        self.bounds, self.full = bounds, True

    def add(self, text: str) -> np.ndarray:
        import xxhash

        if self.full:
            self.number, self.words, self.size, self.chain, self.n, self.full = self.number + 1, {}, 0, 0, 0, False
        words, table = self.splitter.words(text), self.words
        places = np.fromiter((table.setdefault(w, len(table)) for w in words), np.uint32, len(words))
        raw = text.encode()
        self.n, self.size = self.n + 1, self.size + len(raw)
        self.chain = xxhash.xxh64_intdigest(raw, self.chain)
        self.full = self.size >= self.bounds[0] or len(table) >= self.bounds[1]
        return places

    @property
    def name(self) -> int:
        return self.part | self.number

    @property
    def digest(self) -> int:
        """Of the block's texts so far, in their order."""
        return self.chain - (self.chain >> 63 << 64)


def _planes(places: np.ndarray) -> bytes:
    """All first bytes, then all second bytes and so on: places are small numbers, so the later planes are mostly 0."""
    return places.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _of_planes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


@functools.lru_cache(maxsize=1)
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _pressed(*parts: bytes) -> bytes:
    """The parts and their lengths, compressed."""
    sizes = np.array([len(parts), *map(len, parts)], "<u4")
    return _zstd()[0].compress(b"".join((sizes.tobytes(), *parts)))


def _parts(raw: bytes) -> list[bytes]:
    data = _zstd()[1].decompress(raw)
    sizes = np.frombuffer(data, "<u4", int.from_bytes(data[:4], "little"), 4)
    ends = np.cumsum(sizes, dtype=np.int64) + 4 * (len(sizes) + 1)
    return [data[e - n : e] for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def _packs(words: list[str], buckets: int):
    """(bucket, places of its words in the list, the words in UTF-8) for each hash bucket that has words."""
    raw = [w.encode() for w in words]
    bucket = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw)) % np.uint32(buckets)
    order = np.argsort(bucket, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(raw) else ():
        yield int(bucket[places[0]]), places, [raw[i] for i in places.tolist()]


def _placed(rows: DataFrame, special: dict[str, int], bounds: tuple[int, int]) -> DataFrame:
    """The rows with, instead of their text, their block, their place in it, its digest so far, and the places of their words."""
    kept = rows.columns[:-1]
    more = [StructField("__block", LongType()), StructField("__nth", LongType()), StructField("__digest", LongType()), StructField("__places", BinaryType())]

    def run(batches):
        blocks = _Blocks(special, bounds)
        for batch in batches:
            found = []
            for x in batch.column(batch.num_columns - 1):
                coded = _pressed(_planes(blocks.add(x.as_py())))
                found.append((blocks.name, blocks.n, blocks.digest, coded))
            if found:
                columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*kept, *(f.name for f in more)])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], *more]))


def _word_table(rows: DataFrame, definition, special: dict[str, int], bounds: tuple[int, int]) -> DataFrame:
    """__of (the block), __digest and __pack (places in its list, numbers of ids, ids) for every pack of the blocks' lists."""
    buckets = max(BUCKETS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names, kinds = ["__of", "__digest", "__bucket", "__pack"], (pa.int64(), pa.int64(), pa.int32(), pa.binary())

    def listed(batches):
        blocks = _Blocks(special, bounds)

        def told():
            packs = []
            for bucket, places, raw in _packs(list(blocks.words), buckets):
                steps, lengths = np.diff(places, prepend=0), np.array([len(w) for w in raw])
                packs.append((blocks.name, blocks.digest, bucket, _pressed(_planes(steps), _planes(lengths), b"".join(raw))))
            for i in range(0, len(packs), LISTED):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*packs[i : i + LISTED], strict=True), kinds, strict=True)], names)

        for batch in batches:
            for x in batch.column(0):
                blocks.add(x.as_py())
                if blocks.full:
                    yield from told()
        if not blocks.full:
            yield from told()

    def encoded(batches):
        encoder, known, of = Encoder(definition.value, special), {}, None
        for batch in batches:
            found = []
            for bucket, x in zip(batch.column("__bucket").to_pylist(), batch.column("__pack"), strict=True):
                if bucket != of:
                    of, known = bucket, {}
                steps, lengths, raw = _parts(x.as_py())
                ends = np.cumsum(_of_planes(lengths), dtype=np.int64).tolist()
                ids = []
                for a, b in zip([0, *ends], ends, strict=False):
                    word = raw[a:b]
                    if (got := known.get(word)) is None:
                        got = known[word] = array("I", encoder.word_ids(word.decode()))
                    ids.append(got)
                flat = np.frombuffer(b"".join(ids), np.uint32)
                found.append(_pressed(steps, _planes(np.array([len(x) for x in ids])), _planes(flat)))
            yield pa.RecordBatch.from_arrays([batch.column("__of"), batch.column("__digest"), pa.array(found, pa.binary())], ["__of", "__digest", "__pack"])

    packs = rows.select("__text").mapInArrow(listed, "__of long, __digest long, __bucket int, __pack binary")
    return packs.repartition("__bucket").sortWithinPartitions("__bucket").mapInArrow(encoded, "__of long, __digest long, __pack binary")


def _joined(docs: DataFrame, tokenizer_path: str, carried: list[str], found: list[StructField], describe, from_files: bool, bounds: tuple[int, int]) -> DataFrame:
    """The carried columns and what ``describe`` (ids of each text) gives, for every row; ``docs`` has these columns, then the text."""
    definition, special = _definition(tokenizer_path)
    numbered = docs.toDF(*[f"__{i}" for i in range(len(carried))], "__text")
    rows = numbered.withColumn("__text", F.coalesce("__text", F.lit("")))
    if not from_files:
        rows = written(rows)
    model = docs.sparkSession.sparkContext.broadcast(definition)
    names = rows.columns[:-1]
    schema = StructType([*[StructField(c, f.dataType) for c, f in zip(carried, rows.schema.fields, strict=False)], *found])

    def run(texts: pa.Table, entries: pa.Table) -> pa.Table:
        packs = [_parts(p) for p in entries.column("__pack").to_pylist()]
        last = texts.column("__digest").to_pylist()[int(np.argmax(texts.column("__nth").to_numpy()))] if len(texts) else None
        if texts.num_rows and set(entries.column("__digest").to_pylist()) - {last}:
            raise RuntimeError("the rows came in another order when they were read again; encode them with from_files=False")
        all_of = lambda arrays, kind: np.concatenate([np.array([], kind), *arrays])
        order = np.argsort(all_of([np.cumsum(_of_planes(p[0]), dtype=np.int64) for p in packs], np.int64))
        lengths, values = all_of([_of_planes(p[1]).astype(np.int64) for p in packs], np.int64), all_of([_of_planes(p[2]) for p in packs], np.uint32)
        del packs
        starts = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        ids = (_gathered(values, starts, lengths, _of_planes(_parts(p.as_py())[0])) for p in texts.column("__places"))
        return pa.Table.from_arrays([*(texts.column(c) for c in names), *describe(ids)], schema.fieldNames())

    return _placed(rows, special, bounds).groupBy("__block").cogroup(_word_table(rows, model, special, bounds).groupBy("__of")).applyInArrow(run, schema)


def _id_lists(ids) -> list[pa.Array]:
    ids = list(ids)
    ends = np.cumsum([0, *map(len, ids)])
    return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.array([], np.uint32), *ids]).astype(np.int32)))]


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *carried: str, from_files: bool = False, bounds: tuple[int, int] = (BLOCK_BYTES, BLOCK_WORDS)) -> DataFrame:
    """doc_id, carried columns and ids. The tokenizer's file is read by the driver and goes to the tasks."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *carried, F.col(text_col))
    return _joined(rows, tokenizer_path, ["doc_id", *carried], [StructField("ids", ArrayType(IntegerType()))], _id_lists, from_files, bounds)


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and the text of its ids (null: empty)."""
    table = encoded.sparkSession.sparkContext.broadcast(Pieces(*_definition(tokenizer_path)))

    def run(batches):
        pieces = table.value
        for batch in batches:
            texts = [pieces.text(np.asarray(x.as_py() or [], np.int64)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer_path: str, from_files: bool = False, bounds: tuple[int, int] = (BLOCK_BYTES, BLOCK_WORDS)) -> DataFrame:
    """Per row: number of ids, digest of the ids, digest of the text decoded from them."""
    table = docs.sparkSession.sparkContext.broadcast(Pieces(*_definition(tokenizer_path)))
    found = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]

    def digests(ids) -> list[pa.Array]:
        pieces = table.value
        rows = [(len(x), hashlib.sha256(x.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(pieces.text(x).encode()).hexdigest()) for x in ids]
        return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]

    return _joined(id_text(docs), tokenizer_path, ["doc_id"], found, digests, from_files, bounds)
