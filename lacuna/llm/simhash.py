"""SimHash near-duplicates over a byte-position inverted index with count filtering.

A fingerprint has 8 bytes; 2 differing bits touch at most 2 of them, so linked fingerprints agree in at least 6 byte
positions. The positions stand in 4 pairs, of which linked fingerprints agree in 2 whole ones: the index keys each distinct
fingerprint by every choice of 2 pairs with their 4 bytes (6 postings). Of two fingerprints of a posting, the bytes that they
share by position are tallied; pairs that reach the guaranteed minimum of 6 are verified by their bits.

A posting of more than ``MOST`` fingerprints (a large group of near copies) is not tallied by pairs. It is cut again by every
choice of 2 more positions: such a part shares 6 positions, which is the minimum, and holds at most 65,536 fingerprints,
whatever the corpus; there each member looks up the masks of 1 or 2 bits of the other two bytes. Only links that join a
posting's own groups leave it, so no group of copies is expanded into pairs.

Defined results: null and wordless texts have fingerprint zero, which links like any other; repeated rows are copies;
documents with null doc_id keep their row and never give a component its id (without any other, it has none); other columns
are not looked at.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import id_text
from lacuna.operators.components import connected_components
from lacuna.operators.lineage import written
from lacuna.operators.skew import join_per_key

SEED = 42
BLOCK = 65_536
#: Fingerprints of a posting up to which its pairs are tallied.
MOST = 1_024
PAIRS = ((0, 1), (2, 3), (4, 5), (6, 7))


def shingle_hashes(text: str, words_each: int = 3) -> np.ndarray:
    """XXH64 of each word shingle, repeats included."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.array([], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - words_each + 1)
    stops = ends[min(words_each, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops, strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have, as a signed 64-bit integer."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i : i + BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def fingerprint(text: str, words_each: int = 3) -> int:
    return majority(shingle_hashes(text, words_each))


def fingerprints(docs: DataFrame, words_each: int = 3) -> DataFrame:
    """doc_id, fp for every row."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(x.as_py(), words_each) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return id_text(docs).mapInArrow(run, "doc_id long, fp long")


def _masks(bits: int) -> list[int]:
    """All ways to differ in 1 up to ``bits`` of 16 bits."""
    return [sum(1 << i for i in c) for k in range(1, bits + 1) for c in combinations(range(16), k)]


def _spread(mask: int, low: int, high: int) -> int:
    return (mask & 0xFF) << 8 * low | mask >> 8 << 8 * high


def _grouped(members: list[int], near) -> list[tuple[int, int]]:
    """Each member that the near pairs tie to a smaller one, with the smallest that it reaches."""
    root = {x: x for x in members}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in near:
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(x, r) for x in members if (r := find(x)) != x]


def _tallied(members: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links inside a posting: pairs that share ``8 - bits`` bytes by position or more, verified by their bits."""
    raw, near = members.view(np.uint8).reshape(-1, 8), []
    for i in range(len(members) - 1):
        shared = (raw[i + 1 :] == raw[i]).sum(1)
        at = np.flatnonzero(shared >= 8 - bits) + i + 1
        at = at[np.bitwise_count(members[at].view(np.uint64) ^ members[i : i + 1].view(np.uint64)) <= bits]
        near += [(int(members[i]), int(members[j])) for j in at]
    return _grouped(members.tolist(), near)


def _looked_up(members: list[int], positions: tuple[int, int], masks: list[int]) -> list[tuple[int, int]]:
    """Links inside a part whose members differ in two positions only."""
    present, wide = {m & 0xFFFFFFFFFFFFFFFF: m for m in members}, [_spread(mask, *positions) for mask in masks]
    return _grouped(members, ((present[x], present[y]) for x in present for mask in wide if (y := x ^ mask) < x and y in present))


def _keep(positions) -> int:
    mask = sum(0xFF << 8 * p for p in positions)
    return mask - (mask >> 63 << 64)


def _keyed(rows: DataFrame, choices: list[tuple[int, ...]]) -> DataFrame:
    """The rows once for each choice of positions: its number and the bytes of these positions."""
    each = F.explode(F.array(*[F.struct(F.lit(c).cast("byte").alias("c"), F.col("fp").bitwiseAND(F.lit(_keep(at))).alias("key")) for c, at in enumerate(choices)]))
    return rows.select("fp", each.alias("k")).select("fp", "k.c", "k.key")


def links(distinct: DataFrame, bits: int = 2, most: int = MOST) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that connect whatever differs in ``bits`` (1 or 2) bits or fewer."""
    if bits not in (1, 2):
        raise ValueError("bits must be 1 or 2")
    halves = [x + y for x, y in combinations(PAIRS, 2)]
    # Postings by a hash of choice and bytes: where two coincide, the tally tells their members apart.
    posted = _keyed(distinct, halves).select("fp", F.xxhash64("c", "key").alias("posting"))
    sizes = posted.groupBy("posting").agg(F.count("*").alias("n")).filter("n > 1")
    small = posted.join(sizes.filter(F.col("n") <= most).drop("n"), "posting").groupBy("posting").agg(F.collect_list("fp").alias("members"))
    schema, masks = "a long, b long", _masks(bits)

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    def tallied(batches):
        for batch in batches:
            yield batch_of([x for m in batch.column("members") for x in _tallied(m.values.to_numpy().copy(), bits)])

    found = small.select("members").mapInArrow(tallied, schema)
    large = join_per_key(posted, sizes.filter(F.col("n") > most), "posting", len(halves) * distinct.count()).select("fp").distinct()
    sixes = [x for x in combinations(range(8), 6)]

    def looked_up(batches):
        for batch in batches:
            free = [tuple(p for p in range(8) if p not in sixes[c]) for c in batch.column("c").to_pylist()]
            yield batch_of([x for at, m in zip(free, batch.column("members").to_pylist(), strict=True) for x in _looked_up(m, at, masks)])

    parts = _keyed(large, sixes).groupBy("c", "key").agg(F.collect_list("fp").alias("members")).filter(F.size("members") > 1)
    return found.union(parts.select("c", "members").mapInArrow(looked_up, schema))


def near_duplicates(docs: DataFrame, words_each: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id that links reach, for every row."""
    marked = written(fingerprints(docs, words_each))
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    spread = distinct.select("fp").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    parts = connected_components(links(spread, bits))
    rooted = distinct.join(parts, distinct.fp == parts.node, "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    of = written(join_per_key(rooted.select("fp", "root", F.col("n").alias("rows")), lowest, "root", distinct.count()).select("fp", "component_id", F.col("rows").alias("n")))
    found = join_per_key(marked, of, "fp", marked.count())
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
