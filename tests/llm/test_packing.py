"""op11: every piece once, without gaps or overlaps, near the fewest sequences, with the tokenizers library's ids."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lacuna.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def packed(spark, docs, parts=3, **how):
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, key string, fill int")
    return packing.pack(frame.repartition(parts), PATH, **how).collect()


def hold_together(rows, capacity):
    """The number of sequences; each is gapless from 0 and none is over capacity."""
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("how", [{}, {"batch": 7, "node": 5}, {"capacity": 16, "batch": 20, "node": 30, "free": 0}])
def test_pieces_are_the_documents(spark, how):
    rng = random.Random(11)
    words = ["alpha", " beta", "ß", "\n", "  ", "12", "<|endoftext|>", "日本"]
    docs = [(i % 50, "".join(rng.choice(words) + " " for _ in range(rng.choice([0, 1, 5, 40, 300, 1500])))) for i in range(70)] + [(99, None), (None, ""), (None, "x"), (7, "same"), (7, "same")]
    rows, capacity = packed(spark, docs, **how), how.get("capacity", packing.CAPACITY)
    hold_together(rows, capacity)
    library, want = Tokenizer.from_file(PATH), []
    library.no_truncation()
    library.no_padding()
    for doc_id, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, packing.END]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("lengths", ["even", "halves", "none fits", "light"])
def test_near_the_fewest_sequences(spark, lengths):
    rng = random.Random(2)
    draw = {"even": lambda: rng.randint(1, 99), "halves": lambda: rng.choice([30, 40, 55, 70]), "none fits": lambda: rng.choice([60, 61]), "light": lambda: rng.randint(1, 6)}[lengths]
    docs = [(i, " the" * draw()) for i in range(4_000)]
    rows = packed(spark, docs, parts=4, capacity=100, batch=1000, node=300, free=1)
    sizes = np.array([r.length for r in rows])
    alone = len(set(packing.best_fit(sizes, 100).tolist()))
    assert len(rows) == 4_000 and -(-int(sizes.sum()) // 100) <= hold_together(rows, 100) <= 1.01 * alone + 1


def test_best_fit_is_best_fit():
    rng = random.Random(4)
    for _ in range(50):
        sizes = np.array([rng.randint(1, 20) for _ in range(rng.randint(0, 60))], np.int64)
        room, want = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [b for b in range(len(room)) if room[b] >= sizes[i]]
            at = min(fits, key=lambda b: room[b], default=len(room))
            if at == len(room):
                room.append(20)
            room[at], want[i] = room[at] - sizes[i], at
        bins = packing.best_fit(sizes, 20)
        fills = lambda b: sorted(np.bincount(b, sizes).tolist()) if len(sizes) else []
        assert fills(bins) == fills(np.array(want, np.int64))


def test_empty_table(spark):
    assert packed(spark, []) == []
