"""op13 against plain counting of all phrases."""

import random
import re
from collections import Counter

import pytest

from lacuna.llm import phrases


def plain(docs, least, first=2000, longest=5):
    counts, totals = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    held = [(k, p, a) for (k, p), a in counts.items() if len(p) > 1 and a >= least]
    out = []
    for lang, p, a in held:
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(k == lang and len(q) > len(p) and 100 * f >= 100 * a and inside(q) for k, q, f in held):  # noqa: B023
            continue
        n = totals[lang]
        score, cut = min((1000 * a * n // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, counts[lang, p[:cut]], counts[lang, p[cut:]], n, score))
    ranked = []
    for lang in {x[0] for x in out}:
        best = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(x[0], i, *x[1:]) for i, x in enumerate(best[:first], 1)]
    return sorted(ranked)


def mined(spark, docs, **how):
    frame = spark.createDataFrame([(i, *d, "clash") for i, d in enumerate(docs)], "doc_id long, lang string, text string, block string")
    got = phrases.collocations(frame, **how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("block_bytes", [1, 4_000, 16 << 20])
def test_equals_plain_counting(spark, block_bytes):
    rng = random.Random(5)
    words = ["a", "b", "B", "ccc", "é", "x\x85y", "zz\x01", "d-d", "\xa0"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ", ", "\n", "?!", "; "]) for _ in range(rng.randrange(400)))
    docs = [(rng.choice(["en", "de", None, "und"]), text()) for _ in range(60)] + [("en", None), ("fr", ""), ("fr", " ,,; \n"), (None, None)]
    docs += [("en", "new york city hall was here. " * 40)] + [("en", "the very same row of words")] * 30
    assert mined(spark, docs, least=12, block_bytes=block_bytes) == plain(docs, 12)


def test_first_ties_and_covered_phrases(spark):
    docs = [("en", "p q. r s. " * 10 + "t u v. " * 10 + "t u. " * 1)]
    assert mined(spark, docs, least=5) == plain(docs, 5)
    assert [x[2] for x in mined(spark, docs, least=5, first=2)] == ["p q", "r s"]
    assert "u v" not in [x[2] for x in mined(spark, docs, least=5)]


def test_products_beyond_64_bits(spark):
    """Counts of 10^12 words: the cut is exact where a product of three counts passes 64 bits."""
    rows = [(10**12, 7 * 10**12, 3 * 10**12, 10**13 + 1)]
    expr = "(1000 * cast(f as decimal(38, 0)) * cast(n as decimal(20, 0))) div (cast(l as decimal(20, 0)) * cast(r as decimal(20, 0)))"
    f, left, right, n = rows[0]
    assert spark.createDataFrame(rows, "f long, l long, r long, n long").selectExpr(expr).first()[0] == 1000 * f * n // (left * right)


def test_nothing_to_find(spark):
    assert mined(spark, []) == [] and mined(spark, [("en", "a b c"), (None, None)]) == []
