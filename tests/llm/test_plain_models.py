"""The learned parts against plain loops: EM over rows, the scorer's steps one number at a time, convolution by nested loops."""

import math
import random

import numpy as np

from lacuna.llm import language, quality


def plain_em(rows, rounds):
    """Over single rows of votes, not over counted combinations."""
    good = [0.1 if any(v < 0 for v in r) else 0.9 for r in rows]
    for _ in range(rounds):
        prior = (sum(good) + 1) / (len(rows) + 2)
        table = [[[1.0, 1.0] for _ in rows[0]] for _ in range(2)]
        for r, g in zip(rows, good, strict=True):
            for p, v in enumerate(r):
                if v:
                    table[0][p][v > 0] += 1 - g
                    table[1][p][v > 0] += g
        table = [[[x / sum(cell) for x in cell] for cell in side] for side in table]
        good = []
        for r in rows:
            bad_log, good_log = math.log(1 - prior), math.log(prior)
            for p, v in enumerate(r):
                if v:
                    bad_log += math.log(table[0][p][v > 0])
                    good_log += math.log(table[1][p][v > 0])
            good.append(1 / (1 + math.exp(bad_log - good_log)))
    return prior, table, good


def test_em_on_counts_equals_em_on_rows():
    rng = random.Random(3)
    truth = [rng.random() < 0.7 for _ in range(300)]
    rows = [[rng.choice([0, 1 if (rng.random() < 0.8) == t else -1]) for _ in range(4)] for t in truth]
    patterns, counts = np.unique(np.array(rows), axis=0, return_counts=True)
    prior, table = quality.fit_labellers(patterns, counts.astype(float), rounds=12)
    want_prior, want_table, want_good = plain_em(rows, 12)
    assert np.isclose(prior, want_prior) and np.allclose(table, want_table)
    assert np.allclose(quality.posterior(np.array(rows), prior, table), want_good)
    assert np.mean([(g > 0.5) == t for g, t in zip(want_good, truth, strict=True)]) > 0.8


def test_scorer_equals_plain_steps():
    rng = random.Random(5)
    rows = []
    for k in range(30):
        i = np.array(sorted(rng.sample(range(1 << quality.GRAM_BITS), 6)), np.uint16)
        rows.append((i, np.array([rng.random() for _ in i], np.float32), 0.9 if k % 2 else 0.1))
    w, b, seen, seen_b = {}, 0.0, {}, 1e-8
    draw = np.random.default_rng(quality.SEED)
    for _ in range(quality.EPOCHS):
        for k in draw.permutation(len(rows)):
            i, x, y = rows[k]
            total = sum(w.get(int(j), 0.0) * float(v) for j, v in zip(i, x, strict=True)) + b
            g = 1 / (1 + math.exp(-total)) - y
            for j, v in zip(map(int, i), x, strict=True):
                slope = g * float(v) + quality.DECAY * w.get(j, 0.0)
                seen[j] = seen.get(j, 1e-8) + slope * slope
                w[j] = w.get(j, 0.0) - quality.RATE * slope / math.sqrt(seen[j])
            seen_b += g * g
            b -= quality.RATE * g / math.sqrt(seen_b)
    got, got_b = quality.fit_scorer(rows)
    assert np.isclose(got_b, b, atol=1e-4) and all(np.isclose(got[j], v, atol=1e-4) for j, v in w.items())


def test_convolution_equals_nested_loops():
    rng = np.random.default_rng(8)
    filters = [rng.normal(size=(w, 256, language.FILTERS)).astype(np.float32) for w in language.WIDTHS]
    n = language.FILTERS * len(language.WIDTHS)
    net = language.Network(filters, rng.normal(size=n).astype(np.float32), rng.normal(size=(n, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32))
    x = rng.integers(0, 256, (4, language.WINDOW), dtype=np.uint8)
    got = language.Scorer(net).log_probabilities(x)
    for row, logs in zip(x, got, strict=True):
        pooled = []
        for width, table in zip(language.WIDTHS, filters, strict=True):
            for f in range(language.FILTERS):
                pooled.append(max(sum(float(table[t][row[at + t]][f]) for t in range(width)) for at in range(language.WINDOW - width + 1)))
        hidden = [max(0.0, p + float(o)) for p, o in zip(pooled, net.bias, strict=True)]
        logits = [sum(h * float(net.dense[k][c]) for k, h in enumerate(hidden)) + float(net.offset[c]) for c in range(3)]
        total = math.log(sum(math.exp(v - max(logits)) for v in logits)) + max(logits)
        assert np.allclose(logs, [v - total for v in logits], atol=1e-3)


def test_windows_that_are_drawn_are_bounded_and_the_whole_texts_otherwise(spark):
    rows = [(k / 10, lang, text) for k, (lang, text) in enumerate([("en", "a" * 1_000), ("de", "b" * 300), ("de", "c"), ("en", "")])]
    chosen = spark.createDataFrame(rows, "draw double, lang string, text string")
    every = language._drawn_windows(chosen, 1_000).collect()
    assert len(every) == 8 + 3 + 1 and {len(r.window) for r in every} == {language.WINDOW}
    few = language._drawn_windows(chosen, 5).collect()
    key = lambda r: (r.draw, r.lang, r.place)
    assert len(few) == 5 and {key(r) for r in few} <= {key(r) for r in every}
