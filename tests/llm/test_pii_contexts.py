"""Planted contexts: identifiers that no base pattern knows, beside known ones at several ratios, found and told from others."""

import random

import pytest

from lacuna.llm import pii


def planted(rng, seeds, unknown):
    """Texts with e-mails and member numbers in one context, and numbers in contexts of their own, between random words."""
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))
    texts, hidden, other = [], set(), set()
    for i in range(seeds + unknown):
        value = f"user{i}@mail{i % 7}.example.org" if i < seeds else f"MX-{rng.randrange(10**6, 10**7)}-{i}"
        start = words(9) + " please contact member "
        texts.append(f"{start}{value} without delay {words(9)}")
        if i >= seeds:
            hidden.add((i, len(start), len(start) + len(value)))
    for i in range(len(texts), len(texts) + 200):
        start, value = words(9) + rng.choice([" in total ", " item number ", " please see page "]), str(rng.randrange(10**5, 10**7))
        texts.append(f"{start}{value} of {words(9)}")
        other.add((i, len(start), len(start) + len(value)))
    # some of these places hold an e-mail, most hold words
    texts += [f"{words(5)} item number {rng.choice(['seven', 'nine', f'a{i}@b.example.org'])} of {words(5)}" for i in range(60)]
    return texts, hidden, other


@pytest.mark.parametrize(("seeds", "unknown"), [(80, 20), (60, 60), (30, 60), (20, 80)])
def test_recall_and_precision_by_ratio(spark, seeds, unknown):
    texts, hidden, other = planted(random.Random(seeds), seeds, unknown)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row long, text string")
    found = {(r.row, r.start, r.stop) for r in pii.discovered(docs).collect()}
    recall, wrong = len(found & hidden) / len(hidden), len(found & other)
    assert recall >= 0.9 and wrong <= 0.1 * len(found), (recall, wrong)


def plain(texts, rounds=pii.ROUNDS):
    """The graph of patterns and instances scored with dictionaries."""
    graph, others, seeds, spans = {}, {}, set(), []
    for row, text in enumerate(texts):
        base = pii.base_spans(text)
        for seed, a, b in [(True, a, b) for _, a, b in base] + [(False, a, b) for a, b in pii.candidates(text, base)]:
            said = text[a:b].lower()
            spans += [] if seed else [(row, a, b, said)]
            seeds |= {said} if seed else set()
            for p in pii.patterns(text, a, b):
                graph.setdefault(p, {}).setdefault(said, 0)
                graph[p][said] += 1
        for part in pii._contexts(text):
            for p in part.view("int64").tolist():
                others[p] = others.get(p, 0) + 1
    trust = dict.fromkeys(seeds, 1.0)
    for _ in range(rounds):
        good = {}
        for p, held in graph.items():
            times = sum(n * trust.get(i, 0) for i, n in held.items())
            score = times / (times + others.get(p, 0) + 1)
            if score >= pii.LEAST_PATTERN and sum(trust.get(i, 0) >= pii.LEAST_INSTANCE for i in held) >= pii.LEAST_SEEDS:
                good[p] = score
        doubt = {}
        for p, score in good.items():
            for i in graph[p]:
                doubt[i] = doubt.get(i, 1.0) * (1 - score)
        trust = {i: 1 - d for i, d in doubt.items()} | dict.fromkeys(seeds, 1.0)
    return {(row, a, b) for row, a, b, said in spans if trust.get(said, 0) >= pii.LEAST_INSTANCE}


def test_graph_scores_equal_a_plain_loop(spark):
    texts = planted(random.Random(1), 12, 30)[0] + ["", "1", "a@b.c d", "x" * 5000 + " 123456"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row long, text string")
    assert {(r.row, r.start, r.stop) for r in pii.discovered(docs).collect()} == plain(texts)
