"""op12 against a plain loop over all documents and orders."""

import random
import re
from itertools import permutations

from lacuna.llm import filter_audit

DOCS, LABELS = "doc_id long, text string, source string, A int, part string", "doc_id long, quality int, toxic int"


def plain(docs, labels):
    docs = [(d, t or "", s or "") for d, t, s in docs]
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t] = min(d, first.get(t, d))

    def fails(d, t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        found = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t))
        return found + "D" * bool(set("#$%&*|") & set(t)) + "E" * (d is not None and d > first[t])

    good, toxic = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))
    out = {}
    for part in {s for _, _, s in docs}:
        mine = [(d, fails(d, t)) for d, t, s in docs if s == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                every = sum(f in x[1] for x in mine)
                shapley[f] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), every - len(gone), sum(x[1] == f for x in mine), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone),
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def rows_of(spark, docs, labels):
    frame = spark.createDataFrame([(*d, 7, "clash") for d in docs], DOCS)
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in filter_audit.audit(frame, spark.createDataFrame(labels, LABELS)).collect()}


def test_equals_a_plain_loop(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["word", "Bad", "x#", "tab\tsep", *map(str, range(300))]) for _ in range(rng.choice([3, 150, 199, 200, 260, 900]))) for _ in range(25)]
    texts += ["", None, "A" * 5 + " b" * 200, "é " * 200, "w x " * 250]
    docs = [(rng.choice([None, *range(120)]), rng.choice(texts), rng.choice(["s1", "s1", "s2", "", None])) for _ in range(200)]
    docs += [(500 + i, "copied text", "s1") for i in range(60)] + [(499, "copied text", "s2"), (499, "copied text", "s2")]
    docs += [(900, "same " * 250, "only copies"), (901, "same " * 250, "only copies")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 600, 2)] + [(4, 1, 1), (None, 1, 1)]
    got = rows_of(spark, docs, labels)
    assert len(got) == 120 * 5 * 4 and got == plain(docs, labels)


def test_empty_tables(spark):
    assert rows_of(spark, [], []) == {}
    assert rows_of(spark, [(1, "x", "s")], [])["s", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)
