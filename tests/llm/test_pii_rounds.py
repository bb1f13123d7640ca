"""Patterns that only found candidates lead to, and totals next to punctuation."""

import collections
import re

from lacuna.llm import pii


def spans_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [x[tuple(s)[1] : tuple(s)[2]] for s in r.spans if s[0] == 4] for r in pii.find(rows).collect() for x in [texts[r.doc_id]]}


def test_found_candidates_lead_to_new_patterns(spark):
    texts = [f"please write to contact us person{i}@mail.org at any time" for i in range(30)]
    texts += [f"please write to contact us agent#7788{i} at any time" for i in range(8)]
    texts += [f"the old desk code agent#7788{i} opens every door" for i in range(8)]
    texts += ["the old desk code agent#99110 opens every door", "in all 99112 were counted"]
    found = spans_of(spark, texts)
    assert found[46] == ["agent#99110"] and found[47] == []


def test_totals_next_to_punctuation(spark):
    texts = [f"reach the host (10.0.0.{i}), which answers" for i in range(30)]
    texts += ["reach the host (node#7788), which answers"]
    assert spans_of(spark, texts)[30] == ["node#7788"]
    texts += [f"reach the host (word{'abcdefghij'[i % 10]}), which answers" for i in range(300)]
    assert spans_of(spark, texts)[30] == []


def test_contexts_are_those_of_each_token():
    text = 'Caf\u00e9 "one" (two), ### three; at a@b.cd, or (+1 555 123-4567). Then 10.0.0.1 x' + "y" * 500 + " end."
    base = pii.base_spans(text)
    taken = [(a, b) for _, a, b in base] + list(pii.candidates(text, base))
    want = collections.Counter()
    for m in re.finditer(r"[^ \t\n\r\x0b\f]+", text):
        if any(a < m.end() and m.start() < b for a, b in taken):
            continue
        front = m[0].rstrip(".,;:!?)]}>\"'")
        core = front.lstrip("([{<\"'")
        start = m.start() + len(front) - len(core)
        want.update(pii.patterns(text, start, start + len(core)) if core else pii.patterns(text, *m.span()))
    found = collections.Counter(int(p) for shape in pii._contexts(text) for p in shape.view("int64"))
    assert found == want and len(want) > 15
