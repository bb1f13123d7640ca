"""Linking of parts against all pairs, over shifting offsets and long endpoints."""

import numpy as np

from lacuna.llm import secrets

ROLE = [role for _, role, _ in secrets.KINDS]


def plain_linked(parts):
    out = [p for p in parts if p[1] < secrets.BASE]
    for row, kind, start, stop in parts:
        others = [p for p in parts if p[0] == row]
        covered = any(k < secrets.BASE and a < stop and start < b for _, k, a, b in others)
        paired = any(ROLE[k] != ROLE[kind] and 0 <= max(a - stop, start - b) <= secrets.SCOPE for _, k, a, b in others)
        if kind >= secrets.BASE and paired and not covered:
            out.append((row, kind, start, stop))
    return sorted(out)


def test_links_over_offsets(spark):
    rng = np.random.default_rng(8)
    parts = [(0, 3, 590, 630), (0, 4, 920, 950)]
    for shift in range(0, 300, 7):
        parts += [(1000 + shift, 3, shift, shift + 60), (1000 + shift, 4, shift + 355, shift + 380)]
        parts += [(2000 + shift, 5, shift, shift + 900), (2000 + shift, 2, shift + 850, shift + 880), (2000 + shift, 3, shift + 1000, shift + 1020)]
    for row in range(100):
        at = 0
        for _ in range(int(rng.integers(2, 6))):
            start = at + int(rng.integers(1, 400))
            at = start + int(rng.integers(8, 700))
            parts.append((row + 1, int(rng.integers(0, 6)), start, at))
    found = secrets.linked(spark.createDataFrame(parts, "row long, kind int, start long, stop long"))
    assert sorted(tuple(r) for r in found.collect()) == plain_linked(parts)
