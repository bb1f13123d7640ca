"""The components query against a union-find, with a part that many orders hold."""

import random

import pytest

from lacuna.operators import components as parts
from lacuna.operators.components import connected_components
from lacuna.plans import catalogue


def test_components_query(spark, tmp_path):
    lines = [(k, 1) for k in range(1, 41)] + [(50, 2), (51, 2), (51, 3), (52, 3), (60, 4), (60, 4)] + [(k, 5) for k in (40, 70)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    root = {k: k for k, _ in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, p in lines:
        for k2, p2 in lines:
            if p == p2:
                a, b = find(k), find(k2)
                root[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in catalogue.QUERIES["components"](spark, str(tmp_path)).collect()}
    assert found == {k: find(k) for k in root}


@pytest.mark.parametrize("small", [0, 100_000])
def test_random_graphs(spark, small):
    rng = random.Random(small)
    links = [(rng.randrange(-40, 400), rng.randrange(-40, 400)) for _ in range(220)] + [(k, k + 1) for k in range(1_000, 1_060)] + [(None, 3), (5, None), (7, 7)]
    root = {x: x for link in links if None not in link for x in link}
    changed = True
    while changed:
        changed = False
        for u, v in (link for link in links if None not in link):
            low = min(root[u], root[v])
            changed |= (root[u], root[v]) != (low, low)
            root[u] = root[v] = low
    frame = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.component for r in connected_components(frame, small=small).collect()} == root
    assert connected_components(frame.limit(0), small=small).count() == 0


@pytest.mark.parametrize(("chunk", "small"), [(1, 0), (50, 0), (50, 100_000), (100_000, 0)])
def test_items_that_share_groups(spark, chunk, small):
    """Equal to union-find however rows fall into chunks; groups may have the items' numbers."""
    rng = random.Random(chunk)
    rows = [(rng.randrange(-60, 300), rng.randrange(-20, 400)) for _ in range(260)] + [(k + d, k) for k in range(1_000, 1_060) for d in (0, 1)] + [(None, 3), (5_000, None), (7, 7), (7, 7)]
    root = {x: x for x, g in rows if None not in (x, g)}
    of = {}
    for x, g in rows:
        if None not in (x, g):
            of.setdefault(g, []).append(x)
    changed = True
    while changed:
        changed = False
        for members in of.values():
            low = min(root[x] for x in members)
            changed |= any(root[x] != low for x in members)
            root.update((x, low) for x in members)
    frame = spark.createDataFrame(rows, "item long, grp long").repartition(3)
    with_chunk = parts.shared_components(frame, "item", "grp", chunk, small).collect()
    assert sorted(tuple(r) for r in with_chunk) == sorted(root.items())
    assert parts.shared_components(frame.limit(0), "item", "grp", chunk, small).count() == 0


def test_only_roots_go_in_rounds(spark, monkeypatch):
    """Rows that stand together are contracted as they are read: 4,000 rows of 40 groups leave a link a task at most."""
    counts, rounds = [], parts.connected_components
    monkeypatch.setattr(parts, "connected_components", lambda links, *a: counts.append(links.count()) or rounds(links, *a))
    found = parts.shared_components(spark.range(4_000).selectExpr("id item", "id % 40 grp").unionAll(spark.range(39).selectExpr("id item", "id + 1 grp")), "item", "grp")
    assert {r.component for r in found.collect()} == {0} and found.count() == 4_000
    assert counts[0] <= 400
