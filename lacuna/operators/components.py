"""Connected components of a graph that is given as a table of links, or of items that share groups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lacuna.operators.lineage import checkpointed, written
from lacuna.operators.skew import join_per_key

#: So many links between long nodes are settled by one task, which takes a few MB; more in rounds.
SMALL = 100_000
#: Rows of items and groups that a task contracts at once, some 100 bytes each. Bounds memory, not results.
CHUNK = 1_000_000


def _settled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and component of all links that come, by the smaller root of both ends."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root[x]) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            root.setdefault(u, u)
            root.setdefault(v, v)
            x, y = top(u), top(v)
            root[max(x, y)] = min(x, y)
    nodes = np.fromiter(root, np.int64, len(root))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([top(int(x)) for x in nodes], pa.int64())], ["node", "component"])


def connected_components(links: DataFrame, a: str = "a", b: str = "b", small: int = SMALL) -> DataFrame:
    """node, component (its smallest node) for every node of a link. Links to null are left out; loops and repeats do no harm.

    Star contraction: in turn, the larger neighbours of each node are tied to the smallest one, then the smaller ones are.
    Links are never more than at first, hubs are joined as hot keys and not gathered, and each round is checkpointed. Each
    round that changes anything brings some node nearer to its smallest one, so the rounds end. Up to ``small`` links between
    long nodes are settled in one task, with the same result.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    edges = checkpointed(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if edges.schema["u"].dataType == LongType() and edges.schema["v"].dataType == LongType() and edges.count() <= small:
        return edges.repartition(1).mapInArrow(_settled, "node long, component long")
    nodes = edges.select("u").union(edges.select("v")).distinct()
    edges, before = edges.filter("u <> v"), None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now["n"]:
            break
        before = now
        around = edges.union(edges.select("v", "u"))
        low = around.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
        edges = join_per_key(around, low, "u", 2 * now["n"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = checkpointed(edges.distinct())
        low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        tied = join_per_key(edges, low, "u", 2 * now["n"]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(tied.union(low.select("u", F.col("m").alias("v"))).distinct())
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.select(F.col("u").alias("node")).join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _tied(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that each of n numbers reaches by links between x and y.

    Each turn ties every root that meets a smaller one to the smallest that it meets, so open roots halve at least."""
    root = np.arange(n)
    while True:
        x, y = root[x], root[y]
        open_ = x != y
        if not open_.any():
            return root
        x, y = x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def _contracted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """is_item, node and root (an item) for each item and group of these rows."""
    ends = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("item", "grp"))
    (items, x), (groups, y) = (np.unique(k, return_inverse=True) for k in ends)
    # items come first, so the smallest number that is reached is an item
    root = items[_tied(x, y + len(items), len(items) + len(groups))]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(root)) < len(items)), pa.array(np.concatenate([items, groups])), pa.array(root)], ["is_item", "node", "root"])


def shared_components(rows: DataFrame, item: str, group: str, chunk: int = CHUNK, small: int = SMALL) -> DataFrame:
    """node, component (its smallest item) for every item; items are tied that share a group. All are longs; rows with nulls
    are left out.

    Tasks contract the rows as they are read, chunk by chunk, so each item and group goes once a chunk to the only shuffle.
    Roots that meet at an item or a group share it and are contracted in the same way, as long as that halves the rows; what is
    then left goes in rounds. In any order there are never more of these rows than both ends of the rows at first.
    """
    asked = rows.select(F.col(item).cast("long").alias("item"), F.col(group).cast("long").alias("grp")).filter("item is not null and grp is not null")
    levels, before = [], None
    while True:

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for batch in batches:
                held.append(batch)
                n += batch.num_rows
                if n >= chunk:
                    yield _contracted(held)
                    held, n = [], 0
            if n:
                yield _contracted(held)

        ends = asked.mapInArrow(run, "is_item boolean, node long, root long").groupBy("is_item", "node")
        met = written(ends.agg(F.min("root").alias("first"), F.collect_set("root").alias("roots")))
        levels.append(met.filter("is_item").select(F.col("node").alias("item"), "first"))
        asked = met.filter(F.size("roots") > 1).select(F.explode("roots").alias("item"), F.col("first").alias("grp"))
        n = asked.count()
        if n <= small or (before is not None and 2 * n > before):
            break
        before = n
    parts = connected_components(asked, "item", "grp", small)
    for found in reversed(levels):
        joined = found.join(parts, found["first"] == parts["node"], "left")
        parts = joined.select(F.col("item").alias("node"), F.coalesce("component", "first").alias("component"))
    return parts
