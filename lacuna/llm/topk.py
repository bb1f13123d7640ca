"""Exact top-k search by inner product: a ball tree with branch and bound for each shard, in rounds that share k-th scores.

Vectors are dealt to regions, whose centres are fitted on a bounded sample (``SAMPLE_VALUES``), and a large region to shards
of about ``SHARD`` rows. A region is a ball: its centre and the largest distance of a member. Each query orders the regions by
the largest product that their balls allow. A first round takes the best region of each query, the next ones 4, 16, ... more,
and before each round the k-th score found so far goes to all shards: regions whose bound is below it are left out for the
query. A task has one shard and one block of queries; it builds a ball tree of the shard and takes the block down the tree,
nodes with larger bounds first, with the current k-th scores as floors.

Products are exact: floating point only where every product is under 2^53, 64-bit integers beyond (scores must fit a long).
Of equal vectors, only the k + 1 with the smallest vec_ids can be results and become candidates.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do rows without vec_id;
vectors compete only with vectors of their length; every row is a candidate of its own, also where vec_id repeats, and each
query row (``every`` divides its vec_id) leaves out only itself; ties go to the smaller vec_id; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.lineage import written

TOP, SCALE, EVERY = 20, 64, 20
LEAF = 128
#: Regions at most and rows that a region has at least on average; components in the sample that their centres are fitted on.
REGIONS, REGION_LEAST, SAMPLE_VALUES, SEED = 64, 2_048, 1 << 20, 5
#: Rows of a shard and queries of a block, on average at most.
SHARD, BLOCK = 32_768, 2_048
NONE = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact as far as they fit 64 bits."""
    most = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if queries.shape[1] * most(queries) * most(vectors) < 1 << 53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return queries @ vectors.T


class BallTree:
    """Nodes over rows that are kept in tree order; rows of a leaf are ordered by id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        order, self.nodes, fine = np.arange(len(ids)), [], vectors.astype(np.float64)
        stack = [(0, len(ids), None)]
        while stack:
            lo, hi, parent = stack.pop()
            part = fine[order[lo:hi]]
            centre, spread = part.mean(0), part.max(0) - part.min(0)
            me, same = len(self.nodes), not spread.any()
            radius = float(np.sqrt(((part - centre) ** 2).sum(1).max()))
            self.nodes.append({"lo": lo, "hi": hi, "centre": centre, "radius": radius, "size": float(np.sqrt(centre @ centre)) + radius, "first": int(ids[order[lo:hi]].min()), "kids": [], "same": same})
            if parent is not None:
                self.nodes[parent]["kids"].append(me)
            if hi - lo > LEAF and not same:
                mid = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(part[:, spread.argmax()], mid)]
                stack += [(lo, lo + mid, me), (lo + mid, hi, me)]
            else:
                order[lo:hi] = order[lo:hi][np.argsort(ids[order[lo:hi]])]
        self.ids, self.rows, self.vectors = ids[order], rows[order], vectors[order]

    def search(self, own: np.ndarray, queries: np.ndarray, floor: np.ndarray, floor_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the best k for each query that beat its floor (a score, and the id that ties must be under)."""
        m, fine = len(queries), queries.astype(np.float64)
        score, found = np.full((m, k), NONE), np.full((m, k), LAST)
        length = np.sqrt((fine**2).sum(1))
        stack = [(0, np.arange(m))]
        while stack:
            at, q = stack.pop()
            node = self.nodes[at]
            bound = fine[q] @ node["centre"] + length[q] * node["radius"] + 1e-6 + 1e-9 * length[q] * node["size"]
            better = (score[q, -1] > floor[q]) | ((score[q, -1] == floor[q]) & (found[q, -1] < floor_id[q]))
            limit, limit_id = np.where(better, score[q, -1], floor[q]), np.where(better, found[q, -1], floor_id[q])
            limit = limit.astype(np.float64)
            q = q[(bound >= limit) & ((bound >= limit + 1) | (node["first"] < limit_id))]
            if not len(q):
                continue
            if node["kids"]:
                reach = lambda kid: float((fine[q] @ self.nodes[kid]["centre"] + length[q] * self.nodes[kid]["radius"]).sum())  # noqa: B023, E731
                stack += [(kid, q) for kid in sorted(node["kids"], key=reach)]
                continue
            hi = min(node["hi"], node["lo"] + k + 1) if node["same"] else node["hi"]
            ids = self.ids[node["lo"] : hi]
            s = products(queries[q], self.vectors[node["lo"] : hi])
            out = (self.rows[node["lo"] : hi][None, :] == own[q][:, None]) | (s < floor[q][:, None]) | ((s == floor[q][:, None]) & (ids[None, :] >= floor_id[q][:, None]))
            touched = (~out & (s >= score[q, -1][:, None])).any(1)
            q, s, out = q[touched], s[touched], out[touched]
            if len(q):
                both = np.concatenate([score[q], np.where(out, NONE, s)], 1)
                names = np.concatenate([found[q], np.where(out, LAST, ids[None, :])], 1)
                best = np.lexsort((names, ~both), axis=-1)[:, :k]
                score[q], found[q] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
        return score, found


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_list()).astype(np.int64) if len(rows) else np.zeros((0, 0), np.int64)


def _tile(k: int):
    def run(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(block):
            return pd.DataFrame({n: np.array([], np.int64) for n in ("query_row", "query_id", "vec_id", "score")})
        tree = BallTree(shard["vec_id"].to_numpy(np.int64), shard["row"].to_numpy(np.int64), _matrix(shard["v"]))
        own = block["query_row"].to_numpy(np.int64)
        score, found = tree.search(own, _matrix(block["q"]), block["floor"].to_numpy(np.int64), block["floor_id"].to_numpy(np.int64), k)
        hit = found != LAST
        times = hit.sum(1)
        return pd.DataFrame({"query_row": np.repeat(own, times), "query_id": np.repeat(block["query_id"].to_numpy(np.int64), times), "vec_id": found[hit], "score": score[hit]})

    return run


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the floor of ``scale`` times each component, of vectors whose components are all finite."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return vectors.filter("vec_id is not null and embedding is not null").filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _centres(points: DataFrame, n: int, regions: int) -> dict[int, np.ndarray]:
    """Centres by length of vector, from a sample of bounded size; a length that the sample lacks has one region, at 0."""
    widest = points.agg(F.max("dim")).first()[0] or 1
    wanted = max(regions, SAMPLE_VALUES // max(1, widest))
    draw = F.pmod(F.xxhash64("row"), F.lit(1 << 30))
    sample = points.filter(draw < F.lit(int(min(1.0, wanted / n) * (1 << 30)))).orderBy(draw, "row").limit(wanted).select("dim", "v").toArrow()
    dims, values, found = sample.column("dim").to_numpy(), sample.column("v"), {}
    rng = np.random.default_rng(SEED)
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim).tolist()
        x = np.array([values[i].as_py() for i in at], np.float64).reshape(len(at), dim)
        centres = np.unique(x[rng.permutation(len(x))[: max(1, regions * len(x) // len(dims))]], axis=0)
        for _ in range(3):
            near = _nearest(x, centres)[0]
            centres = np.stack([x[near == j].mean(0) if (near == j).any() else c for j, c in enumerate(centres)])
        found[dim] = centres
    return found


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and its distance."""
    near = ((centres**2).sum(1) - 2 * (x @ centres.T)).argmin(1)
    return near, np.sqrt(((x - centres[near]) ** 2).sum(1))


def _by_length(batch: pa.RecordBatch, column: str):
    """For each length of vector in the batch: the places of its rows, and the rows as a matrix."""
    lists = batch.column(column)
    sizes, starts = np.diff(lists.offsets.to_numpy()), lists.offsets.to_numpy()
    values = lists.values.to_numpy()
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, at, values[starts[at][:, None] + np.arange(dim)[None, :]].reshape(len(at), dim).astype(np.float64)


def _dealt(points: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """The points with their region and their distance from its centre."""
    shared = points.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            region, away = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for dim, at, x in _by_length(batch, "v"):
                region[at], away[at] = _nearest(x, shared.value.get(dim, np.zeros((1, dim))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region), pa.array(away)], [*batch.schema.names, "region", "away"])

    return points.mapInArrow(run, "row long, vec_id long, v array<long>, dim int, region long, away double")


def _routed(asked: DataFrame, centres: dict[int, np.ndarray], radius: dict[tuple[int, int], float]) -> DataFrame:
    """The queries with the regions of their length, by falling bound, and these bounds."""
    shared = asked.sparkSession.sparkContext.broadcast((centres, radius))

    def run(batches):
        centres, radius = shared.value
        for batch in batches:
            regions, bounds = [None] * batch.num_rows, [None] * batch.num_rows
            for dim, at, q in _by_length(batch, "q"):
                c = centres.get(dim, np.zeros((1, dim)))
                there = np.array([j for j in range(len(c)) if (dim, j) in radius])
                r = np.array([radius[dim, j] for j in there.tolist()])
                length, size = np.sqrt((q**2).sum(1))[:, None], np.sqrt((c[there] ** 2).sum(1)) + r
                bound = q @ c[there].T + length * r + 1e-6 + 1e-9 * length * size
                order = np.argsort(-bound, axis=1, kind="stable")
                for i, o, b in zip(at.tolist(), order, bound, strict=True):
                    regions[i], bounds[i] = there[o], b[o]
            columns = [pa.array(regions, pa.list_(pa.int64())), pa.array(bounds, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "regions", "bounds"])

    return asked.mapInArrow(run, "query_row long, query_id long, q array<long>, dim int, regions array<long>, bounds array<double>")


def search(vectors: DataFrame, k: int = TOP, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the best k candidates of each query (rows whose vec_id is divisible by ``every``)."""
    points = written(quantised(vectors, scale).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.size("v").alias("dim")))
    n = points.count()
    equal = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id", "row")
    able = points.withColumn("nth", F.row_number().over(equal)).filter(F.col("nth") <= k + 1).drop("nth")
    centres = _centres(points, n, min(REGIONS, max(1, n // REGION_LEAST))) if n else {}
    dealt = written(_dealt(able, centres))
    balls = dealt.groupBy("dim", "region").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
    radius = {(b["dim"], b["region"]): b["radius"] for b in balls.collect()}
    shards = F.broadcast(balls.select("dim", "region", F.ceil(F.col("n") / SHARD).alias("shards")))
    asked = points.filter(F.col("vec_id") % every == 0).select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "dim")
    queries = written(_routed(asked, centres, radius))

    key, at, step, best = ["dim", "region", "shard", "block"], 0, 1, None
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    while best is None or at < max((len(c) for c in centres.values()), default=1):
        todo = queries.withColumn("x", F.explode(F.slice(F.arrays_zip("regions", "bounds"), at + 1, step)))
        todo = todo.select("query_row", "query_id", "q", "dim", F.col("x.regions").alias("region"), F.col("x.bounds").alias("bound"))
        floor, floor_id = F.lit(int(NONE)), F.lit(int(LAST))
        if best is not None:
            kth = best.filter(F.col("rank") == k).select("query_row", F.col("score").alias("s"), F.col("vec_id").alias("i"))
            todo = todo.join(kth, "query_row", "left")
            floor, floor_id = F.coalesce("s", floor), F.coalesce("i", floor_id)
        todo = todo.withColumn("floor", floor.cast("long")).withColumn("floor_id", floor_id.cast("long")).filter(F.col("bound") >= F.col("floor"))
        todo = written(todo.select("query_row", "query_id", "q", "dim", "region", "floor", "floor_id"))
        blocks = todo.groupBy("dim", "region").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        plan = F.broadcast(shards.join(F.broadcast(blocks), ["dim", "region"]))
        ours = dealt.join(plan, ["dim", "region"]).withColumn("shard", F.pmod(F.xxhash64("row"), "shards")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        theirs = todo.join(plan, ["dim", "region"]).withColumn("block", F.pmod(F.xxhash64("query_row"), "blocks")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        ours = ours.select("row", "vec_id", "v", "dim", "region", F.col("shard").cast("long").alias("shard"), F.col("block").cast("long").alias("block"))
        theirs = theirs.select("query_row", "query_id", "q", "floor", "floor_id", "dim", "region", F.col("shard").cast("long").alias("shard"), F.col("block").cast("long").alias("block"))
        found = ours.groupBy(*key).cogroup(theirs.groupBy(*key)).applyInPandas(_tile(k), "query_row long, query_id long, vec_id long, score long")
        found = found if best is None else found.union(best.drop("rank"))
        best = written(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
        at, step = at + step, 4 * step
    return best.select("query_id", "rank", "vec_id", "score")
