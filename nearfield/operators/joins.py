"""Distance joins: closest pairs, metric join, half-space proximal selection, point-cloud distances."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluate import quantiles
from .search import _blocks, knn, least_distances, pairs, slots_of
from .select import cut, random_sample


def closest_pairs(left: DataFrame, right: DataFrame, dist, k: int = 1, same: bool = False, min_k: int = 8) -> DataFrame:
    """(a, b, dist): the k smallest pairs of objects of left and right, ascending; with same, an object isn't its own pair.

    Each b first takes its nearest a's, so only those meet in the final sort. Pairs are ordered: (a, b) and (b, a) count.
    """
    near = knn(right.withColumnRenamed("id", "qid"), left, dist, max(k, min_k) + same)
    found = near.where(F.col("qid") != F.col("id")) if same else near
    return found.select(F.col("id").alias("a"), F.col("qid").alias("b"), "dist").orderBy("dist", "a", "b").limit(k)


#: Pairs of random objects whose distances stand in where no object has votes enough.
CROSS_SAMPLE = 64


def metric_join(left: DataFrame, right: DataFrame, dist, k: int, rank: int = 1, q: float = 0.9, min_group: int = 8, same: bool = False, seed: int = 0) -> DataFrame:
    """(a, b, rank, dist): for each b its k nearest a's within a's threshold; with same, an object isn't its own pair.

    A b's hits up to `rank` vote their distance to their a; an a's threshold is the q-quantile of its votes if it has
    min_group, else that of the pooled votes of those that have. With no such group it is that of a sample of
    CROSS_SAMPLE random pairs, of different objects with same. In a self join a b's first hit is itself, which has no
    vote: rank counts it.
    """
    hits = knn(right.withColumnRenamed("id", "qid"), left, dist, k).select(F.col("id").alias("a"), F.col("qid").alias("b"), "rank", "dist")
    hits = cut(hits.where("a <> b") if same else hits)
    votes = hits.where(F.col("rank") <= rank).select("a", "dist")
    own = quantiles(votes, "dist", q, "a").where(F.col("n") >= max(min_group, 1)).select("a", F.col("quantile").alias("own"))
    pooled = quantiles(votes.join(own.select("a"), "a", "left_semi"), "dist", q).first()
    if pooled is None:
        pooled = quantiles(cross_sample(left, right, dist, CROSS_SAMPLE, same, seed), "dist", q).first()
    fallback = F.lit(None if pooled is None else float(pooled["quantile"])).cast("double")
    return hits.join(own, "a", "left").where(F.col("dist") <= F.coalesce("own", fallback)).select("a", "b", "rank", "dist")


def cross_sample(left: DataFrame, right: DataFrame, dist, n: int, same: bool = False, seed: int = 0) -> DataFrame:
    """(draw, a, b, dist) of n random pairs, of different objects with same (if there are two)."""
    draws = 2 * n if same else n
    a = random_sample(left, draws, seed).select("draw", F.col("id").alias("a"))
    b = random_sample(right, draws, seed + 1).select("draw", F.col("id").alias("b"))
    chosen = a.join(b, "draw")
    if same:
        chosen = chosen.where("a <> b").orderBy("draw").limit(n)
    both = chosen.join(left.select(F.col("id").alias("a"), F.col("v").alias("v_a")), "a").join(right.select(F.col("id").alias("b"), F.col("v").alias("v_b")), "b")
    return both.select("draw", "a", "b", dist(F.col("v_a"), F.col("v_b")).alias("dist"))


#: Up to so many candidates have all their distances computed at once.
AMONG = 512


def hsp_fold(v: np.ndarray, dist: np.ndarray, order: list[int], block, near: float | None = None, rng: np.random.Generator | None = None) -> list[int]:
    """Positions kept, in the given order: one goes if a kept one is nearer to it than the query is. Those within
    `near` of the query, but the first, stay with a probability that halves with each."""
    kept: list[int] = []
    chance = 1.0
    among = block(v, v) if len(v) <= AMONG else None
    for i in order:
        if kept and near is not None and dist[i] <= near:
            if rng.random() < chance:
                kept.append(i)
                chance /= 2
        elif not kept or ((among[i, kept] if among is not None else block(v[i : i + 1], v[kept])[0]) >= dist[i]).all():
            kept.append(i)
    return kept


def hsp(hits: DataFrame, objects: DataFrame, dist, order: str = "ascending", near: float | None = None, seed: int = 0) -> DataFrame:
    """(qid, id, rank, dist) of the half-space proximal neighbours among each query's candidates (k rows a query).

    order descending gives the distal choice, from the farthest; `near` spares some near duplicates of the query.
    """
    return folded(hits, objects, lambda qid, v, d: hsp_fold(v, d, list(range(len(d))) if order == "ascending" else list(range(len(d)))[::-1], dist.block, near, np.random.default_rng([seed, abs(qid)]) if near is not None else None))


def folded(hits: DataFrame, objects: DataFrame, choose) -> DataFrame:
    """(qid, id, rank, dist) of the candidates that choose(qid, vectors, distances), which has them by distance and id,
    keeps by place. A query's candidates are one row; many queries go to a worker at once."""
    row = F.struct("dist", "id", "rank", F.col("v").cast("array<double>").alias("v"))
    groups = hits.select("qid", "id", "rank", "dist").join(objects.select("id", "v"), "id").groupBy(F.col("qid").cast("long").alias("qid")).agg(F.array_sort(F.collect_list(row)).alias("c"))
    flat = groups.select("qid", F.col("c.id").alias("id"), F.col("c.rank").alias("rank"), F.col("c.dist").alias("dist"), F.flatten("c.v").alias("v"))

    def run(batches):
        for batch in batches:
            columns = [batch.column(i) for i in range(1, 5)]
            ids, ranks, dists, values = (c.flatten().to_numpy(zero_copy_only=False) for c in columns)
            starts, v_starts = (np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))]) for c in (columns[0], columns[3]))
            kept, owner = [], []
            for i, qid in enumerate(batch.column(0).to_pylist()):
                v = values[v_starts[i] : v_starts[i + 1]].reshape(starts[i + 1] - starts[i], -1)
                own = choose(qid, v, dists[starts[i] : starts[i + 1]])
                kept.append(np.asarray(own, np.int64) + starts[i])
                owner.append(np.full(len(own), qid, np.int64))
            if kept:
                at = np.concatenate(kept)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(owner)), pa.array(ids[at].astype(np.int64)), pa.array(ranks[at].astype(np.int32)), pa.array(dists[at].astype(np.float64))], names=["qid", "id", "rank", "dist"])

    return flat.mapInArrow(run, "qid long, id long, rank int, dist double")


def cloud_distances(points: DataFrame, dist) -> DataFrame:
    """(cloud_a, cloud_b, directed, hausdorff, chamfer) of every ordered pair of clouds; points are (cloud, id, v).

    directed is the greatest distance from a point of a to its nearest point of b; chamfer is the mean of nearest
    distances, both ways. One pass takes the least distance of each point to each cloud: of dense vectors by blocks of
    points of one cloud, of other objects by an expression.
    """
    if getattr(dist, "block", None):
        near = _nearest_by_cloud(points, dist)
    else:
        both = pairs(points.select(F.struct("cloud", "id").alias("qid"), "v"), points.select(F.struct("cloud", "id").alias("id"), "v"))
        near = both.select(F.col("qid.cloud").alias("cloud_a"), F.col("qid.id").alias("a"), F.col("id.cloud").alias("cloud_b"), dist(F.col("q"), F.col("v")).alias("dist"))
    near = near.groupBy("cloud_a", "a", "cloud_b").agg(F.min("dist").alias("dist"))
    way = near.groupBy("cloud_a", "cloud_b").agg(F.max("dist").alias("directed"), F.avg("dist").alias("mean"))
    back = way.select(F.col("cloud_a").alias("cloud_b"), F.col("cloud_b").alias("cloud_a"), F.col("directed").alias("directed_back"), F.col("mean").alias("mean_back"))
    return way.join(back, ["cloud_a", "cloud_b"]).select("cloud_a", "cloud_b", "directed", F.greatest("directed", "directed_back").alias("hausdorff"), (F.col("mean") + F.col("mean_back")).alias("chamfer"))


def _nearest_by_cloud(points: DataFrame, dist) -> DataFrame:
    """(cloud_a, a, cloud_b, dist): each point's least distance to each block of a cloud's points."""
    slots = slots_of(points)
    # clouds may have names of any type: they are numbered
    clouds = cut(points.select("cloud").distinct().select("cloud", F.monotonically_increasing_id().alias("number")))
    own = _blocks(points.join(clouds, points["cloud"].eqNullSafe(clouds["cloud"])).select("id", "v", "number"), "id", "number")
    q = own.select(F.col("by").alias("one"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    o = own.select(F.col("by").alias("two"), "data", F.pmod(F.xxhash64("by", "ids"), F.lit(slots)).cast("int").alias("slot"))

    def run(batches):
        for batch in batches:
            for one, q_ids, q_data, two, data in zip(*(c.to_pylist() for c in batch.columns)):
                q_ids = np.frombuffer(q_ids, np.int64)
                q = np.frombuffer(q_data).reshape(len(q_ids), -1)
                x = np.frombuffer(data).reshape(-1, q.shape[1])
                least = least_distances(dist, q, x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), one)), pa.array(q_ids), pa.array(np.full(len(q), two)), pa.array(least)], names=["one", "a", "two", "dist"])

    near = q.join(o, "slot").select("one", "q_ids", "q_data", "two", "data").mapInArrow(run, "one long, a long, two long, dist double")
    near = near.groupBy("one", "a", "two").agg(F.min("dist").alias("dist"))
    a, b = clouds.select(F.col("number").alias("one"), F.col("cloud").alias("cloud_a")), clouds.select(F.col("number").alias("two"), F.col("cloud").alias("cloud_b"))
    return near.join(a, "one").join(b, "two").select("cloud_a", "a", "cloud_b", "dist")


def transport(cost: np.ndarray) -> float:
    """The least mean cost of moving an even mass over the rows to an even mass over the columns.

    Successive shortest paths with potentials: row i gives n units, column j takes m, and each path moves as much as it can.
    """
    m, n = cost.shape
    supply, demand = np.full(m, n, np.int64), np.full(n, m, np.int64)
    flow = np.zeros((m, n), np.int64)
    u, v = np.zeros(m), cost.min(0)
    while supply.any():
        # distances from all rows with supply, over reduced costs; a column leads back to the rows that serve it
        row_d, row_from = np.where(supply > 0, 0.0, np.inf), np.full(m, -1)
        col_d, col_from = np.full(n, np.inf), np.full(n, -1)
        row_open, col_open = np.ones(m, bool), np.ones(n, bool)
        while True:
            i = int(np.where(row_open, row_d, np.inf).argmin())
            j = int(np.where(col_open, col_d, np.inf).argmin())
            if row_open[i] and row_d[i] <= (col_d[j] if col_open[j] else np.inf):
                row_open[i] = False
                d = row_d[i] + np.maximum(cost[i] - u[i] - v, 0.0)
                better = col_open & (d < col_d)
                col_d[better], col_from[better] = d[better], i
            else:
                col_open[j] = False
                if demand[j]:
                    break
                d = np.where(flow[:, j] > 0, col_d[j], np.inf)
                better = row_open & (d < row_d)
                row_d[better], row_from[better] = d[better], j
        end = col_d[j]
        u += np.minimum(row_d, end) * -1 + end
        v += np.minimum(col_d, end) - end
        path, at = [], j
        while True:
            i = int(col_from[at])
            path.append((i, at, 1))
            if row_from[i] < 0:
                break
            at = int(row_from[i])
            path.append((i, at, -1))
        start = path[-1][0]
        amount = min([supply[start], demand[j], *(flow[a, b] for a, b, way in path if way < 0)])
        for a, b, way in path:
            flow[a, b] += way * amount
        supply[start] -= amount
        demand[j] -= amount
    return float((flow * cost).sum() / (m * n))


def cloud_emd(points: DataFrame, dist) -> DataFrame:
    """(cloud_a, cloud_b, emd) of every pair of clouds of dense vectors, cloud_a < cloud_b: the earth mover's distance
    between even masses over their points. A pair of clouds is solved in one task; clouds must fit one."""
    clouds = points.groupBy("cloud").agg(F.array_sort(F.collect_list(F.struct("id", "v")))["v"].alias("v"))
    slots = slots_of(points)
    a = clouds.select(F.col("cloud").alias("cloud_a"), F.col("v").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    b = clouds.select(F.col("cloud").alias("cloud_b"), F.col("v").alias("y"), F.pmod(F.xxhash64("cloud"), F.lit(slots)).cast("int").alias("slot"))

    @F.pandas_udf("double")
    def solve(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([transport(dist.block(np.stack(p).astype(np.float64), np.stack(q).astype(np.float64))) for p, q in zip(x, y)], dtype="float64")

    return a.join(b, "slot").where("cloud_a < cloud_b").select("cloud_a", "cloud_b", solve("x", "y").alias("emd"))
