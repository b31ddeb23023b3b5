"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are range-partitioned by length into blocks (the buckets). A seed block, the longest vectors, gives every
query a lower bound of its k-th score. Against each further block a query has a local cosine threshold,
bound / (|query| * longest of the block): above 1 the block is skipped; where it is high, candidates are cut by the
interval their value at the query's largest coordinate must lie in; otherwise by length, a prefix of the block sorted by
length. What is left is verified with exact products.

Queries are a stated subset; they meet all rows block by block. A block is a row with up to BLOCK vectors as bytes, so
the join of blocks has (query blocks x candidate blocks) rows, and a task holds one pair at a time. A block whose longest
vector reaches no query's bound of a query block isn't paired with it, and a query block goes only to the slots that have
blocks which do: bounds are looked at before any vector is shipped.

Cases: vectors that are null, or hold null or non-finite components, take no part; vectors of different dimensions
aren't compared; ties go to the smaller vec_id; repeated rows are candidates of their own, but as queries, rows equal in
id and vector ask once, and different vectors under one id ask each, with ranks of their own; a query's own id is never
its candidate; fewer than k candidates give fewer rows; empty tables give empty results; other columns are ignored.
Scores beyond 2^53 are computed with whole numbers of any size. A component or a score beyond a long is the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions

BLOCK = 4096
QUERY_BLOCK = 1024
#: From this local cosine threshold on, coordinates prune better than lengths.
HIGH = 0.6
BLOCKS = "dim int, block long, n int, top double, ids binary, data binary"
HITS = "query long, query_id long, vec_id long, score long"
LONG = 2**63


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, dim, v: floor(scale * x) as double, norm2) of the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # floor() of a double is a long; 2^63 - 1024 is the greatest double below 2^63
    least, most = F.lit(-float(LONG)), F.lit(float(LONG - 1024))
    v = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(F.lit(float(scale)) * x.cast("double"), least), most)).cast("double"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), v.alias("v"))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """BLOCKS: the rows as they come, up to `size` of one dimension to a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        number = 0

        def block(dim: int) -> pa.RecordBatch:
            nonlocal number
            ids, data = (np.concatenate(x) for x in waiting.pop(dim))
            number += 1
            order = np.argsort(-(data * data).sum(1), kind="stable")
            ids, data = ids[order], data[order]
            top = float(np.sqrt((data[0] * data[0]).sum())) if dim else 0.0
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([number], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([top]), pa.array([ids.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], names=["dim", "block", "n", "top", "ids", "data"])

        for batch in batches:
            ids, dims = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                data = flat.reshape(-1, dim) if len(at) == len(dims) and dim else flat[(ends[at] - dim)[:, None] + np.arange(dim)].reshape(len(at), dim)
                for i in range(0, len(at), size):
                    own = waiting.setdefault(int(dim), ([], []))
                    own[0].append(ids[at[i : i + size]].astype(np.int64))
                    own[1].append(data[i : i + size].astype(np.float64))
                    if sum(map(len, own[0])) >= size:
                        yield block(int(dim))
        for dim in sorted(waiting):
            yield block(dim)

    return rows.select("vec_id", "dim", "v").mapInArrow(run, BLOCKS)


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    dim = queries.shape[1]
    most = (np.abs(queries).max(initial=0) * np.abs(candidates).max(initial=0)) * max(dim, 1)
    if most < 2**24:
        return (queries.astype(np.float32) @ candidates.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (queries @ candidates.T).astype(np.int64)
    if not dim:
        return np.zeros((len(queries), len(candidates)), np.int64)
    # only rows with large components need whole numbers of any size
    out = np.empty((len(queries), len(candidates)), np.int64)
    q_big, c_big = (np.abs(m).max(1) for m in (queries, candidates))
    small = c_big * q_big.max(initial=0) * dim < 2**53
    out[:, small] = (queries @ candidates[small].T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    exact = whole(queries) @ whole(candidates[~small]).T
    out[:, ~small] = np.array([[min(max(int(x), -LONG), LONG - 1) for x in row] for row in exact], dtype=np.int64).reshape(exact.shape)
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to the smaller id."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], ~scores[at]))[:k]]  # ~x is -x - 1, for any long


def retrieve(q_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, ids: np.ndarray, data: np.ndarray, top: float, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of a query, candidate ids, scores) of what a block, sorted by length, may add to each query's k best."""
    q_norm, norms = np.sqrt((q * q).sum(1)), np.sqrt((data * data).sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(bound > 0, bound / (q_norm * top), -1.0)
        least = np.where(bound > 0, bound / q_norm, -1.0)
    slack = 1e-9
    live = np.flatnonzero(~(local > 1 + slack))
    high = live[local[live] >= HIGH]
    low = live[~(local[live] >= HIGH)]
    if len(low):
        # by length: a prefix for each query, the longest of which all share
        ends = np.searchsorted(-norms, -least[low] * (1 - slack), side="right")
        end = int(ends.max(initial=0))
        scores = products(q[low], data[:end])
        for row, i, own in zip(scores, low, ends):
            at = np.flatnonzero(ids[:own] != q_ids[i])
            at = at[row[at] >= bound[i]]
            yield int(i), ids[at], row[at]
    for i in high:
        # by coordinate: cos(q, p) >= t holds only if p's share at q's largest coordinate lies in an interval
        unit, t = q[i] / q_norm[i], min(local[i], 1.0) * (1 - slack)
        f = int(np.argmax(np.abs(unit)))
        half = np.sqrt(max(0.0, 1 - t * t) * max(0.0, 1 - unit[f] ** 2)) + slack
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where(norms > 0, data[:, f] / norms, 0.0)
        at = np.flatnonzero((np.abs(share - unit[f] * t) <= half) | (share * np.sign(unit[f]) >= abs(unit[f]) * t))
        at = at[(norms[at] >= least[i] * (1 - slack)) & (ids[at] != q_ids[i])]
        row = products(q[i : i + 1], data[at])[0] if len(at) else np.zeros(0, np.int64)
        at, row = at[row >= bound[i]], row[row >= bound[i]]
        yield int(i), ids[at], row


def local_hits(pairs: DataFrame, k: int) -> DataFrame:
    """HITS of pairs of blocks: columns q_block, q_ids, q_data, q_bound, dim, top, ids, data. A query's number is its block's
    and its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                q_block, q_ids, q_data, q_bound, dim, top, ids, data = (batch.column(i)[r].as_py() for i in range(8))
                q_ids, ids = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                q, p = np.frombuffer(q_data).reshape(len(q_ids), dim), np.frombuffer(data).reshape(len(ids), dim)
                bound = np.frombuffer(q_bound) if q_bound else np.full(len(q_ids), -np.inf)
                out: list[list[np.ndarray]] = [[], [], [], []]
                for query, found, scores in retrieve(q_ids, q, bound, ids, p, top, k):
                    at = best(scores, found, k)
                    for to, value in zip(out, (np.full(len(at), q_block * QUERY_BLOCK + query, np.int64), np.full(len(at), q_ids[query], np.int64), found[at], scores[at])):
                        to.append(value)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query", "query_id", "vec_id", "score"])

    return pairs.select("q_block", "q_ids", "q_data", "q_bound", "dim", "top", "ids", "data").mapInArrow(run, HITS)


def with_bounds(q_blocks: DataFrame, bounds: DataFrame) -> DataFrame:
    """Query blocks with their queries' bounds (query, bound) as bytes, and reach: the length that a vector must have to
    matter to any of them. A query without a bound has none to be pruned by."""
    table = bounds.groupBy(F.floor(F.col("query") / QUERY_BLOCK).alias("q_block")).agg(F.collect_list(F.struct(F.pmod("query", F.lit(QUERY_BLOCK)).alias("place"), "bound")).alias("pairs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, reach = [], []
            for dim, data, pairs in zip(batch.column("dim").to_pylist(), batch.column("q_data").to_pylist(), batch.column("pairs").to_pylist()):
                n = len(data) // (8 * dim) if dim else 0
                own = np.full(n, -np.inf)
                for p in pairs or ():
                    own[p["place"]] = p["bound"]
                q = np.frombuffer(data).reshape(n, dim)
                with np.errstate(divide="ignore", invalid="ignore"):
                    least = np.where(own > 0, own / np.sqrt((q * q).sum(1)), -1.0)
                out.append(own.tobytes() if dim else b"")
                reach.append(float(least.min(initial=np.inf)) * (1 - 1e-9) if dim else -1.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("q_block", "dim", "q_ids", "q_data")), pa.array(out, pa.binary()), pa.array(reach, pa.float64())], names=["q_block", "dim", "q_ids", "q_data", "q_bound", "reach"])

    return q_blocks.join(table, "q_block", "left").select("q_block", "dim", "q_ids", "q_data", "pairs").mapInArrow(run, "q_block long, dim int, q_ids binary, q_data binary, q_bound binary, reach double")


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = quantised(vectors, scale)
    by_length = rows.repartitionByRange(partitions(spark), F.col("dim"), F.col("norm2").desc(), "vec_id")
    stored = cut(blocks(by_length, BLOCK))
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    q_blocks = blocks(asked.repartition(F.col("dim"), F.floor(F.col("vec_id") / (every * QUERY_BLOCK))), QUERY_BLOCK)
    q_blocks = cut(q_blocks.select(F.monotonically_increasing_id().alias("q_block"), "dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data")))
    # the bucket of the longest vectors of each dimension: one block of at most BLOCK vectors
    first = stored.groupBy("dim").agg(F.max_by(F.struct("top", "ids", "data"), F.struct("top", "n", F.col("block"))).alias("b")).select("dim", "b.*")
    seeded = local_hits(q_blocks.withColumn("q_bound", F.lit(None).cast("binary")).join(first, "dim"), k)
    kth = seeded.groupBy("query").agg(F.min("score").cast("double").alias("bound"), F.count("*").alias("n")).where(F.col("n") >= k)
    bounded = cut(with_bounds(q_blocks, kth.select("query", "bound")))
    # candidates are dealt over slots of the cluster; a query block goes to the slots that have a block within its reach
    slots = partitions(spark)
    dealt = stored.withColumn("slot", F.pmod(F.xxhash64("ids"), F.lit(slots)).cast("int"))
    tops = dealt.groupBy("dim", "slot").agg(F.max("top").alias("longest"))
    wanted = bounded.select("q_block", "dim", "reach").join(tops, "dim").where(F.col("longest") >= F.col("reach")).select("q_block", "slot")
    everywhere = bounded.join(wanted, "q_block")
    hits = local_hits(everywhere.join(dealt, ["dim", "slot"]).where(F.col("top") >= F.col("reach")), k)
    # repeated rows of a query ask once; of a candidate they are candidates each
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
