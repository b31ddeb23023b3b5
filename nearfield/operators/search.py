"""Exact and pivot-partitioned nearest-neighbour search, radius search, all-vs-all and re-ranking.

Objects are (id, v), queries (qid, v), results (qid, id, rank, dist); ties go to the smaller id. Dense vectors meet in the
cells of kernels.py. Other queries meet objects slot by slot: objects are dealt over slots by hash and queries are copied
to every slot, so the pairs are an equi-join that needs no broadcast and no single task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distances import EDIT_CODES, SEQS, Distance
from .kernels import dense, hits, met

#: Vectors of a block of a cloud.
BLOCK = 512


def slots_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pairs(queries: DataFrame, objects: DataFrame) -> DataFrame:
    """(qid, q, id, v): every query with every object, dealt by slots. Slots aren't merged for being small: it is pairs that
    cost."""
    slots = slots_of(objects)
    q = queries.select("qid", F.col("v").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    o = objects.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(slots)).cast("int").alias("slot"))
    return q.repartition(slots, "slot").join(o.repartition(slots, "slot"), "slot").drop("slot")


def ranked(hits: DataFrame, k: int | Column) -> DataFrame:
    """The k best hits of each query; Spark plans a top-k per task before the shuffle."""
    order = Window.partitionBy("qid").orderBy("dist", "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "id", F.col("rank").cast("int").alias("rank"), "dist")


def knn_expression(queries: DataFrame, objects: DataFrame, dist, k: int) -> DataFrame:
    """Exact k nearest by a Catalyst expression: any distance. Where a distance has a kernel as well, that finds all which
    may be among them, ties and the last digits allowed for, and the expression decides; else each pair is computed, and
    lists of objects leave k hits a query."""
    if getattr(dist, "block", None):
        kth = knn_kernel(queries, objects, dist, k).groupBy("qid").agg(F.max("dist").alias("far"), F.count("*").alias("n"))
        far = F.when((F.col("n") >= k) & ~F.isnan("far"), F.col("far") + F.abs("far") * 1e-9 + 1e-9).otherwise(F.lit(float("inf")))
        found = hits(queries.select("qid", "v").join(kth.select("qid", far.alias("r")), "qid"), objects, dist, None)
        return rerank(found, queries, objects, dist, k)
    return ranked(pairs(queries, objects).select("qid", "id", dist(F.col("q"), F.col("v")).alias("dist")).where(F.col("dist").isNotNull()), k)


def _blocks(df: DataFrame, key: str, by: str | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """(by, ids, data, extra): rows as they come, up to BLOCK of one `by` to a block, as bytes; extra are numbers a row."""
    columns = [F.col(key).cast("long"), "v", F.col(by).cast("long") if by else F.lit(0).cast("long"), *[F.col(c).cast("double") for c in extra]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, data = batch.column(0).to_numpy(zero_copy_only=False), dense(batch.column(1))
            group, *more = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, batch.num_columns))
            more = np.stack(more, 1) if more else np.zeros((len(ids), 0))
            out: list[list] = [[], [], [], []]
            for one in np.unique(group):
                every = np.flatnonzero(group == one)
                for at in (every[i : i + BLOCK] for i in range(0, len(every), BLOCK)):
                    for to, value in zip(out, (one, ids[at].tobytes(), data[at].tobytes(), more[at].tobytes())):
                        to.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["by", "ids", "data", "extra"])

    return df.select(*columns).mapInArrow(run, "by long, ids binary, data binary, extra binary")


def least_distances(dist: Distance, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Each row's distance to the nearest of x."""
    found = list(met(dist, q, np.full(len(q), np.inf), np.arange(len(x)), x, 1))
    i, d = (np.concatenate([f[at] for f in found]) for at in (0, 2))
    return d[np.argsort(i, kind="stable")]


def knn_kernel(queries: DataFrame, objects: DataFrame, dist: Distance, k: int | None = None, radius: float | None = None) -> DataFrame:
    """Exact k nearest, or all within a radius, of dense vectors by block kernels."""
    if radius is not None:
        return hits(queries.select("qid", "v", F.lit(float(radius)).alias("r")), objects, dist, None)
    return ranked(hits(queries.select("qid", "v"), objects, dist, k), k)


def knn(queries: DataFrame, objects: DataFrame, dist, k: int) -> DataFrame:
    """Exact k nearest: block kernel where the distance has one, else an expression."""
    if k <= 0:
        raise ValueError("k must be positive")
    return knn_kernel(queries, objects, dist, k) if getattr(dist, "block", None) else knn_expression(queries, objects, dist, k)


#: Up to so many symbols, sequences are padded for a kernel.
PADDED = 1024


def knn_sequences(queries: DataFrame, objects: DataFrame, k: int) -> DataFrame:
    """Exact k nearest of strings by unit edit distance: in cells, unless the longest has more than PADDED symbols."""
    own = objects.select("id", "v").where("v is not null")
    asked = queries.select("qid", "v").where("v is not null")
    longest = max((df.agg(F.max(F.length("v"))).first()[0] or 0) for df in (own, asked))
    if longest > PADDED:
        return knn_expression(queries, objects, SEQS["levenshtein"], k)
    symbols = F.when(F.length("v") > 0, F.transform(F.split("v", ""), lambda c: F.ascii(c).cast("long"))).otherwise(F.array().cast("array<long>"))
    symbols = F.slice(symbols, 1, F.length("v"))
    padded = F.concat(F.array(F.length("v").cast("long")), symbols, F.array_repeat(F.lit(-1).cast("long"), F.lit(longest) - F.length("v")))
    return knn(asked.select("qid", padded.alias("v")), own.select("id", padded.alias("v")), EDIT_CODES, k)


def search_batch(queries: DataFrame, objects: DataFrame, dist, k: int, expected: int | None = None) -> DataFrame:
    """knn() that refuses an empty set of queries, and one of another size than expected."""
    n = queries.count() if expected is not None else queries.limit(1).count()
    if not n:
        raise ValueError("empty set of queries")
    if expected is not None and n != expected:
        raise ValueError(f"{n} queries where {expected} were expected")
    return knn(queries, objects, dist, k)


def within(queries: DataFrame, objects: DataFrame, dist, radius: float) -> DataFrame:
    """(qid, id, dist) of all objects with dist <= radius."""
    if getattr(dist, "block", None):
        return knn_kernel(queries, objects, dist, radius=radius)
    return pairs(queries, objects).select("qid", "id", dist(F.col("q"), F.col("v")).alias("dist")).where(F.col("dist") <= radius)


def mixed(queries: DataFrame, objects: DataFrame, dist) -> DataFrame:
    """Queries with their own k and/or radius columns; null means no such bound."""
    limits = queries.select("qid", F.col("k").cast("int").alias("k"), F.col("radius").cast("double").alias("radius"))
    if getattr(dist, "block", None):
        most = queries.agg(F.max("k")).first()[0]
        own = queries.select("qid", "v", "k", F.coalesce(F.col("radius").cast("double"), F.lit(float("inf"))).alias("r"))
        found = hits(own.where("k is null").select("qid", "v", "r"), objects, dist, None)
        if most is not None and most > 0:
            found = found.unionByName(hits(own.where("k is not null").select("qid", "v", "r"), objects, dist, int(most)))
    else:
        found = pairs(queries, objects).select("qid", "id", dist(F.col("q"), F.col("v")).alias("dist"))
    found = found.join(limits, "qid").where(F.col("radius").isNull() | (F.col("dist") <= F.col("radius")))
    order = Window.partitionBy("qid").orderBy("dist", "id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("k").isNull() | (F.col("rank") <= F.col("k"))).select("qid", "id", "rank", "dist")


def allknn(objects: DataFrame, dist, k: int) -> DataFrame:
    """k nearest of every object among all, itself included."""
    return knn(objects.withColumnRenamed("id", "qid"), objects, dist, k)


def rerank(hits: DataFrame, queries: DataFrame, objects: DataFrame, dist, k: int) -> DataFrame:
    """Given candidates under another distance, ranked anew."""
    joined = hits.select("qid", "id").join(queries.select("qid", F.col("v").alias("q")), "qid").join(objects.select("id", "v"), "id")
    return ranked(joined.select("qid", "id", dist(F.col("q"), F.col("v")).alias("dist")), k)


def recall(gold: DataFrame, found: DataFrame) -> DataFrame:
    """(qid, recall): the share of gold ids that were found."""
    hit = found.select("qid", "id", F.lit(1).alias("hit"))
    return gold.join(hit, ["qid", "id"], "left").groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall"))


def assign(objects: DataFrame, centers: DataFrame, dist) -> DataFrame:
    """(id, center, dist): each object's nearest center, ties to the smaller center."""
    return knn(objects.withColumnRenamed("id", "qid"), centers, dist, 1).select(F.col("qid").alias("id"), F.col("id").alias("center"), "dist")


def baskets_of(objects: DataFrame, centers: DataFrame, dist) -> DataFrame:
    """(center, id, v, d_center): objects by their nearest center. A pivot index; it may be stored and searched again."""
    return assign(objects, centers, dist).withColumnRenamed("dist", "d_center").join(objects.select("id", "v"), "id")


def pivot_search(queries: DataFrame, objects: DataFrame, centers: DataFrame, dist, k: int, probes: int | None = None, baskets: DataFrame | None = None) -> DataFrame:
    """k nearest over baskets of objects by nearest center. With probes, each query visits its nearest baskets only
    (approximate). Without, the answer is exact: the nearest baskets that hold k objects give each query a bound, by
    which the triangle inequality prunes baskets, and then objects, of the rest."""
    if probes is None and dist.kind != "metric":
        raise ValueError("exact pruning needs a metric")
    own = baskets_of(objects, centers, dist) if baskets is None else baskets
    to_centers = knn(queries, centers, dist, probes or 2**31 - 1).select("qid", F.col("id").alias("center"), "rank", F.col("dist").alias("d_query"))

    if probes is not None:
        return ranked(_in_baskets(to_centers, queries, own, dist, k), k)
    cover = own.groupBy("center").agg(F.max("d_center").alias("cover"), F.count("*").alias("size"))
    near = to_centers.join(cover, "center")
    before = F.coalesce(F.sum("size").over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = near.withColumn("first", before < k)
    start = _in_baskets(near.where("first"), queries, own, dist, k)
    bound = ranked(start, k).groupBy("qid").agg(F.max("dist").alias("r"), F.count("*").alias("n")).select("qid", F.when(F.col("n") >= k, F.col("r")).alias("r"))
    rest = near.where("not first").join(bound, "qid", "left").where(F.col("r").isNull() | (F.col("d_query") <= F.col("r") + F.col("cover") + 1e-9))
    rest = rest.withColumn("r", F.coalesce("r", F.lit(float("inf"))))
    return ranked(start.unionByName(_in_baskets(rest, queries, own, dist, k, pruned=True)), k)


def _in_baskets(asked: DataFrame, queries: DataFrame, baskets: DataFrame, dist, k: int | None, radius: float | None = None, pruned: bool = False) -> DataFrame:
    """(qid, id, dist) of queries with the objects of their baskets: asked has qid, center and, if objects are pruned,
    d_query and the bound r."""
    asked = asked.select("qid", "center", *(["d_query", "r"] if pruned else [])).join(queries.select("qid", "v"), "qid")
    if getattr(dist, "block", None):
        bound = F.col("r") if pruned and radius is None else F.lit(float("inf") if radius is None else float(radius))
        return hits(asked.select("qid", "v", "center", bound.alias("r")), baskets, dist, k, "center")
    both = asked.withColumnRenamed("v", "q").join(baskets, "center")
    if pruned:
        both = both.where(F.abs(F.col("d_query") - F.col("d_center")) <= F.col("r") + 1e-9)
    found = both.select("qid", "id", dist(F.col("q"), F.col("v")).alias("dist"))
    return found if radius is None else found.where(F.col("dist") <= radius)


def pivot_within(queries: DataFrame, objects: DataFrame, centers: DataFrame, dist, radius: float, baskets: DataFrame | None = None) -> DataFrame:
    """(qid, id, dist) of all objects with dist <= radius: baskets, and objects in them, that the triangle inequality puts
    farther away aren't looked at."""
    if dist.kind != "metric":
        raise ValueError("exact pruning needs a metric")
    own = baskets_of(objects, centers, dist) if baskets is None else baskets
    cover = own.groupBy("center").agg(F.max("d_center").alias("cover"))
    to_centers = knn(queries, centers, dist, 2**31 - 1).select("qid", F.col("id").alias("center"), F.col("dist").alias("d_query"))
    live = to_centers.join(cover, "center").where(F.col("d_query") <= F.lit(radius) + F.col("cover") + 1e-9).withColumn("r", F.lit(float(radius)))
    return _in_baskets(live, queries, own, dist, None, radius, pruned=True)
