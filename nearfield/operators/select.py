"""Representatives and near-duplicate removal. Random choices order ids by the MD5 digest of "id:seed", so that
results don't depend on partitioning. Loops run over centers or rounds, never over rows, and cut lineage with checkpoints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import cut, dense, hits
from .search import assign, pairs, pivot_within, within


def hash_order(seed: int, *names: str) -> Column:
    """A key that orders rows at random, by id or other columns."""
    return F.md5(F.concat_ws(":", *[F.col(n).cast("string") for n in names or ("id",)], F.lit(str(seed))))


def farthest_first(objects: DataFrame, dist, k: int, start: int, every: int = 10) -> tuple[DataFrame, dict]:
    """(id, center, dist) after k farthest-first centers from `start`, and a report: centers in order, covradius (the
    greatest distance to a center), separation (the least distance between centers) and costdists (distances computed).
    k stops at the objects' number.

    An earlier center keeps ties; of equally far objects the smaller id is next.
    """
    vectors = objects.select("id", "v")
    first = vectors.where(F.col("id") == start).first()
    if first is None:
        raise ValueError(f"no object {start}")
    state = vectors.select("id", "v", F.lit(None).cast("long").alias("center"), F.lit(float("inf")).alias("dist"))
    centers, pivot, gaps = [], first, []
    while True:
        centers.append(pivot["id"])
        d = dist(F.col("v"), F.array(*[F.lit(float(x)) for x in pivot["v"]]))
        state = state.withColumn("d", d).select("id", "v", F.when(F.col("d") < F.col("dist"), F.lit(pivot["id"])).otherwise(F.col("center")).alias("center"), F.least("dist", "d").alias("dist"))
        if len(centers) % every == 0:
            state = cut(state)
        far = state.orderBy(F.desc("dist"), "id").limit(1).first()
        if len(centers) == k or far["dist"] == 0 or far["id"] in centers:
            return state.select("id", "center", "dist"), {"centers": centers, "covradius": far["dist"], "separation": min(gaps, default=float("inf")), "costdists": len(centers) * vectors.count()}
        gaps.append(far["dist"])
        pivot = far


def random_centers(objects: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k distinct objects, first in hash order."""
    return objects.orderBy(hash_order(seed), "id").limit(k)


def random_selection(objects: DataFrame, dist, k: int, seed: int = 0) -> DataFrame:
    """(id, center, dist): every object with its nearest of k random centers."""
    return assign(objects, random_centers(objects, k, seed), dist)


def density_net(objects: DataFrame, dist, centers: int, seed: int = 0) -> DataFrame:
    """(id, center, dist): again and again the last object left in hash order takes its n // centers nearest as a group,
    itself among them."""
    left = cut(objects.select("id", "v").withColumn("order", hash_order(seed)))
    size = max(1, left.count() // centers)
    groups: list[DataFrame] = []
    while (pivot := left.orderBy(F.desc("order"), F.desc("id")).limit(1).first()) is not None:
        d = dist(F.col("v"), F.array(*[F.lit(float(x)) for x in pivot["v"]]))
        near = left.select("id", F.lit(pivot["id"]).alias("center"), d.alias("dist"))
        group = cut(near.orderBy(F.col("id") != pivot["id"], "dist", "id").limit(size))
        groups.append(group)
        left = cut(left.join(group.select("id"), "id", "left_anti"))
    found = groups[0]
    for group in groups[1:]:
        found = found.unionByName(group)
    return found


def multi_random(objects: DataFrame, dist, k: int, seed: int = 0) -> tuple[DataFrame, dict]:
    """(id, center, dist) with k centers: from each of k disjoint hash-ordered blocks of log2 n objects the one with the
    greatest sum of distances to the centers so far. Only k blocks of candidates reach the driver, k log2 n vectors."""
    n = objects.count()
    k, m = min(k, n), max(1, int(np.ceil(np.log2(max(n, 2)))))
    rows = objects.orderBy(hash_order(seed), "id").limit(k * m).collect()
    chosen, gap = [rows[0]], float("inf")
    for at in range(m, min(len(rows), k * m), m):
        block = rows[at : at + m]
        d = dist.block(np.array([r["v"] for r in block], np.float64), np.array([c["v"] for c in chosen], np.float64))
        best = int(d.sum(1).argmax())
        gap = min(gap, float(d[best].min()))
        chosen.append(block[best])
    centers = objects.join(objects.sparkSession.createDataFrame([(c["id"],) for c in chosen], "id long"), "id", "left_semi")
    return assign(objects, centers, dist), {"centers": [c["id"] for c in chosen], "separation": gap}


#: Objects of a round of net().
ROUND = 8192


def net(objects: DataFrame, dist, epsilon: float, block: int | None = None, filter_blocks: bool = True) -> DataFrame:
    """near_duplicates() of dense vectors. The undecided objects of least ids, ROUND at a time, are decided in one task;
    those of the rest that are within epsilon of a newly kept one are out. So no list of all pairs within epsilon is made:
    objects are compared with kept ones, which are far from each other, and with few others."""
    number = F.floor(F.col("id") / block).cast("long") if block is not None else F.col("id").cast("long")
    rows = cut(objects.select(F.col("id").cast("long").alias("id"), "v", number.alias("block")))
    # what must be less for a link to count
    order = F.col("block") if block is not None and not filter_blocks else F.col("id")
    left = rows.select("id", "v", order.alias("order"))
    kind = left.schema["v"].dataType

    def decide(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        whole = pa.Table.from_batches(parts).combine_chunks().sort_by("id")
        at, x = whole["order"].to_numpy(), dense(whole["v"].combine_chunks(), dist.dtype)
        kept = np.ones(len(x), bool)
        for i in range(len(x)):
            if kept[i]:
                rest = np.flatnonzero(kept[i + 1 :]) + i + 1
                rest = rest[at[rest] > at[i]]
                d = dist.rows(np.broadcast_to(x[i], (len(rest), x.shape[1])), x[rest]) if dist.rows else dist.block(x[i : i + 1], x[rest])[0]
                kept[rest[d <= epsilon]] = False
        yield from whole.append_column("kept", pa.array(kept)).to_batches(max_chunksize=1024)

    kept = None
    while True:
        first = left.orderBy("id").limit(ROUND).mapInArrow(decide, f"id long, v {kind.simpleString()}, order long, kept boolean")
        first = cut(first)
        last = first.agg(F.max("id")).first()[0]
        if last is None:
            break
        new = first.where("kept").select("id", "v", "order")
        kept = new if kept is None else kept.unionByName(new)
        rest = left.where(F.col("id") > last)
        out = hits(rest.withColumnRenamed("id", "qid"), new, dist, 1, earlier=epsilon)
        left = cut(rest.join(out.select(F.col("qid").alias("id")).distinct(), "id", "left_anti"))
    if kept is None:
        return rows.select("id", F.col("id").alias("nn"), F.lit(0.0).alias("dist"), F.lit(True).alias("kept"))
    kept = cut(kept.select("id", F.lit(True).alias("kept")).join(rows, "id"))
    gone = cut(rows.join(kept.select("id"), "id", "left_anti"))
    own = F.col("block") if block is not None else F.col("id")
    best = lambda found: found.groupBy("qid").agg(F.min(F.struct("dist", "id")).alias("b")).select(F.col("qid").alias("id"), F.col("b.id").alias("near"), F.col("b.dist").alias("dist"))
    near = cut(best(hits(gone.select(F.col("id").alias("qid"), "v", own.alias("order")), kept.select("id", "v", own.alias("order")), dist, 1, earlier=epsilon)))
    if block is not None and filter_blocks:
        # those that only their own block has a kept neighbour for
        alone = gone.join(near.select("id"), "id", "left_anti")
        near = near.unionByName(best(hits(alone.select(F.col("id").alias("qid"), "v", "block", F.col("id").alias("order")), kept.select("id", "v", "block", F.col("id").alias("order")), dist, 1, "block", epsilon)))
    found = gone.select("id").join(near, "id", "left").select("id", F.col("near").alias("nn"), "dist", F.lit(False).alias("kept"))
    return kept.select("id", F.col("id").alias("nn"), F.lit(0.0).alias("dist"), "kept").unionByName(found)


def near_duplicates(objects: DataFrame, dist, epsilon: float, block: int | None = None, filter_blocks: bool = True, centers: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """(id, nn, dist, kept): the greedy net in id order. An object is kept if no kept one of smaller id is within
    epsilon; others name their nearest kept object of smaller id.

    With `block`, ids are dealt in blocks of that many, and an object names one of an earlier block if any is within
    epsilon; without filter_blocks, objects of one block aren't compared with each other.

    Vectors with a kernel are compared with kept objects only (net()). Else pairs within epsilon are found by comparing
    all, or, given centers of a metric, by baskets that the triangle inequality leaves; or they are given as links (qid,
    id, dist), from an approximate index, say.

    The greedy pass over links is restated as rounds: an undecided object with a kept smaller neighbour goes; one whose
    smaller neighbours are all gone stays.
    """
    if links is None and centers is None and getattr(dist, "block", None):
        return net(objects, dist, epsilon, block, filter_blocks)
    ids = objects.select("id")
    if links is None:
        asked = objects.select(F.col("id").alias("qid"), "v")
        links = within(asked, objects, dist, epsilon) if centers is None else pivot_within(asked, objects, centers, dist, epsilon)
    links = links.where((F.col("id") < F.col("qid")) & (F.col("dist") <= epsilon))
    same = F.lit(False) if block is None else F.floor(F.col("qid") / block) == F.floor(F.col("id") / block)
    links = links.select(F.col("qid").alias("b"), F.col("id").alias("a"), "dist", same.alias("same"))
    links = cut(links if filter_blocks else links.where("not same"))
    state = cut(ids.select("id", F.lit(None).cast("boolean").alias("kept")))
    while True:
        around = links.select("a", "b").join(state.select(F.col("id").alias("a"), F.col("kept").alias("a_kept")), "a")
        seen = around.groupBy(F.col("b").alias("id")).agg(F.max(F.coalesce("a_kept", F.lit(False))).alias("dup"), F.max(F.col("a_kept").isNull()).alias("open"))
        new = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("dup", F.lit(False)), F.lit(False)).when(~F.coalesce("open", F.lit(False)), F.lit(True))
        state = cut(state.join(seen, "id", "left").select("id", new.alias("kept")))
        if not state.where("kept is null").limit(1).count():
            break
    order = Window.partitionBy("b").orderBy("same", "dist", "a")
    nearest = links.join(state.where("kept").select(F.col("id").alias("a")), "a").withColumn("n", F.row_number().over(order)).where("n = 1")
    found = state.join(nearest.select(F.col("b").alias("id"), F.col("a").alias("near"), "dist"), "id", "left")
    return found.select("id", F.when(F.col("kept"), F.col("id")).otherwise(F.col("near")).alias("nn"), F.when(F.col("kept"), F.lit(0.0)).otherwise(F.col("dist")).alias("dist"), "kept")


def places(objects: DataFrame, seed: int) -> DataFrame:
    """(place, id, total): objects numbered from 0 in hash order; places are counted by hash prefix first and then inside
    a prefix, so that no task ranks all objects."""
    keyed = objects.select("id", hash_order(seed).alias("h")).withColumn("prefix", F.substring("h", 1, 3))
    counted = keyed.groupBy("prefix").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = counted.select("prefix", before.alias("before"), F.sum("rows").over(Window.partitionBy()).alias("total"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("prefix").orderBy("h", "id")) - 1
    return keyed.join(counted, "prefix").select(place.alias("place"), "id", "total")


def drawn(seed: int) -> Column:
    """A number below 16^15 for each draw."""
    return F.conv(F.substring(hash_order(seed, "draw"), 1, 15), 16, 10).cast("long")


def distance_sample(objects: DataFrame, dist, share: float, seed: int = 0) -> DataFrame:
    """(a, b, dist) of random pairs of different objects: as many draws as `share` of all pairs, or all pairs a < b with
    a share of 1. A draw is a number of a pair, so that no more pairs than wanted are made."""
    if share >= 1:
        both = pairs(objects.withColumnRenamed("id", "qid"), objects).where("qid < id")
        return both.select(F.col("qid").alias("a"), F.col("id").alias("b"), dist(F.col("q"), F.col("v")).alias("dist"))
    n = objects.count()
    every = n * (n - 1) // 2
    draws = objects.sparkSession.range(int(np.ceil(every * share))).withColumnRenamed("id", "draw")
    # pair number r: the r-th of (0, 1), (0, 2), (1, 2), (0, 3), ...
    draws = draws.withColumn("r", F.pmod(drawn(seed), F.lit(max(every, 1))))
    guess = F.floor((F.lit(1.0) + F.sqrt(F.lit(1.0) + F.lit(8.0) * F.col("r"))) / 2).cast("long")
    start = lambda b: F.floor(b * (b - 1) / 2).cast("long")
    draws = draws.withColumn("g", guess)
    high = F.when(start(F.col("g")) > F.col("r"), F.col("g") - 1).when(start(F.col("g") + 1) <= F.col("r"), F.col("g") + 1).otherwise(F.col("g"))
    draws = draws.withColumn("high", high).withColumn("low", F.col("r") - start(F.col("high")))
    own = cut(places(objects, seed).select("place", "id")).join(objects.select("id", "v"), "id")
    both = draws.join(own.select(F.col("place").alias("low"), F.col("id").alias("a"), F.col("v").alias("v_a")), "low")
    both = both.join(own.select(F.col("place").alias("high"), F.col("id").alias("b"), F.col("v").alias("v_b")), "high")
    return both.select("a", "b", dist(F.col("v_a"), F.col("v_b")).alias("dist"))


def distance_pairs(objects: DataFrame, dist, n: int, seed: int = 0) -> DataFrame:
    """(a, b, dist) of n random pairs: two random choices of n objects, one by one; an object may meet itself."""
    def side(name: str, own: int) -> DataFrame:
        first = objects.orderBy(hash_order(own), "id").limit(n)
        return first.select(F.col("id").alias(name), F.col("v").alias(f"v_{name}"), F.row_number().over(Window.orderBy(hash_order(own, "id"), "id")).alias("n"))

    both = side("a", seed).join(side("b", seed + 1), "n")
    return both.select("a", "b", dist(F.col("v_a"), F.col("v_b")).alias("dist"))


def random_sample(objects: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(draw, id): n draws with replacement. A draw is a place in the objects' hash order."""
    placed = places(objects, seed)
    total = placed.select("total").limit(1)
    draws = objects.sparkSession.range(n).withColumnRenamed("id", "draw").crossJoin(F.broadcast(total)).select("draw", F.pmod(drawn(seed), F.col("total")).alias("place"))
    return draws.join(placed.select("place", "id"), "place").select("draw", "id")


def subset(objects: DataFrame, ids: list[int]) -> DataFrame:
    """(pos, id, v): a view of the objects by a list of ids, in its order; an id may occur again."""
    wanted = objects.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, id long")
    return objects.select("id", "v").join(F.broadcast(wanted), "id").select("pos", "id", "v")


def masked(objects: DataFrame, mask: Column) -> DataFrame:
    """The objects where the mask holds, under their own ids."""
    return objects.where(mask)
