"""Proximity graphs: edge tables, their upkeep, and approximate search by rounds of frontier joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import folded, hsp
from .kernels import paired
from .search import allknn, knn, ranked, recall
from .select import cut, distance_sample, farthest_first, hash_order, near_duplicates, random_centers


def reverse_links(edges: DataFrame) -> DataFrame:
    """Edges both ways, once each, without self loops. edges is read once."""
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.where("src <> dst").select(F.explode(ways).alias("way")).select("way.src", "way.dst").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree), 0 for nodes without neighbours."""
    return nodes.select("id").join(edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")), "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_quantiles(nodes: DataFrame, edges: DataFrame, at: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Quantiles of the degrees, whose distinct values are few."""
    return degrees(nodes, edges).agg(F.percentile("degree", F.array(*[F.lit(q) for q in at])).alias("quantiles"))


def compressed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, start, neighbours): compressed sparse rows; start is the 0-based place of a node's first neighbour.

    Offsets are summed over hash-free ranges of ids: totals of ranges first, then inside each."""
    rows = nodes.select("id").join(edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("n")), "id", "left").select("id", F.coalesce("n", F.array().cast("array<long>")).alias("neighbours"))
    rows = rows.withColumn("range", F.floor(F.col("id") / 4096))
    totals = rows.groupBy("range").agg(F.sum(F.size("neighbours")).alias("total"))
    before = totals.withColumn("before", F.coalesce(F.sum("total").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("range", "before")
    inside = Window.partitionBy("range").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(before, "range").select("id", (F.col("before") + F.coalesce(F.sum(F.size("neighbours")).over(inside), F.lit(0))).cast("long").alias("start"), "neighbours")


def neighbourhood(n: int, minsize: int = 2, base: float = 1.3) -> int:
    """How many candidates an object's neighbours are chosen from: they grow with the logarithm of the objects' number."""
    return minsize if n == 0 else int(np.ceil(minsize + np.log(n) / np.log(base)))


def filtered(near: DataFrame, objects: DataFrame, dist, kind: str, centers: int = 8) -> DataFrame:
    """Which of its candidates (qid, id, rank, dist) become an object's neighbours: half-space proximal ones (sat), from the
    farthest (distal), all (identity), or the nearest to each of farthest-first centers of the candidates (kcenters)."""
    if kind == "identity":
        return near
    if kind in ("sat", "distal"):
        return hsp(near, objects, dist, "descending" if kind == "distal" else "ascending")
    if kind != "kcenters":
        raise ValueError(f"unknown filter {kind}")

    def choose(_, v: np.ndarray, d: np.ndarray) -> list[int]:
        kept, far = [0], dist.block(v, v[:1])[:, 0]
        while len(kept) < min(centers, len(v)) and far.max() > 0:
            kept.append(int(far.argmax()))
            far = np.minimum(far, dist.block(v, v[kept[-1:]])[:, 0])
        return sorted(kept)

    return folded(near, objects, choose)


def build(objects: DataFrame, dist, candidates: int | None = None, prune: bool | str = True) -> DataFrame:
    """(src, dst): each object's nearest candidates (neighbourhood() of them), those that a filter keeps, half-space
    proximal ones unless another is named, with reverse links. Stored: each round of a search reads them."""
    candidates = candidates or neighbourhood(objects.count())
    near = allknn(objects, dist, candidates + 1).where("qid <> id")
    kept = filtered(near, objects, dist, "sat" if prune is True else prune or "identity")
    return cut(reverse_links(kept.select(F.col("qid").alias("src"), F.col("id").alias("dst"))))


def rebuild(objects: DataFrame, edges: DataFrame, dist, candidates: int | None = None, prune: bool | str = True, **options) -> DataFrame:
    """(src, dst) of a new graph over the same objects: each looks for its neighbours anew in the old graph, from itself
    on, so no object is compared with all."""
    candidates = candidates or neighbourhood(objects.count())
    near = cut(allknn_graph(objects, edges, dist, candidates + 1, **options).where("qid <> id"))
    kept = filtered(near, objects, dist, "sat" if prune is True else prune or "identity")
    return cut(reverse_links(kept.select(F.col("qid").alias("src"), F.col("id").alias("dst"))))


def prefix_groups(objects: DataFrame, centers: DataFrame, dist, length: int = 2) -> DataFrame:
    """(id, key): objects by the sorted ids of their nearest centers."""
    near = knn(objects.withColumnRenamed("id", "qid"), centers, dist, length)
    return near.groupBy(F.col("qid").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("id")), "-").alias("key"))


def explore(visited: DataFrame, queries: DataFrame, objects: DataFrame, edges: DataFrame, dist, width: int | DataFrame, rounds: int, k: int | None = None, delta: float | None = None, max_visits: int | None = None) -> DataFrame:
    """(qid, id, dist, expanded): rounds that expand the unvisited of each query's best `width` objects until no query
    has one, from visited (qid, id, dist). Queries advance together; all state is tables. width may be a table (qid,
    width).

    With delta, only objects within delta times the query's k-th distance are expanded; a query that has looked at more
    than max_visits objects expands no more.
    """
    visited = visited.select("qid", "id", "dist").withColumn("expanded", F.lit(False))
    visited = cut(visited.join(width, "qid") if isinstance(width, DataFrame) else visited.withColumn("width", F.lit(width)))
    order = Window.partitionBy("qid").orderBy("dist", "id")
    for _ in range(rounds):
        best = visited.withColumn("n", F.row_number().over(order))
        if max_visits is not None:
            best = best.withColumn("looked", F.count("*").over(Window.partitionBy("qid"))).where(F.col("looked") <= max_visits)
        if delta is not None:
            best = best.withColumn("bound", F.max(F.when(F.col("n") <= (F.lit(k) if k else F.col("width")), F.col("dist"))).over(Window.partitionBy("qid")))
            best = best.where(F.col("dist") <= F.lit(float(delta)) * F.col("bound"))
        frontier = cut(best.where((F.col("n") <= F.col("width")) & ~F.col("expanded")).select("qid", "id", "width"))
        if not frontier.limit(1).count():
            break
        reached = frontier.join(edges, F.col("id") == F.col("src")).select("qid", F.col("dst").alias("id"), "width").distinct().join(visited.select("qid", "id"), ["qid", "id"], "left_anti")
        scored = reached.join(queries.select("qid", F.col("v").alias("q")), "qid").join(objects.select("id", "v"), "id").select("qid", "id", paired(dist)(F.col("q"), F.col("v")).alias("dist"), F.lit(False).alias("expanded"), "width")
        done = visited.join(frontier.select("qid", "id", F.lit(True).alias("now")), ["qid", "id"], "left").select("qid", "id", "dist", (F.col("expanded") | F.coalesce("now", F.lit(False))).alias("expanded"), "width")
        visited = cut(done.unionByName(scored))
    return visited.drop("width")


def default_entries(objects: DataFrame) -> DataFrame:
    """(id, v) of the entry points of a search without hints: the first ceil(log2(n + 1)) objects by id."""
    return objects.select("id", "v").orderBy("id").limit(int(np.ceil(np.log2(objects.count() + 1))))


def visits(queries: DataFrame, objects: DataFrame, edges: DataFrame, dist, k: int, beam: int | DataFrame = 16, hints: int = 32, rounds: int = 12, seed: int = 0, entry: DataFrame | None = None, delta: float | None = None, max_visits: int | None = None) -> DataFrame:
    """(qid, id, dist, expanded) of all objects that a search looks at: the hints (random ones if no entry is given, the
    default entries if that is empty) first, then their neighbours as far as the beam, delta and max_visits go."""
    entry = random_centers(objects, hints, seed) if entry is None else entry.select("id", "v")
    if not entry.limit(1).count():
        entry = default_entries(objects)
    width = beam if isinstance(beam, DataFrame) else max(beam, k)
    return explore(knn(queries, entry.select("id", "v"), dist, max(hints, k)), queries, objects, edges, dist, width, rounds, k, delta, max_visits)


def search(queries: DataFrame, objects: DataFrame, edges: DataFrame, dist, k: int, **options) -> DataFrame:
    """Approximate k nearest by beam search; options are those of visits()."""
    return ranked(visits(queries, objects, edges, dist, k, **options).select("qid", "id", "dist"), k)


def allknn_graph(objects: DataFrame, edges: DataFrame, dist, k: int, beam: int = 16, rounds: int = 12) -> DataFrame:
    """Approximate k nearest of every object, itself included, each starting from itself and its own neighbours."""
    queries = objects.select(F.col("id").alias("qid"), "v")
    start = edges.select(F.col("src").alias("qid"), F.col("dst").alias("id")).union(objects.select(F.col("id").alias("qid"), "id")).distinct()
    scored = start.join(queries.withColumnRenamed("v", "q"), "qid").join(objects.select("id", "v"), "id").select("qid", "id", paired(dist)(F.col("q"), F.col("v")).alias("dist"))
    return ranked(explore(scored, queries, objects, edges, dist, max(beam, k), rounds).select("qid", "id", "dist"), k)


def searcher(objects: DataFrame, dist, recall_: float = 1.0, queries: DataFrame | None = None, k: int = 8, sample: int = 64):
    """A function (queries, k) -> hits over objects that reaches a recall: an exact search for 1, else a search of a graph
    that is tuned for the recall on a sample of queries."""
    if recall_ >= 1:
        return lambda asked, n: knn(asked, objects, dist, n)
    edges = cut(build(objects, dist))
    asked = random_centers(objects.select("id", "v"), sample) if queries is None else random_centers(queries.select(F.col("qid").alias("id"), "v"), sample)
    config, _ = tune(cut(asked.select(F.col("id").alias("qid"), "v")), objects, edges, dist, k, min_recall(recall_))
    return lambda asked, n: search(asked, objects, edges, dist, n, beam=max(config["beam"], n), delta=config["delta"])


def closest_pairs_recall(left: DataFrame, right: DataFrame, dist, k: int = 1, recall_: float = 1.0, min_k: int = 8, same: bool = False) -> DataFrame:
    """(a, b, dist): the k smallest pairs of left and right, each b's nearest a's being found with a recall."""
    asked = right.select(F.col("id").alias("qid"), "v")
    near = searcher(left, dist, recall_, asked, max(k, min_k) + same)(asked, max(k, min_k) + same)
    found = near.where("qid <> id") if same else near
    return found.select(F.col("id").alias("a"), F.col("qid").alias("b"), "dist").orderBy("dist", "a", "b").limit(k)


def near_duplicates_recall(objects: DataFrame, dist, epsilon: float, recall_: float = 1.0, k: int = 8, edges: DataFrame | None = None, **options) -> DataFrame:
    """near_duplicates() over each object's k nearest instead of all: found in a graph, a given one or one that is tuned
    for the recall, and exactly with a recall of 1."""
    if recall_ >= 1 and edges is None:
        return near_duplicates(objects, dist, epsilon, **options)
    if edges is not None:
        near = allknn_graph(objects, edges, dist, k + 1)
    else:
        near = searcher(objects, dist, recall_, None, k + 1)(objects.select(F.col("id").alias("qid"), "v"), k + 1)
    # a link that only one side found counts for both
    both = near.select("qid", "id", "dist").union(near.select(F.col("id").alias("qid"), F.col("qid").alias("id"), "dist"))
    return near_duplicates(objects, dist, epsilon, links=cut(both.where("qid <> id").dropDuplicates(["qid", "id"])), **options)


def closest_pairs_graph(objects: DataFrame, edges: DataFrame, dist, k: int = 1, min_k: int = 8, **options) -> DataFrame:
    """(a, b, dist): approximately the k smallest ordered pairs of different objects."""
    near = allknn_graph(objects, edges, dist, max(k, min_k) + 1, **options).where("qid <> id")
    return near.select(F.col("id").alias("a"), F.col("qid").alias("b"), "dist").orderBy("dist", "a", "b").limit(k)


# Upkeep.
def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, neighbours) of the given ids; an empty array for those without."""
    own = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("n"))
    return ids.select("id").join(own, "id", "left").select("id", F.coalesce("n", F.array().cast("array<long>")).alias("neighbours"))


def add(edges: DataFrame, more: DataFrame) -> DataFrame:
    """edges with more (src, dst), each once."""
    return edges.select("src", "dst").unionByName(more.select("src", "dst")).distinct()


def append(objects: DataFrame, edges: DataFrame, new: DataFrame, dist, candidates: int | None = None) -> DataFrame:
    """edges of the graph with new objects: these look for neighbours among the old and each other."""
    whole = objects.select("id", "v").unionByName(new.select("id", "v"))
    candidates = candidates or neighbourhood(whole.count())
    near = knn(new.select(F.col("id").alias("qid"), "v"), whole, dist, candidates + 1).where("qid <> id")
    kept = hsp(near, whole, dist)
    return add(edges, reverse_links(kept.select(F.col("qid").alias("src"), F.col("id").alias("dst"))))


class Frozen:
    """A graph as compressed sparse rows, which takes no more edges."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.rows = compressed(nodes, edges)

    def add(self, more: DataFrame) -> None:
        raise TypeError("a frozen graph takes no edges")


def rings(members: DataFrame, links: int = 2, each: int = 16, seed: int = 0) -> DataFrame:
    """(src, dst) that connect the members (key, id) of each group: buckets of about `each` members are rings in hash
    order, with `links` steps, and the buckets' first members go on to the next round. No group meets in one task."""
    found = None
    while True:
        sizes = members.groupBy("key").agg(F.count("*").alias("size"))
        dealt = members.join(sizes, "key").withColumn("buckets", F.ceil(F.col("size") / each).cast("long"))
        dealt = cut(dealt.select("key", "id", "buckets", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("buckets")).alias("bucket"), F.xxhash64("id", F.lit(seed + 1)).alias("h")))
        order = Window.partitionBy("key", "bucket").orderBy("h", "id")
        for step in range(1, links + 1):
            edge = dealt.select(F.col("id").alias("src"), F.coalesce(F.lead("id", step).over(order), F.first("id").over(order)).alias("dst")).where("src <> dst")
            found = edge if found is None else found.unionByName(edge)
        members = cut(dealt.where("buckets > 1").groupBy("key", "bucket").agg(F.min(F.struct("h", "id")).alias("m")).select("key", "m.id"))
        if not members.limit(1).count():
            return found.distinct()
        seed += 2


def build_by_references(objects: DataFrame, references: DataFrame, dist, length: int = 3, links: int = 2) -> DataFrame:
    """(src, dst) without a search among all objects: objects with the same nearest references form groups, by all
    `length` of them, then by every choice of fewer, down to one; each group is connected by rings."""
    near = knn(objects.withColumnRenamed("id", "qid"), references, dist, length)
    level = near.groupBy(F.col("qid").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("key"))
    edges = None
    for size in range(length, 0, -1):
        found = rings(level, links, seed=size)
        edges = found if edges is None else edges.unionByName(found)
        if size > 1:
            shorter = F.transform("key", lambda x: F.array_remove("key", x))
            level = cut(level.select("id", F.explode(shorter).alias("key")).distinct())
    return cut(reverse_links(edges))


# Hints: entry points of a search, a bounded number.
def spread(candidates: DataFrame, edges: DataFrame, n: int, hops: int) -> list[int]:
    """The first n of candidates (id, place), a bounded table, that aren't within `hops` of an earlier one. Candidates walk
    half the hops each, since edges go both ways, and are close where they meet."""

    def walked(steps: int) -> DataFrame:
        near = candidates.select(F.col("id").alias("of"), "id")
        for _ in range(steps):
            near = cut(near.unionByName(near.join(edges, F.col("id") == F.col("src")).select("of", F.col("dst").alias("id"))).distinct())
        return near

    met = walked(hops - hops // 2).join(walked(hops // 2).withColumnRenamed("of", "other"), "id").where("of <> other")
    close: dict[int, set[int]] = {}
    for r in met.select("of", "other").distinct().collect():
        close.setdefault(r["of"], set()).add(r["other"])
        close.setdefault(r["other"], set()).add(r["of"])
    chosen, gone = [], set()
    for r in candidates.orderBy("place", "id").collect():
        if r["id"] not in gone:
            chosen.append(r["id"])
            gone |= close.get(r["id"], set())
            if len(chosen) == n:
                break
    return chosen


def hints(objects: DataFrame, edges: DataFrame, n: int, kind: str = "random", dist=None, seed: int = 0, oversample: int = 4, quantile: float = 0.01) -> DataFrame:
    """(id, v) of at most n entry points.

    random: in hash order, of more than two neighbours, two steps apart. disjoint: of degree nearest the mean, no
    neighbours. kdisjoint: of a random sample, by degree, four steps apart. epsilon: a random sample without near
    duplicates, at a quantile of its distances. kcenters: farthest-first centers of a random sample, without the least
    used.
    """
    degree = degrees(objects, edges)
    many = n * oversample
    place = hash_order(seed)
    if kind == "random":
        found = spread(degree.where("degree > 2").select("id", place.alias("place")).orderBy("place", "id").limit(many), edges, n, 2)
    elif kind == "disjoint":
        mean = degree.agg(F.avg("degree")).first()[0] or 0.0
        found = spread(degree.select("id", F.abs(F.col("degree") - F.lit(mean)).alias("place")).orderBy("place", "id").limit(n), edges, n, 1)
    elif kind == "kdisjoint":
        found = spread(degree.orderBy(place, "id").limit(many).select("id", (-F.col("degree")).alias("place")), edges, n, 4)
    elif kind in ("epsilon", "kcenters"):
        sample = cut(random_centers(objects.select("id", "v"), many, seed))
        if kind == "epsilon":
            far = distance_sample(sample, dist, 1.0, seed).agg(F.percentile("dist", F.lit(quantile))).first()[0]  # of a bounded sample
            kept = near_duplicates(sample, dist, max(1e-5, far or 0.0)).where("kept").select("id")
            found = [r["id"] for r in kept.orderBy(place, "id").limit(n).collect()]
        else:
            used, report = farthest_first(sample, dist, n, sample.agg(F.min("id")).first()[0])
            times = {r["center"]: r["count"] for r in used.groupBy("center").count().collect()}
            least = sorted(times.values())[int(0.1 * len(times))]
            found = [c for c in report["centers"] if times.get(c, 0) >= least]
    else:
        raise ValueError(f"unknown kind {kind}")
    return objects.select("id", "v").join(objects.sparkSession.createDataFrame([(i,) for i in found], "id long"), "id", "left_semi")


def stored_hints(objects: DataFrame, found: DataFrame) -> DataFrame:
    """Hints with their vectors as a table of their own (one partition), so that a search doesn't look them up again."""
    return cut(objects.select("id", "v").join(found.select("id"), "id", "left_semi").coalesce(1))


# Goals of tuning: the cost of (mean share of objects visited, mean recall, mean radius / exact mean radius); least wins.
def min_recall(least: float = 0.9):
    return lambda visited, recall, radius: visited if recall >= least else 1.0 + least - recall


def opt_radius(tolerance: float = 0.1):
    """Radii within one tolerance count alike; of those the cheaper wins."""
    return lambda visited, recall, radius: round(radius / tolerance) + visited


def pareto_recall():
    return lambda visited, recall, radius: visited**2 + (1.0 - recall) ** 2


def pareto_radius():
    return lambda visited, recall, radius: visited + radius


#: What a search is tuned over.
BEAMS = (4, 8, 16, 32)
DELTAS = (0.9, 1.0, 1.1)


def tune(queries: DataFrame, objects: DataFrame, edges: DataFrame, dist, k: int, goal=None, beams: tuple[int, ...] = BEAMS, deltas: tuple[float | None, ...] = DELTAS, **options) -> tuple[dict, list[dict]]:
    """The (beam, delta) of a grid that costs least on sample queries, and a report of all of them; goal is min_recall()
    or another of the goals above. All configurations search at once, as queries of their own."""
    goal = goal or min_recall()
    gold = cut(knn(queries, objects, dist, k))
    n = objects.count()
    exact = gold.groupBy("qid").agg(F.max("dist").alias("r")).agg(F.avg("r")).first()[0] or 1.0
    gold = cut(gold.select("qid", "id"))
    report = []
    for delta in deltas:
        grid = objects.sparkSession.createDataFrame([(i, b) for i, b in enumerate(beams)], "config int, beam int")
        numbered = cut(queries.select("qid", "v").crossJoin(F.broadcast(grid)).withColumn("own", F.monotonically_increasing_id()))
        widths = numbered.select(F.col("own").alias("qid"), F.greatest("beam", F.lit(k)).alias("width"))
        looked = visits(numbered.select(F.col("own").alias("qid"), "v"), objects, edges, dist, k, beam=widths, delta=delta, **options)
        looked = cut(looked.withColumnRenamed("qid", "own").join(numbered.select("own", "qid", "config"), "own"))
        share = {r["config"]: r["n"] / n for r in looked.groupBy("config", "qid").count().groupBy("config").agg(F.avg("count").alias("n")).collect()}
        order = Window.partitionBy("config", "qid").orderBy("dist", "id")
        found = cut(looked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("config", "qid", "id", "dist"))
        radius = {r["config"]: r["r"] / exact for r in found.groupBy("config", "qid").agg(F.max("dist").alias("r")).groupBy("config").agg(F.avg("r").alias("r")).collect()}
        wanted = gold.crossJoin(F.broadcast(grid.select("config")))
        hit = wanted.join(found.select("config", "qid", "id", F.lit(1).alias("hit")), ["config", "qid", "id"], "left").groupBy("config", "qid").agg((F.count("hit") / F.count("*")).alias("r"))
        right = {r["config"]: r["r"] for r in hit.groupBy("config").agg(F.avg("r").alias("r")).collect()}
        for i, beam in enumerate(beams):
            report.append({"beam": beam, "delta": delta, "visited": share[i], "recall": right[i], "radius": radius[i], "cost": goal(share[i], right[i], radius[i])})
    best = min(report, key=lambda r: (r["cost"], r["beam"], r["delta"] or float("inf")))
    return {"beam": best["beam"], "delta": best["delta"]}, report
