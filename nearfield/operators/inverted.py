"""Inverted files over sets and sparse vectors, and the set algebra of posting lists. Joins and counts on tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.distances import DOT
from .kernels import HELD, HITS, _grid, cut, hits
from .search import ranked

#: Up to so many places, sparse vectors are filled up for a product with dense ones.
FILLED = 4096

#: A tokenizer: from the column of an object to the array of its tokens.
Tokens = Callable[[Column], Column]


def tokens_of(objects: DataFrame) -> Column:
    """The distinct tokens of s, of any type; null is none, and so is 0 among numbers, which is a sentinel there."""
    own = F.array_distinct("s")
    if isinstance(objects.schema["s"].dataType.elementType, NumericType):
        return F.filter(own, lambda t: t.isNotNull() & (t != 0))
    return F.filter(own, lambda t: t.isNotNull())


def tokenised(objects: DataFrame, tokens: Tokens | None) -> DataFrame:
    """objects with s replaced by what a tokenizer makes of it, if there is one (shingles, say)."""
    return objects if tokens is None else objects.withColumn("s", tokens(F.col("s")))


def postings(objects: DataFrame, tokens: Tokens | None = None) -> DataFrame:
    """(token, id), repeated tokens once."""
    objects = tokenised(objects, tokens)
    return objects.select(F.explode(tokens_of(objects)).alias("token"), "id")


def overlap(queries: DataFrame, objects: DataFrame, t: int = 1, tokens: Tokens | None = None, match: tuple[Column, ...] = ()) -> DataFrame:
    """(qid, id, i, m, n) of objects that share at least t tokens: shared, query's and object's sizes. tokens makes
    an object's tokens, for a distance that needs others than its elements; match are further aggregates of a pair's
    shared tokens (column token), with names of their own."""
    queries, objects = tokenised(queries, tokens), tokenised(objects, tokens)
    q = postings(queries.select(F.col("qid").alias("id"), "s")).withColumnRenamed("id", "qid")
    shared = q.join(postings(objects), "token").groupBy("qid", "id").agg(F.count("*").alias("i"), *match).where(F.col("i") >= t)
    sizes = lambda df, key, name: df.select(key, F.size(tokens_of(df)).alias(name))
    return shared.join(sizes(queries, "qid", "m"), "qid").join(sizes(objects, "id", "n"), "id")


def search(queries: DataFrame, objects: DataFrame, dist, k: int, t: int = 1, tokens: Tokens | None = None) -> DataFrame:
    """k nearest among objects with t shared tokens, scored from counts alone."""
    scored = overlap(queries, objects, t, tokens).select("qid", "id", dist.counts(F.col("i"), F.col("m"), F.col("n")).alias("dist"))
    return ranked(scored, k)


def threshold(queries: DataFrame, objects: DataFrame, t: int | None = None, match: tuple[Column, ...] = ()) -> DataFrame:
    """(qid, id, n): ids in at least t of the query's posting lists; t=1 is the union, None the intersection of all. match
    are further aggregates of the merge."""
    both = overlap(queries, objects, match=match)
    least = F.col("m") if t is None else F.lit(t)
    return both.where(F.col("i") >= least).select("qid", "id", F.col("i").alias("n"), *[c for c in both.columns if c not in ("qid", "id", "i", "m", "n")])


def first_at_least(array, x):
    """1-based position of the first element >= x of a sorted array; size + 1 if none."""
    return F.lit(1) + F.size(F.filter(array, lambda y: y < x))


# Sparse vectors in long form: (id, term, w).
def sparse_norms(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def sparse_dot(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(qid, id, dot) of the pairs that share a term."""
    q = queries.select(F.col("id").alias("qid"), "term", F.col("w").alias("qw"))
    return q.join(vectors, "term").groupBy("qid", "id").agg(F.sum(F.col("qw") * F.col("w")).alias("dot"))


def sparse_cosine(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """k nearest by 1 - cosine among vectors that share a term."""
    return sparse_search(queries, vectors, "cosine", k)


#: The most frequent terms, whose products are those of dense matrices; their numbers are 0 to OWN - 1.
OWN = 768
#: Queries and vectors of a tile.
SPARSE_TILE = (512, 2048)


class Rows:
    """Sparse vectors one after the other: ids, sizes, and each entry's term and weight."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, w: np.ndarray):
        self.ids, self.sizes, self.terms, self.w = ids, sizes, terms, w
        self.ends = np.cumsum(sizes)
        self.row = np.repeat(np.arange(len(ids)), sizes)
        self.norm = np.sqrt(np.bincount(self.row, w * w, len(ids)))

    def tile(self, start: int, stop: int, scaled: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Some of the vectors, to unit length if scaled: a matrix of the frequent terms, and the terms, rows and weights of
        the others by term."""
        stop = min(stop, len(self.ids))
        a, b = self.ends[start] - self.sizes[start], self.ends[stop - 1]
        terms, row = self.terms[a:b], self.row[a:b] - start
        w = self.w[a:b] / self.norm[self.row[a:b]] if scaled else self.w[a:b]
        often = terms < OWN
        matrix = np.bincount(row[often] * OWN + terms[often], w[often], (stop - start) * OWN).astype(np.float32).reshape(-1, OWN)
        rare = np.flatnonzero(~often)
        rare = rare[np.argsort(terms[rare], kind="stable")]
        return matrix, terms[rare], row[rare], w[rare]


def products(q: tuple, x: tuple) -> np.ndarray:
    """Inner products of two tiles, in single precision."""
    out = q[0] @ x[0].T
    # each rare entry of x with those of its term in q
    left, right = np.searchsorted(q[1], x[1], "left"), np.searchsorted(q[1], x[1], "right")
    many = right - left
    live = np.flatnonzero(many)
    ends = np.cumsum(many[live])
    at = 0
    while at < len(live):  # about so many products at once
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), "right")))
        own, n = live[at:end], many[live[at:end]]
        entry = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left[own], n)
        place = q[2][entry] * out.shape[1] + np.repeat(x[2][own], n)
        out += np.bincount(place, q[3][entry] * np.repeat(x[3][own], n), out.size).astype(np.float32).reshape(out.shape)
        at = end
    return out


def sparse_distance(kind: str, dot: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """The distance from an inner product and the product of the norms."""
    if kind == "cosine":
        return 1.0 - dot / norms
    similarity = np.round(dot / norms if kind == "angle" else dot, 12)
    return 1.0 - similarity if kind == "normcosine" else np.arccos(np.clip(similarity, -1.0, 1.0))


def sparse_met(q: Rows, x: Rows, kind: str, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of q, id, distance) of each query's k nearest among the vectors that share a term. Products in single precision
    tell which pairs are computed in double."""
    scaled = kind in ("cosine", "angle")
    vocabulary = np.unique(q.terms)
    local = np.searchsorted(vocabulary, q.terms)
    q_keys = q.row * len(vocabulary) + local
    order = np.argsort(q_keys)
    q_keys, q_w = q_keys[order], q.w[order]
    place = np.searchsorted(vocabulary, x.terms)
    known = (place < len(vocabulary)) & (vocabulary[np.minimum(place, len(vocabulary) - 1)] == x.terms) if len(vocabulary) else np.zeros(len(x.terms), bool)
    starts = x.ends - x.sizes

    def exact(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        """(i, j, dot) of the pairs that share a term."""
        found: list[list[np.ndarray]] = [[], [], []]
        at = 0
        whole = np.cumsum(x.sizes[j])
        while at < len(i):  # about so many terms at once
            end = max(at + 1, int(np.searchsorted(whole, (whole[at - 1] if at else 0) + (1 << 20), "right")))
            a, b = i[at:end], j[at:end]
            pair = np.repeat(np.arange(len(a)), x.sizes[b])
            entry = np.arange(len(pair)) - np.repeat(np.cumsum(x.sizes[b]) - x.sizes[b], x.sizes[b]) + starts[b][pair]
            live = known[entry]
            pair, entry = pair[live], entry[live]
            keys = a[pair] * len(vocabulary) + place[entry]
            to = np.minimum(np.searchsorted(q_keys, keys), len(q_keys) - 1)
            hit = q_keys[to] == keys
            pair, products = pair[hit], q_w[to[hit]] * x.w[entry[hit]]
            shared = np.bincount(pair, minlength=len(a)) > 0
            dot = np.bincount(pair, products, len(a))
            for held, c in zip(found, (a[shared], b[shared], dot[shared])):
                held.append(c)
            at = end
        return tuple(np.concatenate(c) if c else np.zeros(0) for c in found)

    tiles = [(at, q.tile(at, at + SPARSE_TILE[0], scaled)) for at in range(0, len(q.ids), SPARSE_TILE[0])]
    # what a query has: its row, an id, a distance, a similarity; and the similarity that a pair must have to matter
    best = {at: (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)) for at, _ in tiles}
    least = np.zeros(len(q.ids))

    def settle(at: int, n: int, i: np.ndarray, j: np.ndarray) -> None:
        i, j, dot = exact(i + at, j)
        i, j = i.astype(np.int64), j.astype(np.int64)
        norms = q.norm[i] * x.norm[j]
        new = (i - at, x.ids[j], sparse_distance(kind, dot, norms), dot / norms if scaled else dot)
        row, ids, d, similarity = (np.concatenate(c) for c in zip(best[at], new))
        order = np.lexsort((ids, d, row))
        row, ids, d, similarity = row[order], ids[order], d[order], similarity[order]
        first = np.searchsorted(row, np.arange(n + 1))
        keep = np.arange(len(row)) - first[row] < k
        row, ids, d, similarity = row[keep], ids[keep], d[keep], similarity[keep]
        best[at] = row, ids, d, similarity
        lowest = np.full(n, np.inf)
        np.minimum.at(lowest, row, similarity)
        least[at : at + n] = np.where(np.bincount(row, minlength=n) >= k, lowest - 1e-9, 0.0)

    for start in range(0, len(x.ids), SPARSE_TILE[1]):
        own = x.tile(start, start + SPARSE_TILE[1], scaled)
        for at, tile in tiles:
            n = len(tile[0])
            near = products(tile, own)
            # a sum of positive terms: its error is relative; a product above 0 may have become 0
            slack = 4 * (OWN + 64) * float(np.finfo(np.float32).eps)
            low = least[at : at + n]
            if (low == 0).any() and near.shape[1] > k:
                kth = -np.partition(-near, k - 1, axis=1)[:, k - 1]
                low = np.maximum(low, kth * (1 - slack) - 1e-9)
            i, j = np.nonzero((near > 0) & (near >= (low * (1 - slack))[:, None].astype(np.float32)))
            if len(i):
                settle(at, n, i, j + start)
    for at, _ in tiles:
        row, ids, d, _ = best[at]
        yield row + at, ids, d


def sparse_search(queries: DataFrame, vectors: DataFrame, kind: str, k: int) -> DataFrame:
    """k nearest among vectors that share a term, weights being at least 0: cosine and angle of any, normcosine and
    normangle of unit vectors. Similarities, but of cosine, are rounded to 12 digits, so that equal vectors tie whatever
    the order of their sums.

    Vectors meet in the cells of kernels.py: no list of the pairs that share a term is made."""
    if kind not in ("cosine", "normcosine", "angle", "normangle"):
        raise ValueError(f"unknown kind {kind}")
    spark = vectors.sparkSession
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # numbers stand for terms, the least for the most frequent
    counted = cut(vectors.select("term").unionByName(queries.select("term")).groupBy("term").agg(F.count("*").alias("df")).withColumn("number", F.monotonically_increasing_id()))
    top = counted.orderBy(F.desc("df"), "number").limit(OWN)
    top = top.select("number", (F.row_number().over(Window.orderBy(F.desc("df"), "number")) - 1).cast("long").alias("place"))
    numbered = cut(counted.join(F.broadcast(top), "number", "left").select("term", F.coalesce("place", F.col("number") + OWN).alias("number")))

    def lists(df: DataFrame) -> DataFrame:
        entry = F.struct("number", F.col("w").cast("double").alias("w"))
        rows = df.join(numbered, "term").groupBy(F.col("id").cast("long").alias("id")).agg(F.collect_list(entry).alias("e"))
        return cut(rows.select("id", F.col("e.number").alias("terms"), F.col("e.w").alias("w")))

    q, o = lists(queries), lists(vectors)
    n = q.count()
    sizes = o.agg(F.count("*").alias("m"), F.sum(F.size("terms")).alias("entries")).first()
    m, entries = sizes["m"], sizes["entries"] or 1
    gq, go = _grid(float(n), float(m), min(max(1.0, n * m / (1 << 22)), float(slots)), max(1, 2 * HELD // (16 * max(1, entries // max(m, 1)))))
    row, place = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(gq)), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(go))
    q = q.withColumn("cell", F.explode(F.sequence(row * go, row * go + go - 1)))
    o = o.withColumn("cell", F.explode(F.sequence(place, place + (gq - 1) * go, F.lit(go).cast("long"))))
    columns = ["id", "terms", "w"]
    dealt = q.select("cell", F.lit(0).alias("side"), *columns).unionByName(o.select("cell", F.lit(1).alias("side"), *columns)).repartitionById(gq * go, F.col("cell").cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        for batch in batches:
            side, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for s in (0, 1):
                at = pa.array(np.flatnonzero(side == s))
                if len(at):
                    own = [batch.column(i).take(at) for i in (2, 3)]
                    held[s].append((ids[side == s], own[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), *(c.flatten().to_numpy(zero_copy_only=False) for c in own)))
        if held[0] and held[1]:
            one, two = (Rows(*(np.concatenate(c) for c in zip(*h))) for h in held)
            for i, found, d in sparse_met(one, two, kind, k):
                yield pa.RecordBatch.from_arrays([pa.array(one.ids[i]), pa.array(found), pa.array(d)], names=["qid", "id", "dist"])

    return ranked(dealt.select("side", *columns).mapInArrow(run, HITS), k)


def append(postings_: DataFrame, objects: DataFrame) -> DataFrame:
    """Postings (token, id) with those of the objects that aren't in them yet."""
    new = objects.join(postings_.select("id").distinct(), "id", "left_anti")
    return postings_.unionByName(postings(new))


def centroids(vectors: DataFrame, by: str) -> DataFrame:
    """(by, term, w, unit): the sum of the vectors of each group, and scaled to unit length."""
    total = vectors.groupBy(by, "term").agg(F.sum("w").alias("w"))
    length = total.groupBy(by).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    same = F.col(f"t.{by}").eqNullSafe(F.col(f"l.{by}"))
    return total.alias("t").join(length.alias("l"), same).select(f"t.{by}", "term", "w", F.when(F.col("length") > 0, F.col("w") / F.col("length")).alias("unit"))


def normalised(vectors: DataFrame) -> DataFrame:
    """Sparse vectors scaled to unit length; those without a positive norm go."""
    return vectors.join(sparse_norms(vectors), "id").where("norm > 0").select("id", "term", (F.col("w") / F.col("norm")).alias("w"))


def sparse_dense_dot(vectors: DataFrame, dense: DataFrame) -> DataFrame:
    """(qid, id, dot) of every dense vector (qid, v) with every sparse one that has a term in it; a term is a 0-based place
    in v. Sparse vectors are filled up and meet the dense ones in cells: no row is made for a term of a pair."""
    sizes = dense.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("dim")).first()
    dim = sizes["dim"] or 0
    if sizes["least"] != sizes["dim"] or dim > FILLED:
        own = dense.select("qid", F.posexplode("v").alias("term", "qw"))
        return own.join(vectors, "term").groupBy("qid", "id").agg(F.sum(F.col("qw").cast("double") * F.col("w")).alias("dot"))
    entries = vectors.where((F.col("term") >= 0) & (F.col("term") < dim)).groupBy("id", F.col("term").cast("int").alias("term")).agg(F.sum("w").cast("double").alias("w"))
    entries = entries.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    found = hits(dense.select("qid", "v"), entries.select("id", filled.alias("v")), DOT, None)
    return found.select("qid", "id", (-F.col("dist")).alias("dot"))
