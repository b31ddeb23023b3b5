"""N-gram Jaccard self join of documents: MinHash LSH forest, then exact verification.

A document is its set of word 5-grams (lower case, letters and digits; fewer words give one n-gram). Documents with equal
sets are one class. Each of TREES trees is a trie of signatures: a class's label there is its minima under DEPTH hash
functions. Classes alone under their prefixes of the least depth drop out; a node of that depth with several is a
bucket. Inside, pairs are taken from the longest common prefixes up (over all trees), and a class's prefixes are
shortened until its predicted recall reaches the target: each of its verified links counts for the chance of finding
one as similar at that depth, and one unseen link at the similarity bound is always supposed. The least depth is that
at which a class without any link reaches the target.

Candidates are verified by exact set intersection in blocks: a bucket of many classes is split by hash into blocks of
bounded numbers of classes and n-grams, and pairs of blocks are tasks of bounded size, so no bucket meets in one task
and no pair becomes a row. Buckets with the same members are one. A pair is counted in the first tree where it shares a
prefix, hence once. A block pair gives each class's number of links and a spanning forest of its links; forests are
joined to connected groups by star contraction on the cluster.

A crowded bucket's classes are first compared with one set, the n-grams that most of them have. Jaccard distance is a
metric, so classes within half the distance bound of that set (a ball) are all linked with each other: their links are
counted without pairs, and blocks of one ball don't meet.

Cases: null and empty texts have no n-gram and link with nothing; ties and repeated rows are documents with equal sets,
which link with each other; null doc_id is a document like others, last to name a group; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hot_join, maybe_in, partitions, quoted, sliced, text_key

WORDS = 5
SIMILARITY = 0.8
TREES = 24
DEPTH = 8
RECALL = 0.9999
#: Classes of a block, and n-grams on average.
BLOCK = 512
BLOCK_GRAMS = 2_000_000
#: A bucket of more classes looks for a ball.
CROWDED = 2 * BLOCK
SEED = 17
WORD = re.compile(r"[^\W_]+")
#: Entries of a worker's table of word hashes; it is emptied when full.
CACHED_WORDS = 50_000


class WordHash(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


_HASHES = WordHash()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word n-grams."""
    found = WORD.findall((text or "").lower())
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - words + 1)
    mixed = np.full(n, len(h) if len(h) < words else 0, np.uint64)
    for i in range(min(words, len(h))):
        mixed = (mixed ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def chance(similarity: np.ndarray | float, depth: int, trees: int) -> np.ndarray | float:
    """The probability that two sets share a prefix of that depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def floor_depth(similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix that finds a link at the bound with the target recall: no prefix need be shorter."""
    return next((d for d in range(depth, 1, -1) if chance(similarity, d, trees) >= recall), 1)


@lru_cache(maxsize=8)
def hashing(trees: int, depth: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of each tree's hash functions low to high of depth."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(1, 2**63, size=(trees, depth), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, size=(trees, depth), dtype=np.uint64)
    return a[:, low:high].reshape(-1, 1).copy(), b[:, low:high].reshape(-1, 1).copy()


def minima(grams: np.ndarray, trees: int, depth: int, low: int, high: int) -> np.ndarray:
    """(trees, high - low): each tree's minima under its hash functions low to high of depth."""
    a, b = hashing(trees, depth, low, high)
    least = np.full(len(a), np.uint64(2**64 - 1))
    for at in range(0, len(grams), 512):
        part = grams[at : at + 512]
        mixed = part[None, :] * a
        mixed += b
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, mixed.min(1), out=least)
    return least.reshape(trees, high - low)


def prefixes(grams: np.ndarray, trees: int, depth: int, floor: int) -> np.ndarray:
    """A 64-bit label of each tree's prefix of the least depth."""
    label = np.zeros(trees, np.uint64)
    for i, own in enumerate(minima(grams, trees, depth, 0, floor).T):
        label = (label ^ own) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i)
        label ^= label >> np.uint64(31)
    return label.view(np.int64)


def further(grams: np.ndarray, trees: int, depth: int, floor: int) -> np.ndarray:
    """(trees, depth - floor): 16 bits of each minimum beyond the least depth, by which a bucket's trie branches."""
    return (minima(grams, trees, depth, floor, depth) >> np.uint64(48)).astype(np.uint16)


def signatures(docs: DataFrame, words: int, trees: int, depth: int, floor: int) -> DataFrame:
    """(doc_id, row_key, set_key, n, labels): row_key is equal for equal ids and texts, set_key null without n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in sliced(batches, 256):
            keys, sizes, labels = [], [], []
            for text in part.column(2).to_pylist():
                grams = shingles(text, words)
                sizes.append(len(grams))
                keys.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                labels.append(prefixes(grams, trees, depth, floor).tobytes() if len(grams) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(labels, pa.binary())], names=["doc_id", "row_key", "set_key", "n", "labels"])

    return keyed(docs).mapInArrow(run, "doc_id long, row_key binary, set_key binary, n int, labels binary")


def keyed(docs: DataFrame) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.select("doc_id", text_key("doc_id", "text").alias("row_key"), "text")


def gram_sets(docs: DataFrame, wanted: DataFrame, words: int, trees: int, depth: int, floor: int) -> DataFrame:
    """wanted (one row a class, with the row_key of one of its documents) with grams and deep, read again from the texts.

    A filter of fixed size keeps most other texts out of the shuffle. Copies of a text have row keys of their own, so
    that they don't meet.
    """
    near = maybe_in(keyed(docs).select("row_key", "text"), wanted, "row_key").where("_maybe").select("row_key", "text")
    texts = near.join(wanted.select("row_key"), "row_key", "left_semi").dropDuplicates(["row_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 64):
            sets = [shingles(t, words) for t in part.column(1).to_pylist()]
            deep = [further(g, trees, depth, floor).tobytes() for g in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g.tobytes() for g in sets], pa.binary()), pa.array(deep, pa.binary())], names=["row_key", "grams", "deep"])

    return texts.mapInArrow(run, "row_key binary, grams binary, deep binary").join(wanted, "row_key").drop("row_key")


def exploded(classes: DataFrame) -> DataFrame:
    """(tree, label, class, n): a row for each class and tree; n is its number of n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
            if not labels:
                continue
            trees = len(labels[0])
            own, n = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), trees) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(trees, dtype=np.int32), len(labels))), pa.array(np.concatenate(labels)), pa.array(own), pa.array(n)], names=["tree", "label", "class", "n"])

    return classes.select("class", "n", "labels").mapInArrow(run, "tree int, label long, class long, n int")


class Block:
    """Some classes of a bucket: sets, labels (classes x trees), deep (classes x trees x further levels) and balls."""

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray, deep: np.ndarray, balls: np.ndarray, floor: int):
        self.sets, self.labels, self.deep, self.balls, self.floor = sets, labels, deep, balls, floor
        self.sizes = np.array([len(s) for s in sets])

    def candidates(self, trees: np.ndarray, rows: np.ndarray, columns: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (of rows, of columns) whose first common tree is one of `trees`, of sizes that may be so similar, and
        not in one ball."""
        first = np.full((len(rows), len(columns)), 10**6, np.int32)
        for t in range(self.labels.shape[1] - 1, -1, -1):
            first[self.labels[rows, t][:, None] == self.labels[columns, t][None, :]] = t
        a, b = self.sizes[rows][:, None], self.sizes[columns][None, :]
        # J = o / (a + b - o) >= s holds just where o (1 + s) >= s (a + b)
        wanted = np.isin(first, trees) & (np.minimum(a, b) * (1 + similarity) >= similarity * (a + b) - 1e-9)
        ball = self.balls[rows][:, None]
        wanted &= (ball == 0) | (ball != self.balls[columns][None, :])
        i, j = np.nonzero(wanted)
        return rows[i], columns[j]

    def depths(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Each pair's longest common prefix over all trees."""
        found = np.zeros(len(i), np.int64)
        for at in range(0, len(i), 1 << 14):
            p, q = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            run = np.logical_and.accumulate(self.deep[p] == self.deep[q], axis=2).sum(2)
            found[at : at + (1 << 14)] = np.where(self.labels[p] == self.labels[q], self.floor + run, 0).max(1)
        return found

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Sizes of the pairs' intersections."""
        if len(i) <= 64:
            return np.array([len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True)) for x, y in zip(i, j)], np.int64)
        (left, p), (right, q) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
        return overlaps([self.sets[x] for x in left], [self.sets[y] for y in right])[p, q]

    def links(self, i: np.ndarray, j: np.ndarray, similarity: float, recall: float) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that reach the similarity. Prefixes get shorter, and a class takes part as long as its predicted
        recall is below the target."""
        trees, depth = self.labels.shape[1], self.floor + self.deep.shape[2]
        found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        common = self.depths(i, j)
        short = np.ones(len(self.sets), bool)
        for d in range(depth, self.floor - 1, -1):
            at = np.flatnonzero((common == d) & (short[i] | short[j]))
            shared = self.shared(i[at], j[at])
            whole = self.sizes[i[at]] + self.sizes[j[at]]
            good = shared * (1 + similarity) >= similarity * whole - 1e-9
            own = i[at][good], j[at][good], shared[good] / (whole[good] - shared[good])
            found = tuple(np.concatenate(x) for x in zip(found, own))
            expected = 1 / chance(found[2], d, trees)
            n = np.bincount(found[0], minlength=len(short)) + np.bincount(found[1], minlength=len(short))
            all_of = np.bincount(found[0], expected, len(short)) + np.bincount(found[1], expected, len(short))
            short = (n + chance(similarity, d, trees)) / (all_of + 1) < recall
        return found[0], found[1]


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the n-grams that both sides have, tile by tile."""
    x, y = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(x, y)
    found = np.zeros((len(left), len(right)), np.float32)
    if not len(both):
        return found.astype(np.int64)

    def places(whole: np.ndarray, own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(both, whole)
        hit = both[np.minimum(at, len(both) - 1)] == whole
        row = np.repeat(np.arange(len(own)), [len(o) for o in own])[hit]
        at = at[hit]
        order = np.argsort(at, kind="stable")
        return row[order], at[order]

    (rx, ax), (ry, ay) = places(x, left), places(y, right)
    for low in range(0, len(both), width):
        high = min(low + width, len(both))
        a, b = np.zeros((len(left), high - low), np.float32), np.zeros((len(right), high - low), np.float32)
        for row, at, m in ((rx, ax, a), (ry, ay, b)):
            s, e = np.searchsorted(at, (low, high))
            m[row[s:e], at[s:e] - low] = 1
        found += a @ b.T
    return found.astype(np.int64)


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between classes a[i] and b[i]."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def verified(members: DataFrame, similarity: float, recall: float, trees: int, floor: int) -> DataFrame:
    """(a, b, links): links of class a where b is null, an edge of a forest where links is null.

    members: bucket, one, two (a pair of blocks, one <= two), side, class, copies, trees, ball, labels, deep, grams.
    """

    def check(rows: list[tuple]) -> list[tuple]:
        side, ids, copies = (np.array([r[i] for r in rows]) for i in range(3))
        labels = np.stack([np.frombuffer(r[5], np.int64) for r in rows])
        deep = np.stack([np.frombuffer(r[6], np.uint16).reshape(trees, -1) for r in rows])
        block = Block([np.frombuffer(r[7], np.uint64) for r in rows], labels, deep, np.array([r[4] or 0 for r in rows]), floor)
        inner = (side == 2).all()
        left = np.arange(len(rows)) if inner else np.flatnonzero(side == 0)
        right = left if inner else np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return []
        i, j = block.candidates(np.frombuffer(rows[0][3], np.int32), left, right, similarity)
        if inner:
            i, j = i[i < j], j[i < j]
        if len(i):
            i, j = block.links(i, j, similarity, recall)
        if not len(i):
            return []
        links = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
        out = [(int(ids[x]), None, int(links[x])) for x in np.flatnonzero(links)]
        return out + [(int(p), int(q), None) for p, q in forest(ids[i], ids[j])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["a", "b", "links"])

        for batch in sliced(batches, BLOCK):
            for key, *row in zip(zip(*(c.to_pylist() for c in batch.columns[:3])), *(c.to_pylist() for c in batch.columns[3:])):
                if key != now:
                    if len(rows) > 1:
                        out += check(rows)
                    now, rows = key, []
                rows.append(tuple(row))
            if len(out) > 5000:
                yield table()
                out.clear()
        if len(rows) > 1:
            out += check(rows)
        yield table()

    return members.select("bucket", "one", "two", "side", "class", "copies", "trees", "ball", "labels", "deep", "grams").mapInArrow(run, "a long, b long, links long")


def balls(crowd: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """(class, ball): classes of which any two in one ball have the similarity.

    crowd: bucket, class, grams; sizes: bucket, size. A bucket's center has the n-grams of more than half its classes,
    and a ball the classes within half the distance bound of an equal center. A class in several takes the largest.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[int, list[np.ndarray]] = {}
            for bucket, grams in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(bucket, []).append(np.frombuffer(grams, np.int64))
            for bucket, sets in by.items():
                gram, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), bucket, np.int64)), pa.array(gram), pa.array(n)], names=["bucket", "gram", "n"])

    counted = crowd.select("bucket", "grams").mapInArrow(count, "bucket long, gram long, n long").groupBy("bucket", "gram").agg(F.sum("n").alias("n"))
    most = counted.join(sizes, "bucket").where(F.col("n") * 2 > F.col("size"))
    # a center has at most twice the n-grams that its classes have on average
    centers = most.groupBy("bucket").agg(F.sort_array(F.collect_list("gram")).alias("center"), F.first("size").alias("size"))
    centers = cut(centers.withColumn("ball", F.xxhash64("center")))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, grams, center, ball in zip(*(c.to_pylist() for c in batch.columns)):
                one, two = np.frombuffer(grams, np.uint64), np.array(center, np.int64).view(np.uint64)
                shared = len(np.intersect1d(one, two, assume_unique=True))
                # distance to the center at most (1 - s) / 2, that is similarity (1 + s) / 2
                if shared * (3 + similarity) >= (1 + similarity) * (len(one) + len(two)) + 1e-9:
                    rows.append((own, ball))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(2)], names=["class", "ball"])

    inside = hot_join(crowd, centers, ["bucket"], "size").select("class", "grams", "center", "ball").mapInArrow(near, "class long, ball long").distinct()
    inside = cut(inside)
    largest = inside.groupBy("ball").agg(F.count("*").alias("n"))
    chosen = hot_join(inside, cut(largest), ["ball"]).groupBy("class").agg(F.max(F.struct("n", "ball"))["ball"].alias("ball"))
    return cut(chosen)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected group, by alternating star contraction (large, then small stars).

    Every step takes minima per node by partial aggregation; no neighbourhood is collected. Edges are cut from their
    lineage each round.
    """
    def halves(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        # large star: a node's greater neighbours go to the least node around it
        both = halves(edges)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the least of those
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b")))
        edges = cut(small.distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if before == now:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def in_parts(placed: DataFrame) -> DataFrame:
    """(bucket, class, trees, ball, own, from, all): each ball in a bucket, and what is in none, is a part with `own` blocks
    of the bucket's `all`, from number `from` on."""
    parts = placed.groupBy("bucket", "ball").agg(F.count("*").alias("n"), F.first("blocks").alias("blocks"), F.first("size").alias("size"))
    before = Window.partitionBy("bucket").orderBy(F.col("ball").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("own", F.ceil(F.col("n") * F.col("blocks") / F.col("size")).cast("int"))
    parts = parts.withColumn("from", F.coalesce(F.sum("own").over(before), F.lit(0)).cast("int")).withColumn("all", F.sum("own").over(Window.partitionBy("bucket")).cast("int"))
    parts = cut(parts.select("bucket", F.coalesce("ball", F.lit(0)).alias("part"), "n", "own", "from", "all"))
    placed = placed.select("bucket", "class", "trees", "ball", F.coalesce("ball", F.lit(0)).alias("part"))
    return hot_join(placed, parts, ["bucket", "part"]).drop("part", "n")


def join(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """(doc_id, row_key, class_id, group_id, group, n_links) of every document.

    class_id names its class (documents with an equal set of n-grams) and group_id its connected group: the least doc_id
    there. group is a number of the group, null without n-grams. n_links counts the other documents at the similarity
    or above.
    """
    spark = docs.sparkSession
    floor = floor_depth(similarity, trees, depth, recall)
    signed = cut(signatures(docs, words, trees, depth, floor))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))
    classes = signed.where("set_key is not null").groupBy("set_key").agg(F.count("*").alias("copies"), first.alias("first"), F.first("n").alias("n"), F.first("labels").alias("labels"))
    classes = classes.select("set_key", "copies", "n", "labels", F.col("first.doc_id").alias("class_id"), F.col("first.row_key").alias("row_key"))
    classes = cut(classes.withColumn("class", F.monotonically_increasing_id()))
    leaves = exploded(classes)
    mark = F.xxhash64("class")
    counted = leaves.groupBy("tree", "label").agg(F.count("*").alias("size"), F.sum(F.col("n").cast("long")).alias("grams"), F.sum(mark.cast("decimal(20,0)")).alias("sum"), F.bit_xor(mark).alias("xor"), F.min("class").alias("low")).where("size > 1")
    # buckets of several trees with the same members are one bucket with several trees
    same = counted.groupBy("size", "grams", "sum", "xor", "low").agg(F.sort_array(F.collect_set("tree")).alias("trees"), F.min(F.struct("tree", "label")).alias("of"))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("grams") / BLOCK_GRAMS)).cast("int")
    buckets = cut(same.select(F.monotonically_increasing_id().alias("bucket"), F.col("of.tree").alias("tree"), F.col("of.label").alias("label"), "size", "grams", "trees", blocks.alias("blocks")))
    inside = cut(hot_join(leaves.drop("n"), buckets.drop("grams"), ["tree", "label"], "size").select("bucket", "class", "trees", "size", "blocks"))
    wanted = inside.select("class").distinct().join(classes.select("class", "row_key", "copies", "labels"), "class")
    sets = cut(gram_sets(docs, cut(wanted), words, trees, depth, floor))

    crowded = buckets.where(F.col("size") > CROWDED).select("bucket", "size")
    if crowded.limit(1).count():
        crowd = inside.where(F.col("size") > CROWDED).select("bucket", "class").join(sets.select("class", "grams"), "class")
        ball = balls(crowd, crowded, similarity)
        dealt = in_parts(inside.join(ball, "class", "left"))
    else:
        # no list of Python rows: executors would start a second set of Python workers for it
        ball = spark.range(0).select(F.col("id").alias("class"), F.col("id").alias("ball"))
        dealt = inside.select("bucket", "class", "trees", F.lit(None).cast("long").alias("ball"), F.col("blocks").alias("own"), F.lit(0).alias("from"), F.col("blocks").alias("all"))
    dealt = dealt.withColumn("block", F.col("from") + F.pmod(F.xxhash64("class", F.lit(3)), F.col("own")).cast("int"))
    # a class of block x meets every block y: the pairs (min, max), on the side of its own block
    others = F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda y: F.col("ball").isNull() | (y < F.col("from")) | (y >= F.col("from") + F.col("own")))
    pairs = F.transform(others, lambda y: F.struct(F.least("block", y).alias("one"), F.greatest("block", y).alias("two"), F.when(F.col("block") == y, 2).when(F.col("block") < y, 0).otherwise(1).alias("side")))
    members = dealt.select("bucket", "class", "ball", _packed("trees").alias("trees"), F.explode(pairs).alias("p")).select("bucket", "p.*", "class", "ball", "trees").join(sets, "class")
    dealt = members.repartition(partitions(spark), "bucket", "one", "two").sortWithinPartitions("bucket", "one", "two")
    checked = cut(verified(dealt, similarity, recall, trees, floor))

    edges, links = checked.where("b is not null").select("a", "b"), checked.where("links is not null").select("a", "links")
    balled = ball.join(classes.select("class", "copies"), "class")
    whole = cut(balled.groupBy("ball").agg(F.sum("copies").alias("n"), F.min("class").alias("low")))
    balled = hot_join(balled, whole, ["ball"])
    edges = edges.union(balled.select("class", "low"))
    links = links.union(balled.select("class", F.col("n") - F.col("copies"))).groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    roots = components(edges)
    named = classes.select("class", "set_key", "copies", "class_id").join(links, "class", "left").join(roots, F.col("class") == F.col("node"), "left")
    named = named.withColumn("root", F.coalesce("root", "class"))
    groups = named.groupBy("root").agg(F.min("class_id").alias("group_id"))
    named = named.join(groups, "root").select("set_key", "copies", "class_id", "group_id", F.col("root").alias("group"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    found = hot_join(signed.select("doc_id", "row_key", "set_key"), cut(named), ["set_key"], "copies", "left")
    lone = F.col("set_key").isNull()
    return found.select("doc_id", "row_key", F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(lone, F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"), "group", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _packed(name: str):
    """An array of ints as little-endian bytes."""
    return F.unhex(F.array_join(F.transform(name, lambda t: F.lpad(F.hex(t * F.lit(1 << 24)), 8, "0")), ""))


def representatives(docs: DataFrame, **options) -> DataFrame:
    """docs, whatever their columns' names, with one document of each group: the first by doc_id (null last), then by
    text. Documents without n-grams all stay. Rows with equal doc_id and text are copies of each other.

    Only rows that may be in a group of several are shuffled."""
    found = join(docs.select("doc_id", "text"), **options).where("n_links > 0")
    found = cut(found.select("group", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key").alias("own")))
    best = found.groupBy("group").agg(F.min("own").alias("own")).select("own.row_key", F.lit(True).alias("best"))
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("_id"), "text")
    rows = maybe_in(rows.select("row", text_key(F.col("_id"), F.col("text")).alias("row_key")), found.select("own.row_key"), "row_key")
    several = found.select("own.row_key").distinct().join(best, "row_key", "left")
    some = rows.where("_maybe").join(several.select("row_key", F.coalesce("best", F.lit(False)).alias("best")), "row_key", "left")
    first = some.where("best").groupBy("row_key").agg(F.first("row").alias("row"))
    return rows.where("not _maybe").select("row.*").unionByName(some.where("best is null").select("row.*")).unionByName(first.select("row.*"))
