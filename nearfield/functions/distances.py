"""Distances as Catalyst expressions, with numpy block kernels for dense vectors.

Kinds are mathematics: only a metric lets a planner prune by the triangle inequality. All arithmetic is in double.
Null or ragged vectors give a null distance; the operators reject them at the boundary.
"""

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Builder = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Product:
    """A product of matrices left(q) @ right(x).T that grows with a distance, along each row; level(bound, q) turns each
    row's bound on the distance into that scale. If shifts, vectors may be moved all alike beforehand. If clipped, products
    up to -1 are one distance, and those from 1 on."""

    left: Callable[[np.ndarray], np.ndarray]
    right: Callable[[np.ndarray], np.ndarray]
    level: Callable[[np.ndarray, np.ndarray], np.ndarray]
    shifts: bool = False
    clipped: bool = False


@dataclass(frozen=True)
class Distance:
    """A distance: its kind (metric, semimetric, premetric), Column builder and, for vectors, a block kernel.

    Where a product of matrices gives a distance cheaply but not to its last digits, product is that and rows are the exact
    distances of single pairs. dtype is that of the kernel's vectors.
    """

    name: str
    kind: str
    column: Builder
    block: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
    product: Product | None = None
    rows: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
    dtype: str = "float64"

    def __call__(self, a: Column, b: Column) -> Column:
        return self.column(a, b)


def fold(a: Column, b: Column, term: Builder) -> Column:
    """Sum of term(x, y) over two arrays, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, t: s + t)


def dot(a: Column, b: Column) -> Column:
    return fold(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot32(a: Column, b: Column) -> Column:
    """The inner product with single-precision terms and sums."""
    terms = F.zip_with(a, b, lambda x, y: (x.cast("float") * y.cast("float")).cast("float"))
    return F.aggregate(terms, F.lit(0.0).cast("float"), lambda s, t: (s + t).cast("float"))


def norm32(a: Column) -> Column:
    return F.sqrt(dot32(a, a)).cast("float")


def sparse_dense_dot(places: Column, values: Column, dense: Column) -> Column:
    """The inner product of a sparse vector (0-based places, values) with an array."""
    return F.aggregate(F.zip_with(places, values, lambda i, x: x.cast("double") * F.get(dense, i).cast("double")), F.lit(0.0), lambda s, t: s + t)


def _clamped(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def cosine_of(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a norm is 0."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths)


def _sq(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared L2 by the direct formula, tile by tile, so that near ties keep their digits."""
    out = np.empty((len(q), len(x)))
    for i in range(0, len(q), 64):
        out[i : i + 64] = ((q[i : i + 64, None, :] - x[None]) ** 2).sum(-1)
    return out


def _own(q: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", q, q)


def _square(f: Callable[[np.ndarray], np.ndarray]) -> Product:
    """Squared L2 less the query's own square; f turns a bound into a squared one."""
    one = lambda q: np.ones((len(q), 1))
    return Product(lambda q: np.hstack([-2 * q, one(q)]), lambda x: np.hstack([x, _own(x)[:, None]]), lambda d, q: f(d) - _own(q), True)


def _rows_sq(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    d = q - x
    return np.einsum("ij,ij->i", d, d)


def _tiled(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def run(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(q), len(x)))
        for i in range(0, len(q), 64):
            out[i : i + 64] = f(np.abs(q[i : i + 64, None, :] - x[None]))
        return out

    return run


def _cos(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return (q @ x.T) / (np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None])


def _unit(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return x / np.sqrt(_own(x))[:, None]


def _rows_dot(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", q, x)


def _rows_cos(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return _rows_dot(q, x) / (np.sqrt(_own(q)) * np.sqrt(_own(x)))


def _angled(d: np.ndarray) -> np.ndarray:
    """The negative cosine of an angle; no bound beyond half a turn."""
    return np.where(d < np.pi, -np.cos(np.minimum(d, np.pi)), np.inf)


def _dots(f: Callable[[np.ndarray], np.ndarray], unit: bool = False) -> Product:
    """Negative inner products, of unit vectors if unit; f turns a bound into one."""
    own = _unit if unit else lambda q: q
    return Product(lambda q: -own(q), own, lambda d, q: f(d), clipped=f is _angled)


def lp(p: float) -> Distance:
    column = lambda a, b: F.pow(fold(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p)))), F.lit(1.0 / p))
    return Distance(f"lp{p:g}", "metric" if p >= 1 else "premetric", column, _tiled(lambda d: (d**p).sum(-1) ** (1.0 / p)))


L1 = Distance("l1", "metric", lambda a, b: fold(a, b, lambda x, y: F.abs(x - y)), _tiled(lambda d: d.sum(-1)))
SQL2 = Distance("sql2", "semimetric", lambda a, b: fold(a, b, lambda x, y: (x - y) * (x - y)), _sq, _square(lambda d: d), _rows_sq)
L2 = Distance("l2", "metric", lambda a, b: F.sqrt(SQL2.column(a, b)), lambda q, x: np.sqrt(_sq(q, x)), _square(lambda d: d * abs(d)), lambda q, x: np.sqrt(_rows_sq(q, x)))
LINF = Distance("linf", "metric", lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, t: F.greatest(s, t)), _tiled(lambda d: d.max(-1)))
LP3 = lp(3)
COSINE = Distance("cosine", "semimetric", lambda a, b: F.lit(1.0) - cosine_of(a, b), lambda q, x: 1 - _cos(q, x), _dots(lambda d: d - 1, True), lambda q, x: 1 - _rows_cos(q, x))
NORMCOSINE = Distance("normcosine", "semimetric", lambda a, b: F.lit(1.0) - dot(a, b), lambda q, x: 1 - q @ x.T, _dots(lambda d: d - 1), lambda q, x: 1 - _rows_dot(q, x))
ANGLE = Distance("angle", "metric", lambda a, b: F.acos(_clamped(cosine_of(a, b))), lambda q, x: np.arccos(np.clip(_cos(q, x), -1, 1)), _dots(_angled, True), lambda q, x: np.arccos(np.clip(_rows_cos(q, x), -1, 1)))
NORMANGLE = Distance("normangle", "metric", lambda a, b: F.acos(_clamped(dot(a, b))), lambda q, x: np.arccos(np.clip(q @ x.T, -1, 1)), _dots(_angled), lambda q, x: np.arccos(np.clip(_rows_dot(q, x), -1, 1)))
VECTORS = {d.name: d for d in (L1, L2, SQL2, LINF, LP3, COSINE, NORMCOSINE, ANGLE, NORMANGLE)}


# Set distances are functions of the sizes i = |a and b|, m = |a|, n = |b|, so an index scores from counts alone.
@dataclass(frozen=True)
class SetDistance:
    """A set distance from counts; as a Distance it intersects sorted unique arrays."""

    name: str
    kind: str
    counts: Callable[[Column, Column, Column], Column]

    def column(self, a: Column, b: Column) -> Column:
        return self.counts(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))

    def __call__(self, a: Column, b: Column) -> Column:
        return self.column(a, b)


def _one_minus(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.lit(1.0) - a / b).otherwise(F.lit(0.0))


JACCARD = SetDistance("jaccard", "metric", lambda i, m, n: _one_minus(i.cast("double"), m + n - i))
DICE = SetDistance("dice", "semimetric", lambda i, m, n: _one_minus(2.0 * i, m + n))
INTERSECTION = SetDistance("intersection", "semimetric", lambda i, m, n: _one_minus(i.cast("double"), F.greatest(m, n)))
COSINESET = SetDistance("cosineset", "semimetric", lambda i, m, n: _one_minus(i.cast("double"), F.sqrt(m.cast("double")) * F.sqrt(n.cast("double"))))


def rogers_tanimoto_set(universe: int) -> SetDistance:
    def counts(i: Column, m: Column, n: Column) -> Column:
        differ = m + n - 2 * i
        agree = F.lit(universe) - differ
        return F.lit(1.0) - agree.cast("double") / (agree + 2 * differ)

    return SetDistance("rogerstanimoto", "metric", counts)


SETS = {d.name: d for d in (JACCARD, DICE, INTERSECTION, COSINESET)}


def common_prefix(a: Column, b: Column) -> Column:
    """1 - shared prefix / shorter length."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    run = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + F.when(s["on"] & x, 1).otherwise(0)).alias("n"), (s["on"] & x).alias("on")))
    shorter = F.least(F.size(a), F.size(b))
    return F.when(shorter > 0, F.lit(1.0) - run["n"] / shorter).otherwise(F.lit(0.0))


def hamming_seq(a: Column, b: Column) -> Column:
    """Positions that differ; null for unequal lengths."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x).cast("double"))


def levenshtein(a: Column, b: Column) -> Column:
    """Unit edit distance of strings; sequences of symbols are mapped to one character each beforehand."""
    return F.levenshtein(a, b).cast("double")


def levenshtein_seq(a: Column, b: Column) -> Column:
    """Unit edit distance of two arrays of any type, by rows of the dynamic programme."""
    first = F.transform(F.sequence(F.lit(0), F.size(b)), lambda j: j)

    def row(last: Column, x: Column) -> Column:
        places = F.transform(b, lambda y, j: F.struct(y.alias("y"), j.alias("j")))
        grow = lambda now, p: F.concat(now, F.array(F.least(F.get(last, p["j"] + 1) + 1, F.element_at(now, -1) + 1, F.get(last, p["j"]) + F.when(p["y"].eqNullSafe(x), 0).otherwise(1))))
        return F.aggregate(places, F.array(F.get(last, F.lit(0)) + 1), grow)

    return F.element_at(F.aggregate(a, first, row), -1).cast("double")


def lcs_length(a, b) -> int:
    """Length of the longest common subsequence, a row at a time."""
    row = np.zeros(len(b) + 1, np.int64)
    b = np.asarray(b)
    for x in a:
        grown = row.copy()
        grown[1:] = np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0))
        row = np.maximum.accumulate(grown)
    return int(row[-1])


def lcs(a: Column, b: Column) -> Column:
    """m + n - 2 lcs of two arrays, by a dynamic programme in Arrow batches."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return x.combine(y, lambda p, q: float(len(p) + len(q) - 2 * lcs_length(p, q)))

    return run(a, b)


def edit_distance(a, b) -> int:
    """Unit edit distance of two sequences, a row at a time."""
    b = np.asarray(b)
    places = np.arange(len(b) + 1)
    row = places.copy()
    for x in a:
        grown = np.minimum(row + 1, np.concatenate([[row[0] + 1], row[:-1] + (b != x)]))
        # an insertion costs one a step: the least of what stands to the left, and the steps from there
        row = np.minimum.accumulate(grown - places) + places
    return int(row[-1])


def edit_udf(a: Column, b: Column) -> Column:
    """Unit edit distance of two long arrays, in Arrow batches."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return x.combine(y, lambda p, q: float(edit_distance(p, q)))

    return run(a, b)


def _edit_some(q: np.ndarray, m: np.ndarray, x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Unit edit distances of sequences with m symbols with those of n, longest first, by columns of differences as bits
    (Myers), all pairs at once: q and x are numbers of symbols from 0, padded."""
    words, one = max(1, -(-int(m.max(initial=0)) // 64)), np.uint64(1)
    bits = np.zeros((len(q), words, int(max(q.max(initial=0), x.max(initial=0))) + 1), np.uint64)
    for at in range(int(m.max(initial=0))):
        has = np.flatnonzero(m > at)
        bits[has, at // 64, q[has, at]] |= one << np.uint64(at % 64)
    last = np.maximum(m - 1, 0) // 64
    shift = [np.where(last == w, np.maximum(m - 1, 0) % 64, 63).astype(np.uint64)[:, None] for w in range(words)]
    up = [np.full((len(q), len(x)), ~np.uint64(0)) for _ in range(words)]
    down = [np.zeros((len(q), len(x)), np.uint64) for _ in range(words)]
    score = np.repeat(m[:, None], len(x), 1)
    for at in range(int(n.max(initial=0))):
        live = int(np.searchsorted(-n, -at, "left"))
        more, less = np.ones((len(q), live), np.uint64), np.zeros((len(q), live), np.uint64)
        for w in range(words):
            p, d = up[w][:, :live], down[w][:, :live]
            same = bits[:, w, x[:live, at]]
            v = same | d
            same |= less
            h = (((same & p) + p) ^ p) | same
            plus, minus = d | ~(h | p), p & h
            out_more, out_less = (plus >> shift[w]) & one, (minus >> shift[w]) & one
            plus, minus = (plus << one) | more, (minus << one) | less
            up[w][:, :live], down[w][:, :live] = minus | ~(v | plus), plus & v
            own = last == w
            score[own, :live] += out_more[own].astype(np.int64) - out_less[own].astype(np.int64)
            more, less = out_more, out_less
    score[m == 0] = n
    return score


def edit_block(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Unit edit distances of all pairs of two tables of padded sequences: a row is a length and then the symbols."""
    _, codes = np.unique(np.concatenate([q[:, 1:].ravel(), x[:, 1:].ravel()]), return_inverse=True)
    a, b = codes[: q[:, 1:].size].reshape(len(q), -1), codes[q[:, 1:].size :].reshape(len(x), -1)
    rows, columns = np.argsort(q[:, 0], kind="stable"), np.argsort(-x[:, 0], kind="stable")
    out = np.empty((len(q), len(x)))
    for at in range(0, len(q), 8):  # tables of bits that stay near the processor
        own = rows[at : at + 8]
        out[np.ix_(own, columns)] = _edit_some(a[own], q[own, 0], b[columns], x[columns, 0])
    return out


#: The edit distance of padded sequences of numbers.
EDIT_CODES = Distance("edit_codes", "metric", lambda a, b: edit_udf(F.slice(a, 2, F.get(a, 0)), F.slice(b, 2, F.get(b, 0))), edit_block, dtype="int64")

SEQS = {"commonprefix": Distance("commonprefix", "premetric", common_prefix), "hamming": Distance("hamming", "metric", hamming_seq), "levenshtein": Distance("levenshtein", "metric", levenshtein), "lcs": Distance("lcs", "metric", lcs), "edit": Distance("edit", "metric", edit_udf)}


def _bits(a: Column, b: Column, op: Builder) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(op(x, y))), F.lit(0), lambda s, x: s + x)


def bits_hamming(a: Column, b: Column) -> Column:
    return _bits(a, b, lambda x, y: x.bitwiseXOR(y)).cast("double")


def bits_russellrao(a: Column, b: Column) -> Column:
    return F.lit(1.0) - _bits(a, b, lambda x, y: x.bitwiseAND(y)) / (F.size(a) * 64)


def bits_rogerstanimoto(a: Column, b: Column) -> Column:
    n, h = F.size(a) * 64, bits_hamming(a, b)
    return F.lit(1.0) - (n - h) / (n + h)


def _counts(op: Callable) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Bits set in op of each word of two rows, summed over the words."""
    def run(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(q), len(x)), np.int32)
        for word in range(q.shape[1]):
            out += np.bitwise_count(op.outer(*(np.ascontiguousarray(m[:, word]).view(np.uint64) for m in (q, x))))
        return out

    return run


_differ, _share = _counts(np.bitwise_xor), _counts(np.bitwise_and)


def _russellrao(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1.0 - _share(q, x) / (q.shape[1] * 64)


def _rogerstanimoto(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    n, h = q.shape[1] * 64, _differ(q, x).astype(np.float64)
    return 1.0 - (n - h) / (n + h)


BITS = {
    "bits_hamming": Distance("bits_hamming", "metric", bits_hamming, lambda q, x: _differ(q, x).astype(np.float64), dtype="int64"),
    "bits_russellrao": Distance("bits_russellrao", "premetric", bits_russellrao, _russellrao, dtype="int64"),
    "bits_rogerstanimoto": Distance("bits_rogerstanimoto", "metric", bits_rogerstanimoto, _rogerstanimoto, dtype="int64"),
}
#: The negative inner product.
DOT = Distance("dot", "premetric", lambda a, b: -dot(a, b), lambda q, x: -(q @ x.T), _dots(lambda d: d), lambda q, x: -_rows_dot(q, x))


def negative(d: Distance) -> Distance:
    """-d, which turns nearest into farthest."""
    return Distance(f"negative_{d.name}", "premetric", lambda a, b: -d(a, b), d.block and (lambda q, x: -d.block(q, x)))


def similarity(d: Distance) -> Builder:
    """1 / (1 + d)."""
    return lambda a, b: F.lit(1.0) / (F.lit(1.0) + d(a, b))
