"""Scalar quantisation, projections, bit sketches and the spherical embedding, as array expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .distances import dot, norm


def _clamp(x: Column, top: int) -> Column:
    return F.least(F.greatest(x, F.lit(0)), F.lit(top))


def quantise(v: Column, bits: int) -> Column:
    """struct(min, c, codes) of one vector: codes are round((x - min) / c), half to even, within 0 .. 2^bits - 1.

    Codes of 4 and 2 bits are packed to bytes: a dimension that fills no whole bytes is an error.
    """
    top, each = (1 << bits) - 1, 8 // bits
    if each > 1:
        wrong = F.raise_error(F.concat(F.lit(f"the dimension must be a multiple of {each}, not "), F.size(v)))
        v = F.when(F.size(v) % each == 0, v).otherwise(wrong)
    low, high = F.array_min(v).cast("double"), F.array_max(v).cast("double")
    c = (high - low + F.lit(1e-6)) / F.lit(float(top))
    return F.struct(low.alias("min"), c.alias("c"), F.transform(v, lambda x: _clamp(F.bround((x.cast("double") - low) / c).cast("int"), top)).alias("codes"))


def dequantise(q: Column) -> Column:
    return F.transform(q["codes"], lambda x: x * q["c"] + q["min"])


def pack(codes: Column, bits: int) -> Column:
    """Codes as bytes, low bits first: 8 / bits codes to a byte; there must be whole bytes of them."""
    each = 8 // bits
    parts = F.sequence(F.lit(0), (F.size(codes) / each).cast("int") - 1)
    at = lambda i, j: F.get(codes, i * each + j) * F.lit(1 << (bits * j))
    return F.transform(parts, lambda i: sum((at(i, j) for j in range(1, each)), at(i, 0)))


def signed_l1(a: Column, b: Column) -> Column:
    """The two-bit code's L1: a signed sum of differences, as documented for it."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x - y), F.lit(0.0), lambda s, x: s + x)


def quantise_global(v: Column, low: float, high: float, bits: int) -> Column:
    """Codes under one range for all vectors."""
    top = (1 << bits) - 1
    return F.transform(v, lambda x: _clamp(F.bround((x.cast("double") - F.lit(low)) * F.lit(top / (high - low))).cast("int"), top))


def global_range(objects: DataFrame, quantiles: tuple[float, float] = (0.025, 0.975)) -> tuple[float, float]:
    """The range of components between two quantiles; two numbers reach the driver."""
    row = objects.select(F.explode("v").alias("x")).agg(F.percentile_approx("x", list(quantiles), 10000).alias("q")).first()
    return float(row["q"][0]), float(row["q"][1])


def codes_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def codes_sql2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def hadamard(v: Column, dim: int, normalise: bool = False) -> Column:
    """Walsh-Hadamard transform in natural order; dim is a power of two."""
    if dim < 1 or dim & (dim - 1):
        raise ValueError("the dimension must be a power of two")
    scale = F.lit(1.0 / np.sqrt(dim)) if normalise else F.lit(1.0)
    places = F.array(*[F.lit(i) for i in range(dim)])
    return F.transform(places, lambda i: F.aggregate(F.zip_with(v, places, lambda x, j: F.when(F.bit_count(i.bitwiseAND(j)) % 2 == 0, x.cast("double")).otherwise(-x.cast("double"))), F.lit(0.0), lambda s, x: s + x) * scale)


def matrix_gaussian(dim: int, out: int, seed: int = 0) -> np.ndarray:
    m = np.random.default_rng(seed).normal(0, 1 / np.sqrt(out), (dim, out))
    return m / np.linalg.norm(m, axis=0)


def matrix_qr(dim: int, out: int, seed: int = 0) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).random((dim, dim)))[0][:, :out]


def project(v: Column, matrix: np.ndarray) -> Column:
    """dot(column, v) for each column of a fixed matrix."""
    return F.array(*[dot(v, F.array(*[F.lit(float(x)) for x in column])) for column in matrix.T])


def sketch(v: Column, dim: int) -> Column:
    """Signs as bits, least first, 64 to a long: bit i is set where v[i] >= 0."""
    def word(at: int) -> Column:
        set_bits = F.transform(F.slice(v, at + 1, 64), lambda x, i: F.when(x >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(set_bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))

    return F.array(*[word(at) for at in range(0, dim, 64)])


def bitsketch(v: Column, matrix: np.ndarray) -> Column:
    """The signs of a vector's projections as bits: a sketch whose Hamming distance follows the angle."""
    return sketch(project(v, matrix), matrix.shape[1])


def bitsketches(objects: DataFrame, method: str, out: int, dim: int, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """(id, v) of the objects' sketches by a new rotation (gaussian or qr), and the rotation, for sketching queries alike."""
    if method not in ("gaussian", "qr"):
        raise ValueError(f"unknown method {method}")
    matrix = (matrix_gaussian if method == "gaussian" else matrix_qr)(dim, out, seed)
    return objects.select("id", bitsketch(F.col("v"), matrix).alias("v")), matrix


def spherical(v: Column, longest: Column, pad: int = 0) -> Column:
    """x / M, zeros, sqrt(1 - |x / M|^2) clamped at 0: unit vectors whose L2 order is the inner-product order."""
    scaled = F.transform(v, lambda x: x.cast("double") / longest)
    rest = F.sqrt(F.greatest(F.lit(1.0) - F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x * x), F.lit(0.0)))
    return F.concat(scaled, F.array_repeat(F.lit(0.0), pad), F.array(rest))


def spherical_query(v: Column, pad: int = 0) -> Column:
    length = norm(v)
    return F.concat(F.transform(v, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0))), F.array_repeat(F.lit(0.0), pad + 1))


def spherical_table(objects: DataFrame, pad: int = 0) -> DataFrame:
    """(id, v) embedded with M, the longest norm of all objects, which must be positive."""
    longest = objects.agg(F.max(norm(F.col("v"))).alias("m")).first()["m"]
    if not longest or longest <= 0:
        raise ValueError("no vector with a positive norm")
    return objects.select("id", spherical(F.col("v"), F.lit(float(longest)), pad).alias("v"))
