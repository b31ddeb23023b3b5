"""Literal values of distances, quantisers and transforms."""

import math

import pytest
from pyspark.sql import functions as F

from nearfield.functions import distances as D
from nearfield.functions import vectors as V


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def array(xs, kind="array<double>"):
    return F.lit(xs).cast(kind) if xs else F.array().cast(kind)


@pytest.mark.parametrize("dist, expected", [(D.L1, 12), (D.SQL2, 50), (D.L2, math.sqrt(50)), (D.LINF, 5), (D.lp(3), 6), (D.lp(0.5), 35.61844)])
def test_vectors(spark, dist, expected):
    assert value(spark, dist(array([1.0, 2.0, 3.0]), array([4.0, 6.0, 8.0]))) == pytest.approx(expected, abs=1e-4)


def test_angles(spark):
    e, f = array([1.0, 0.0, 0.0]), array([0.0, 1.0, 0.0])
    assert value(spark, D.ANGLE(e, f)) == pytest.approx(math.pi / 2)
    assert value(spark, D.NORMANGLE(e, f)) == pytest.approx(math.pi / 2)
    assert value(spark, D.COSINE(e, f)) == pytest.approx(1)
    assert value(spark, D.NORMCOSINE(e, e)) == pytest.approx(0)


def test_ragged_is_null(spark):
    assert value(spark, D.L2(array([1.0]), array([1.0, 2.0]))) is None


@pytest.mark.parametrize("dist, expected", [(D.JACCARD, 2 / 3), (D.DICE, 0.5), (D.INTERSECTION, 0.5), (D.COSINESET, 0.5), (D.rogers_tanimoto_set(10), 4 / 7)])
def test_sets(spark, dist, expected):
    assert value(spark, dist(array([1, 2, 3, 4], "array<int>"), array([3, 4, 5, 6], "array<int>"))) == pytest.approx(expected)


def test_sequences(spark):
    a, b = array([1, 2, 3, 4, 5], "array<int>"), array([1, 2, 3, 6, 7], "array<int>")
    assert value(spark, D.common_prefix(a, b)) == pytest.approx(0.4)
    assert value(spark, D.hamming_seq(a, b)) == 2
    assert value(spark, D.lcs(a, b)) == 4
    assert value(spark, D.levenshtein_seq(a, b)) == 2
    assert value(spark, D.levenshtein_seq(array(["x"], "array<string>"), array([], "array<string>"))) == 1
    assert value(spark, D.levenshtein(F.lit("2235"), F.lit("2335"))) == 1


def test_bits(spark):
    a, b = array([0b1010, 0b1100], "array<long>"), array([0b1000, 0b1100], "array<long>")
    assert value(spark, D.bits_hamming(a, b)) == 1
    assert value(spark, D.bits_russellrao(a, b)) == pytest.approx(0.9765625)
    assert value(spark, D.bits_rogerstanimoto(a, b)) == pytest.approx(1 - 127 / 129)


def test_hadamard_and_sketch(spark):
    v = array([1.0, 2.0, 3.0, 4.0])
    assert value(spark, V.hadamard(v, 4)) == [10, -2, -4, 0]
    assert value(spark, V.sketch(array([1.0, -1.0, 0.0, -2.0]), 4)) == [0b101]
    with pytest.raises(ValueError):
        V.hadamard(v, 3)


def test_spherical_stale_norm(spark):
    assert value(spark, V.spherical(array([10.0] * 4), F.lit(2.0)))[-1] == 0
