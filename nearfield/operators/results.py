"""Result containers as tables (qid, id, rank, dist): ends, pops, covering radius, and their sparse-vector form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import ranked


def nearest(hits: DataFrame) -> DataFrame:
    """(qid, id, dist) of each query's first hit."""
    return hits.groupBy("qid").agg(F.min(F.struct("dist", "id")).alias("h")).select("qid", "h.id", "h.dist")


def frontier(hits: DataFrame) -> DataFrame:
    """(qid, id, dist) of each query's last hit."""
    return hits.groupBy("qid").agg(F.max(F.struct("dist", "id")).alias("h")).select("qid", "h.id", "h.dist")


def covering_radius(hits: DataFrame, k: int) -> DataFrame:
    """(qid, radius): the greatest distance of k hits; infinite until there are k."""
    radius = F.when(F.count("*") < k, F.lit(float("inf"))).otherwise(F.max("dist"))
    return hits.groupBy("qid").agg(radius.alias("radius"))


def pop_min(hits: DataFrame) -> DataFrame:
    """hits without each query's best; ranks move up."""
    return hits.where("rank > 1").withColumn("rank", F.col("rank") - 1)


def pop_max(hits: DataFrame) -> DataFrame:
    """hits without each query's worst."""
    last = hits.groupBy("qid").agg(F.max("rank").alias("last"))
    return hits.join(last, "qid").where(F.col("rank") < F.col("last")).drop("last")


def to_sparse(hits: DataFrame) -> DataFrame:
    """(qid, hits): one sparse vector a query, (id, dist) by id. A query has k hits, so no list grows with the data."""
    return hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("id", "dist"))).alias("hits"))


def from_sparse(vectors: DataFrame, k: int) -> DataFrame:
    """The k best entries of each sparse vector as hits."""
    return ranked(vectors.select("qid", F.explode("hits").alias("h")).select("qid", "h.id", "h.dist"), k)


def permuted(hits: DataFrame, places: DataFrame) -> DataFrame:
    """Hits on permuted objects with their own ids again; places: (id, pos)."""
    own = places.select(F.col("pos").alias("id"), F.col("id").alias("own"))
    return hits.join(own, "id").select("qid", F.col("own").alias("id"), "rank", "dist")
