"""Reading objects, storing results, and saving indexes as Parquet folders."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_objects(spark: SparkSession, place: str, id_column: str | None = None) -> DataFrame:
    """(id, v) from `path:column` (split at the last colon); the id column is the first of whole numbers."""
    path, _, column = place.rpartition(":")
    if not path:
        raise ValueError("expected path:column")
    df = spark.read.parquet(path)
    if column not in df.columns:
        raise ValueError(f"{path} has no column {column}")
    own = id_column or next((n for n, t in df.dtypes if t in ("bigint", "int") and n != column), None)
    if own is None:
        raise ValueError("no id column")
    return df.select(F.col(own).cast("long").alias("id"), F.col(column).alias("v"))


def write_results(hits: DataFrame, path: str, distances: bool = True) -> None:
    (hits if distances else hits.drop("dist")).write.mode("overwrite").parquet(path)


def read_results(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """Results, with columns renamed to qid, id, rank, dist if they have other names."""
    return spark.read.parquet(path).withColumnsRenamed(columns or {})


#: Version of the layout of object stores.
VERSION = 1


def create_store(spark: SparkSession, path: str, dim: int, element: str = "double") -> None:
    """A new store of (id, v) objects: path/objects and a head with version, dimension and element type. An existing one
    is an error."""
    head = spark.createDataFrame([(json.dumps({"version": VERSION, "dim": dim, "element": element}),)], "value string")
    head.coalesce(1).write.mode("error").text(f"{path}/head")


def store_head(spark: SparkSession, path: str) -> dict:
    head = json.loads(spark.read.text(f"{path}/head").first()["value"])
    if head.get("version") != VERSION:
        raise ValueError(f"{path} has version {head.get('version')}, not {VERSION}")
    return head


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """(id, v) of a store. A DataFrame is read-only; append_store() adds."""
    head = store_head(spark, path)
    return spark.read.schema(f"id long, v array<{head['element']}>").option("recursiveFileLookup", "true").parquet(f"{path}/objects")


def append_store(objects: DataFrame, path: str, read_only: bool = False) -> None:
    """Appends to a store what fits its head: element type and dimension. One append is one commit."""
    if read_only:
        raise PermissionError(f"{path} is read-only")
    head = store_head(objects.sparkSession, path)
    own = objects.select(F.col("id").cast("long").alias("id"), "v")
    if own.schema["v"].dataType.simpleString() != f"array<{head['element']}>":
        raise TypeError(f"vectors of {own.schema['v'].dataType.simpleString()}, not of {head['element']}")
    dim = head["dim"]
    wrong = F.raise_error(F.lit(f"vectors must have dimension {dim}")).cast(own.schema["v"].dataType)
    append_objects(own.select("id", F.when(F.size("v") == dim, F.col("v")).otherwise(wrong).alias("v")), f"{path}/objects")


def append_objects(objects: DataFrame, path: str) -> None:
    """One append is one commit: readers see all of it or nothing."""
    objects.select("id", "v").write.mode("append").parquet(path)


def save_index(spark: SparkSession, path: str, tables: dict[str, DataFrame], params: dict) -> None:
    """An index's own tables (edges, centers, ...) and parameters; the objects stay where they are."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps({"params": params, "tables": sorted(tables)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/params")


def load_index(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    head = json.loads(spark.read.text(f"{path}/params").first()["value"])
    return {name: spark.read.parquet(f"{path}/{name}") for name in head["tables"]}, head["params"]
