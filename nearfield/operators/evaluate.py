"""Statistics of results, quantiles, histograms and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import recall, slots_of
from .select import cut


#: Up to so many values of a group are merged in one task.
GROUP = 200_000


def quantiles(df: DataFrame, column: str, at: float, by: str | None = None) -> DataFrame:
    """(by, n, quantile): the exact quantile of each group's values, interpolated between the two nearest ranks.

    Groups of at most GROUP values are merged in a task each. If any is larger, values are range-sorted over the cluster
    and ranks counted by partition, so that no group's values meet in a task. df is read twice. Nulls don't count.
    """
    key = F.col(by) if by else F.lit(0)
    rows = df.select(key.alias("_by"), F.col(column).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    own, keep = rows.groupBy("_by"), [F.col("_by").alias(by)] if by else []
    if not own.count().where(F.col("count") > GROUP).limit(1).count():
        found = own.agg(F.count("*").alias("n"), F.percentile("_x", F.lit(float(at))).alias("quantile"))
        return found.select(*keep, "n", "quantile")
    rows = rows.repartitionByRange(slots_of(df), "_by", "_x").sortWithinPartitions("_by", "_x")
    rows = cut(rows.select("_by", "_x", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_place")))
    parts = rows.groupBy("_by", "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("n", F.sum("_n").over(Window.partitionBy("_by")))
    rank = (F.col("n") - 1) * F.lit(float(at))
    # the two ranks, where they lie in this partition
    wanted = F.array_distinct(F.array(F.floor(rank), F.ceil(rank)))
    wanted = parts.select("_by", "_part", "n", rank.alias("_rank"), F.explode(wanted).alias("_at"), "_before", "_n", "_first")
    wanted = wanted.where((F.col("_at") >= F.col("_before")) & (F.col("_at") < F.col("_before") + F.col("_n"))).withColumn("_place", F.col("_first") + F.col("_at") - F.col("_before"))
    # two rows a group; a place names a row
    found = rows.select("_place", "_x").join(wanted.select("_by", "n", "_rank", "_at", "_place"), "_place")
    low, high = F.min_by("_x", "_at"), F.max_by("_x", "_at")
    found = found.groupBy("_by", "n").agg((low + (high - low) * (F.max("_rank") - F.min("_at"))).alias("quantile"))
    return found.select(*keep, "n", "quantile")


def describe(df: DataFrame, column: str) -> DataFrame:
    """One row: n, mean, std, min, median, max."""
    x = F.col(column)
    own = cut(df.select(x))
    median = quantiles(own, column, 0.5).select(F.col("quantile").alias("median"))
    plain = own.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    # two tables of one row at most
    return plain.join(median, how="left").select("n", "mean", "std", "min", "median", "max")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int = 30) -> DataFrame:
    return df.groupBy(F.width_bucket(column, F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def macro_recall(gold: DataFrame, found: DataFrame) -> DataFrame:
    return recall(gold, found).agg(F.avg("recall").alias("recall"))


def costs(visited: DataFrame) -> DataFrame:
    """(qid, distances, blocks) of a search's visits: distances computed and neighbourhoods expanded."""
    return visited.groupBy("qid").agg(F.count("*").alias("distances"), F.count_if("expanded").alias("blocks"))


def cost_stats(costs_: DataFrame, column: str | Column = "distances") -> DataFrame:
    """(total, min, mean, max) of a cost over the queries that have any."""
    x = F.when(F.col(column) > 0, F.col(column)) if isinstance(column, str) else column
    return costs_.agg(F.coalesce(F.sum(x), F.lit(0)).alias("total"), F.coalesce(F.min(x), F.lit(0)).alias("min"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.coalesce(F.max(x), F.lit(0)).alias("max"))
