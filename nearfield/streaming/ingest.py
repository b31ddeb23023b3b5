"""Streaming ingest: micro-batches append to the object table and are logged once each."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def logged(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/log")
    except Exception as e:  # not there before the first batch
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def due(before: int, now: int, base: float = 1.5, start: int = 0) -> bool:
    """Whether work that follows the size is due after growing from `before` to `now` objects: at each power of the base."""
    power = lambda n: math.ceil(math.log(n, base)) if n > 0 else 0
    return now >= start and now > before and (before <= 0 or power(before) != power(now))


def by_size(work: Callable[[SparkSession, int], None], path: str, base: float = 1.5, start: int = 0) -> Callable[[DataFrame, int], None]:
    """A hook for ingest() that runs work(session, objects so far) when the size makes it due."""

    def after(batch: DataFrame, batch_id: int) -> None:
        own = logged(batch.sparkSession, path).where(F.col("batch_id") == batch_id).first()
        if due(own["sp"] - 1, own["ep"], base, start):
            work(batch.sparkSession, own["ep"])

    return after


def progress(query: StreamingQuery) -> dict[str, float]:
    """Rows and rows a second of a stream's batches so far."""
    own = query.recentProgress
    rows = sum(p["numInputRows"] for p in own)
    seconds = sum(p["batchDuration"] for p in own) / 1000
    return {"batches": len(own), "rows": rows, "rows_per_second": rows / seconds if seconds else 0.0}


def ingest(stream: DataFrame, path: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Appends (id, v) of each micro-batch to path/objects/batch=N and a log row (batch_id, event, sp, ep) to path/log.

    A batch overwrites its own folder and log row, so a batch that runs twice after a failure counts once. sp and ep are
    the places of its first and last row in the whole, without gaps. `after` sees the batch once it is stored.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.select("id", "v").write.mode("overwrite").parquet(f"{path}/objects/batch={batch_id}")
        stored = spark.read.parquet(f"{path}/objects/batch={batch_id}")
        n = stored.count()
        log = logged(spark, path)
        done = 0 if log is None else log.where(F.col("batch_id") < batch_id).agg(F.max("ep")).first()[0] or 0
        spark.createDataFrame([("add", done + 1, done + n)], "event string, sp long, ep long").coalesce(1).write.mode("overwrite").parquet(f"{path}/log/batch_id={batch_id}")
        if after:
            after(stored, batch_id)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
