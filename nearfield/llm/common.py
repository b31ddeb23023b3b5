"""Helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Size of the bitmap of maybe_in(), in words of 32 bits.
FILTER_WORDS = 1 << 18
#: Bytes after which an Arrow batch for a Python worker is closed; a longer row still goes whole.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The folder that all executors and the driver share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df from the shared checkpoint folder, so that a lost executor costs no earlier stage.

    The folder is the session's spark.checkpoint.dir. Where that is unset, a local session makes a folder of its own
    and any other is an error.
    """
    shared(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again."""
    path = f"{shared(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def quoted(name: str) -> Column:
    """A column by its whole name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(*columns: Column | str) -> Column:
    """A 128-bit key of some columns as 16 bytes: equal rows, equal keys; nulls and empty strings differ."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    sides = [F.lpad(F.hex(F.xxhash64(F.lit(seed), *parts, *[p.isNull() for p in parts])), 16, "0") for seed in (11, 29)]
    return F.unhex(F.concat(*sides))


#: A key with more than one HOTth of all rows is hot; there are fewer than HOT of them, whatever the data.
HOT = 10_000


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches in slices of some rows, without empty ones. A worker is used again by later tasks: between batches and at
    the end, memory that Arrow no longer needs goes back to the system."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()


def small_batches(spark: SparkSession) -> None:
    """From now on, the session's Arrow batches for Python workers are closed at BATCH_BYTES, unless it has a bound of its own.

    Spark's is 64 MB, and a task holds a batch several times: where it is written, in the worker and where it is read.
    """
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) is None:
        spark.conf.set(bound, BATCH_BYTES)


def maybe_in(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows with _maybe: true where the key is among those of keys, and by chance elsewhere.

    A bitmap of the keys' hashes joins by words of 32 bits; it has FILTER_WORDS rows at most, so it is broadcast. What it
    rules out needn't be shuffled.
    """
    place = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(32 * FILTER_WORDS))
    word, bit = F.floor(place / 32).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 32).cast("int"))
    bitmap = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    found = rows.withColumn("_word", word).join(F.broadcast(bitmap), "_word", "left")
    return found.withColumn("_maybe", F.coalesce(bit.bitwiseAND(F.col("_bits")) != 0, F.lit(False))).drop("_word", "_bits")


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str = "n", how: str = "inner") -> DataFrame:
    """left joined with right, which has one row a key, a count of the key's rows and stored rows (it is read thrice).

    A key is dealt over as many salts as it has HOTths of all rows, one for most; right repeats a row for each of its
    salts, which adds fewer than 2 * HOT rows. Fewer than HOT keys have several salts: only those are broadcast, to
    salt left. So no key's rows meet in one task. how: inner or left.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    salted = right.withColumn("_salts", F.greatest(F.ceil(F.col(rows) * HOT / F.lit(max(total, 1))), F.lit(1)).cast("int"))
    hot = F.broadcast(salted.where("_salts > 1").select(*keys, "_salts"))
    salt = F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*left.columns), F.col("_salts")).cast("int"))
    dealt = left.join(hot, keys, "left").withColumn("_salt", salt).drop("_salts")
    repeated = salted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")
