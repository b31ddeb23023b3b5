"""Mixing sources to target weights by a time-varying curriculum. DataFrame functions only.

Every source has a weight schedule over training time t in [0, 1], piecewise linear. Its integral is the source's
overall weight, by which targets are shared; a source's words are consumed along that integral, so inverting the
cumulative demand gives each document the position (time) at which it is due. The result is range-sorted by position.

Nothing is gathered by source: documents fall into hash buckets, as many as keep them small, bucket totals are
pre-aggregated, and a running sum never spans more than one bucket of one source, so a source that holds most rows costs
no single task.

Cases: null or empty text has size 0 and is never taken (position null, last); null source is a source of its own, last
in order; repeated rows count as often as they occur; an empty table gives an empty result; other columns, of any name,
are ignored, or kept by mixture().
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, quoted, text_key

#: Schedules by rank of the source, repeating: (t, weight) knots of a piecewise linear function. Their integrals, the
#: overall weights, are 3, 1 and 2.
SCHEDULES = (((0.0, 4.5), (1.0, 1.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 2.0), (1.0, 2.0)))
#: Rows that a hash bucket holds on average, at the most.
BUCKET_ROWS = 2_000
WORD = r"[^\x20\x09-\x0D]+"


def weight(schedule: Sequence[tuple[float, float]]) -> float:
    """The integral of a schedule."""
    return sum((b - a) * (v + w) / 2 for (a, v), (b, w) in zip(schedule, schedule[1:]))


def integrals(shape: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """Segments (t0, t1, w0, slope, mass before t0) of a schedule normalised to integral 1."""
    mass = weight(shape)
    found, before = [], 0.0
    for (a, v), (b, w) in zip(shape, shape[1:]):
        v, w = v / mass, w / mass
        found.append((a, b, v, (w - v) / (b - a), before))
        before += (b - a) * (v + w) / 2
    return found


def due(demand: Column, rank: Column, shapes: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """The time at which a source's cumulative demand, as a fraction, is reached."""
    by_rank = None
    for i, shape in enumerate(shapes):
        at = None
        for a, b, v, slope, before in reversed(integrals(shape)):
            rest = F.greatest(demand - F.lit(before), F.lit(0.0))
            # v dt + slope dt^2 / 2 = rest, in the form that is stable for a slope near 0
            root = F.sqrt(F.greatest(F.lit(v * v) + F.lit(2 * slope) * rest, F.lit(0.0)))
            here = F.least(F.lit(a) + F.when(root + F.lit(v) > 0, F.lit(2.0) * rest / (F.lit(v) + root)).otherwise(0.0), F.lit(b))
            at = here if at is None else F.when(demand < F.lit(before + (b - a) * (2 * v + slope * (b - a)) / 2), here).otherwise(at)
        by_rank = F.when(rank % len(shapes) == i, at) if by_rank is None else by_rank.when(rank % len(shapes) == i, at)
    return by_rank


def targets(sizes: DataFrame, weights: Sequence[float], budget: float = 1.5, repeats: int = 2) -> DataFrame:
    """(source, rank, weight, source_size, target) for sizes (source, size): one row per source.

    Targets share `budget` times all words by weight. A target stops at `repeats` times its source's words and the rest
    is shared again by weight; in closed form, sources saturate in the order of capacity per weight.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", weight)
    capacity = F.col("source_size") * F.lit(repeats)
    ranked = ranked.withColumn("ratio", capacity / F.col("weight"))
    full = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("ratio", "rank").rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(budget))
    level = (total - F.coalesce(F.sum(capacity).over(full), F.lit(0))) / F.sum("weight").over(rest)
    # sources from the first whose capacity exceeds its share share one level
    ranked = ranked.withColumn("level", level).withColumn("open", F.col("level") <= F.col("ratio"))
    shared = F.min(F.when(F.col("open"), F.struct("ratio", "rank", "level"))).over(everything)["level"]
    ranked = ranked.withColumn("shared", shared)
    target = F.when(F.col("shared").isNull() | (F.col("ratio") < F.col("shared")), capacity.cast("double")).otherwise(F.col("weight") * F.col("shared"))
    return ranked.select("source", F.col("rank").cast("long").alias("rank"), "weight", "source_size", target.alias("target"))


def mix(docs: DataFrame, schedules=SCHEDULES, budget: float = 1.5, repeats: int = 2) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies, position) of every row, range-sorted by position."""
    return placed(docs, schedules, budget, repeats).drop("start", "rank").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def placed(docs: DataFrame, schedules=SCHEDULES, budget: float = 1.5, repeats: int = 2, carry: Sequence[str] = ()) -> DataFrame:
    """The columns of mix(), start (its source's words before it), rank (its source's) and the columns in carry.

    taken is the words that the mix takes of the document, repeats counted: whole passes over the source first, then in
    hash order whole documents up to the rest of the target, to the nearest document. position is the time in [0, 1]
    of its first use (null if it isn't taken).
    """
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key"), *carry)
    sized = cut(sized)
    rows = sized.count()
    digits = next(d for d in range(1, 9) if rows <= BUCKET_ROWS * 16**d or d == 8)
    sized = sized.withColumn("bucket", F.substring("key", 1, digits))
    per_bucket = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.withColumn("offset", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    goal = targets(per_bucket.select("source", F.col("bucket_size").alias("size")), [weight(s) for s in schedules], budget, repeats)
    offsets = offsets.alias("o").join(goal.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source"))).select("o.source", "bucket", "offset", "rank", "source_size", "target")
    rows = sized.alias("s").join(offsets.alias("o"), F.col("s.source").eqNullSafe(F.col("o.source")) & (F.col("s.bucket") == F.col("o.bucket")))
    rows = rows.select("s.doc_id", "s.source", "s.size", "s.key", "s.bucket", *[f"s.{c}" for c in carry], "offset", "rank", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    rows = rows.withColumn("start", start)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - passes * F.col("source_size")
    more = F.when((F.col("start") + F.col("size") / F.lit(2.0) < rest) & (F.col("size") > 0), F.lit(1)).otherwise(F.lit(0)).cast("long")
    copies = F.when(F.col("size") > 0, F.least(passes + more, F.lit(repeats).cast("long"))).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("copies", copies)
    demand = F.least(F.try_divide("start", "target"), F.lit(1.0))
    position = F.when(F.col("copies") > 0, due(demand, F.col("rank"), schedules))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", F.round(position, 9).alias("position"), "start", "rank", *carry)


def training_order(mixed: DataFrame, schedules=SCHEDULES) -> DataFrame:
    """A row for every use of every taken document of placed(), range-sorted by the time it is due (position, use)."""
    uses = mixed.where("copies > 0").withColumn("use", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    demand = F.least(F.try_divide(F.col("start") + F.col("use") * F.col("source_size"), F.col("target")), F.lit(1.0))
    return uses.withColumn("position", F.round(due(demand, F.col("rank"), schedules), 9)).orderBy("position", "doc_id", "use")


def mixture(docs: DataFrame, schedules=SCHEDULES, budget: float = 1.5, repeats: int = 2) -> DataFrame:
    """The documents of the mix in training order, with the columns of docs: a row for every use of a document.

    Sizes and places are worked out without the texts, which join by a key of the row at the end.
    """
    keyed = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), "doc_id", "source", "text", text_key("doc_id", "source", "text").alias("row_key"))
    uses = training_order(placed(keyed, schedules, budget, repeats, carry=["row_key"]), schedules).select("row_key", "position", "doc_id", "use")
    # equal rows have one key and are each in uses
    rows = keyed.select("row_key", "row").groupBy("row_key").agg(F.first("row").alias("row"))
    return uses.join(rows, "row_key").orderBy("position", "doc_id", "use").select("row.*")
