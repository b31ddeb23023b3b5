"""Line dedup: later copies of repeated line runs, found with a suffix array over line ids by prefix doubling.

Lines are numbered by content; a document is a sequence of line ids. Only lines that occur more than once can be in a
repeated run, so the array holds the suffixes inside segments of such lines, and of these only segments of at least
`min_words` words. Prefix doubling then ranks suffixes by their first 1, 2, 4, ... lines: each round range-sorts the
distinct pairs (rank here, rank 2^k lines on) over the cluster, and a pair's place is the next rank. Doubling stops at
the length within which any run reaches min_words, at most min_words lines, so the rounds don't follow the longest copy.

Longest common prefixes are needed only as far as min_words words: two suffixes have one that long just where they agree
on the shortest window of min_words words, and two windows agree where (length, rank of the first 2^k lines, rank of the
last 2^k lines) does, 2^k being the greatest power within the length. So each key is an interval of the array with a
longest common prefix of min_words words or more. In each interval the first occurrence, by (doc_id, line), stays, and
every other window, from a line or up to a line, is a later copy. A maximal repeated run of min_words words or more is the
union of its windows, so all of its later copies go, and a shorter run stays.

Frequent lines and windows join without meeting in one task (hot_join), and are counted with partial aggregation.

Cases: null text stays null; blank lines belong to no run, but go where both neighbours go; rows with equal doc_id and
text are one document given several times and are treated alike; null doc_id is first in order; an empty table gives
an empty result; columns may have any name, those named like the results are replaced in dedup(), none in cleaned().
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, hot_join, maybe_in, partitions, quoted, sliced, text_key

#: Words that a repeated run of whole lines must have. A passage of more than 50 words that begins or ends inside a line
#: leaves fewer in whole lines.
MIN_WORDS = 30
#: Rows that a Python worker takes up at a time.
SLICE = 256
RESULTS = ("n_lines", "removed_lines", "removed")


def lines_of(docs: DataFrame) -> DataFrame:
    """(key, doc_id, line, id, words) of every line with a word; a document given several times counts once."""
    rows = docs.where(F.col("text").isNotNull()).select(text_key("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line", "content"))
    rows = rows.withColumn("content", F.btrim("content", F.lit(" \t\r\x0b\x0c"))).where("content <> ''")
    return rows.select("key", "doc_id", "line", text_key("content").alias("id"), F.size(F.split("content", r"\s+")).cast("int").alias("words"))


def segments(docs: DataFrame, min_words: int) -> DataFrame:
    """(segment, key, doc_id, lines, words, ids): maximal runs of lines that occur more than once, of min_words words."""
    every = cut(lines_of(docs))
    # equal documents under equal keys count once: the key names (doc_id, text), so (key, line) names a line
    counted = every.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("key", "line")).alias("low"), F.max(F.struct("key", "line")).alias("high"))
    repeated = cut(counted.where((F.col("n") > 1) & (F.col("low") != F.col("high"))).select("id", "n", F.lit(True).alias("again")))
    # lines without words leave no gap: a segment breaks at a line with words that isn't repeated
    numbered = hot_join(every, repeated, ["id"], how="left")
    by_doc = numbered.groupBy("key", "doc_id").agg(F.max("again").alias("any"), F.array_sort(F.collect_set(F.struct("line", "id", "words", "again"))).alias("all")).where("any")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, SLICE):
            out: list[list] = [[], [], [], [], []]
            for key, doc_id, every_line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                run: list[dict] = []
                for x in [*every_line, None]:
                    if x is not None and x["again"]:
                        run.append(x)
                        continue
                    if run and sum(r["words"] for r in run) >= min_words:
                        for to, value in zip(out, (key, doc_id, [r["line"] for r in run], [r["words"] for r in run], [r["id"] for r in run])):
                            to.append(value)
                    run = []
            types = (pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=["key", "doc_id", "lines", "words", "ids"])

    found = by_doc.select("key", "doc_id", "all").mapInArrow(split, "key binary, doc_id long, lines array<int>, words array<int>, ids array<binary>")
    return cut(found.select(F.monotonically_increasing_id().alias("segment"), "*"))


def ranked(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct rows of some columns with their number n and rank: place in the order over the whole cluster, with gaps.

    A range sort deals rows to partitions in order, so partition and place within it make an ordered number. Ranks are
    cut from their lineage: a repeated sort could number them anew.
    """
    distinct = pairs.groupBy(*columns).agg(F.count("*").alias("n"))
    return cut(distinct.repartitionByRange(partitions(pairs.sparkSession), *columns).sortWithinPartitions(*columns).withColumn("rank", F.monotonically_increasing_id()))


def doubled(found: DataFrame, levels: int) -> DataFrame:
    """found with ranks: for each level k, the rank of each suffix by its first 2^k lines (null where fewer are left)."""
    pairs = found.select("segment", F.posexplode("ids").alias("at", "id"))
    placed = hot_join(pairs, ranked(pairs, ["id"]), ["id"]).groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("at", "rank"))).alias("r"))
    state = cut(placed.select("segment", F.array(F.col("r.rank")).alias("ranks")))
    for level in range(levels):
        step = 1 << level
        last = F.element_at("ranks", -1)
        n = F.size(last) - step
        two = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("at"), last[i].alias("one"), last[i + step].alias("two")))  # noqa: B023
        pairs = state.where(n > 0).select("segment", F.explode(two).alias("p")).select("segment", "p.*")
        placed = hot_join(pairs, ranked(pairs, ["one", "two"]), ["one", "two"]).groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("at", "rank"))).alias("r"))
        grown = state.join(placed, "segment", "left")
        state = cut(grown.select("segment", F.concat("ranks", F.array(F.coalesce(F.col("r.rank"), F.array().cast("array<long>")))).alias("ranks")))
    return found.join(state, "segment")


def windows(found: DataFrame, min_words: int) -> DataFrame:
    """(key, doc_id, first, last, length, head, tail): the shortest windows of min_words words from and up to each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, SLICE):
            out: list[list] = [[] for _ in range(7)]
            for key, doc_id, lines, words, ranks in zip(*(c.to_pylist() for c in batch.columns)):
                n, spans = len(lines), set()
                end = total = 0
                for start in range(n):  # from each line
                    while end < n and total < min_words:
                        total += words[end]
                        end += 1
                    if total < min_words:
                        break
                    spans.add((start, end))
                    total -= words[start]
                start = total = 0
                for end in range(1, n + 1):  # up to each line
                    total += words[end - 1]
                    while total - words[start] >= min_words:
                        total -= words[start]
                        start += 1
                    if total >= min_words:
                        spans.add((start, end))
                for a, b in sorted(spans):
                    level = (b - a).bit_length() - 1
                    for to, value in zip(out, (key, doc_id, lines[a], lines[b - 1], b - a, ranks[level][a], ranks[level][b - (1 << level)])):
                        to.append(value)
            types = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=["key", "doc_id", "first", "last", "length", "head", "tail"])

    return found.select("key", "doc_id", "lines", "words", "ranks").mapInArrow(run, "key binary, doc_id long, first int, last int, length int, head long, tail long")


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, spans): for each document with later copies, the spans (first, last) of lines that go."""
    found = segments(docs, min_words)
    # the most lines that a shortest window may have; one number, at most min_words
    longest = found.select(F.max(F.size("lines")).alias("n")).first()["n"] or 0
    levels = max(0, min(longest, min_words).bit_length() - 1)
    if not longest:
        return found.select("key", F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("last"))).alias("spans"))
    spans = cut(windows(doubled(found, levels), min_words))
    place = F.struct(F.col("doc_id").isNotNull(), "doc_id", "key", "first")
    kept = spans.groupBy("length", "head", "tail").agg(F.min(place).alias("kept"), F.count("*").alias("n")).where("n > 1")
    later = hot_join(spans, cut(kept), ["length", "head", "tail"]).where(place != F.col("kept"))
    return later.groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the later copies of runs of at least min_words words taken out of text, and n_lines, removed_lines
    and removed (array of the first and last numbers of lines that went)."""
    names = [c for c in docs.columns if c not in RESULTS]
    done = _deduped(docs.select(*map(quoted, names)), min_words)
    return done.select(*[F.col("row")[c].alias(c) for c in names], *RESULTS)


def cleaned(docs: DataFrame, min_words: int = MIN_WORDS, length: str | None = None) -> DataFrame:
    """The rows of docs, whatever their columns' names, without later copies; those of which nothing is left go. length
    names a column that holds the number of characters of text, which is counted again where lines went."""
    text = F.col("row")["text"]
    done = _deduped(docs, min_words).where((F.col("removed_lines") == 0) | text.rlike(r"\S"))
    values = {c: F.col("row")[c] for c in docs.columns}
    if length in values:
        values[length] = F.when(F.col("removed_lines") > 0, F.length(text)).otherwise(values[length]).cast(docs.schema[length].dataType)
    return done.select(*[values[c].alias(c) for c in docs.columns])


def without(text: str | None, spans: list[dict] | None) -> tuple[str | None, int | None, int, list[dict]]:
    """(text, n_lines, removed_lines, removed): a text without some spans of lines, and what went."""
    if not spans:
        return text, None if text is None else text.count("\n") + 1, 0, []
    lines, merged = text.split("\n"), []
    for a, b in sorted((s["first"], s["last"]) for s in spans):
        # with only blank lines between two spans, those go too
        if merged and (a <= merged[-1][1] + 1 or not any(x.strip() for x in lines[merged[-1][1] + 1 : a])):
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    rest, done = [], 0
    for a, b in merged:
        rest += lines[done:a]
        done = b + 1
    rest += lines[done:]
    return "\n".join(rest), len(lines), sum(b - a + 1 for a, b in merged), [{"first": a, "last": b} for a, b in merged]


def _deduped(docs: DataFrame, min_words: int) -> DataFrame:
    """(row, n_lines, removed_lines, removed): row has the columns of docs, its text being without later copies."""
    later = cut(later_copies(docs, min_words))
    own = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), text_key("doc_id", "text").alias("key"))
    # only documents that may have later copies are shuffled
    own = maybe_in(own, later, "key")
    some = own.where("_maybe").join(later, "key", "left").select("row", "spans")
    joined = own.where("not _maybe").select("row", F.lit(None).cast(later.schema["spans"].dataType).alias("spans")).union(some)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for part in sliced(batches, SLICE):
            # the text changes place with the new one, so that a row never holds both
            fields, columns = list(part.column(0).type), part.column(0).flatten()
            out = [list(x) for x in zip(*(without(*own) for own in zip(columns[at].to_pylist(), part.column(1).to_pylist())))]
            columns[at] = pa.array(out[0], fields[at].type)
            types = (pa.int32(), pa.int32(), span)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, fields=fields), *(pa.array(v, t) for v, t in zip(out[1:], types))], names=["row", *RESULTS])

    span = T.StructType([T.StructField(c, T.IntegerType()) for c in ("first", "last")])
    results = (T.IntegerType(), T.IntegerType(), T.ArrayType(span))
    return joined.mapInArrow(run, T.StructType([joined.schema["row"], *(T.StructField(c, t) for c, t in zip(RESULTS, results))]))
