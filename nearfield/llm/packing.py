"""Best-fit packing of token pieces into sequences, planned on the histogram of piece lengths.

Documents are tokenised once, in Arrow batches; only (document, piece, length, checksum) rows go on. The plan needs no
more than the count of every length, of which there are at most `capacity`, so planning costs the same for any corpus.
Exact complements come first: single, pair and triple sums of lengths are indexed, and for each length, from the longest,
combinations that fill its gap exactly are looked up and consumed under the available counts; where none is left, the
best fit goes in and its residual gap is looked up in turn. Best fit packs the residual, the lengths below a bound, for
which the plan with the fewest sequences is taken. A plan is a list of patterns with multiplicities, a few for each
length. Pieces take their place by their rank within their length; ranks are counted over (length, hash bucket) totals,
in number the square root of the length's pieces, so that no length's rows meet in one task.

Ids are the tokenizer's own: a text that holds the name of an added token goes to the tokenizer itself.

Cases: null text is empty and gives one piece, the end token; other columns are ignored; rows with equal doc_id are
separate documents, and rows that are wholly equal are interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, sliced

CAPACITY = 1024
END = 2
#: Lengths, evenly spread, at which a plan may go over from exact complements to best fit.
STEPS = 16
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 as itself, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class TextIds:
    """Little-endian ids of texts. The vocabulary is the tokenizer file's; texts are merged by a second implementation of
    byte-pair merging over it, whose ids are equal (tests hold them against the first) and which takes less time."""

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        symbols = byte_symbols()
        # added tokens take part in no merge
        self.added = [own["content"] for own in whole["added_tokens"] if own["content"]]
        self.path, self.whole = path, None
        ranks = {bytes([symbols[c] for c in token]): i for token, i in whole["model"]["vocab"].items() if token not in self.added}
        self.model = tiktoken.Encoding("texts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def text(self, text: str) -> bytes:
        if not any(own in text for own in self.added):
            return np.asarray(self.model.encode_ordinary(text), dtype="<u4").tobytes()
        if self.whole is None:  # rarely needed, and large
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


_MODELS: dict[str, TextIds] = {}


def text_ids(path: str) -> TextIds:
    """The worker's own tokenizer."""
    if path not in _MODELS:
        _MODELS[path] = TextIds(path)
    return _MODELS[path]


def cut_lengths(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only longer documents are cut; the first piece takes the remainder."""
    first = total % capacity or min(total, capacity)
    starts = [0, *range(first, total, capacity)]
    return [(a, (first if a == 0 else capacity)) for a in starts]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, ids: bool = False) -> DataFrame:
    """Every piece of every document: SCHEMA, and its ids (little-endian bytes) if wanted."""
    path = path or tokenizer_path()
    last = int(end).to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = text_ids(path)
        for part in sliced(batches, 512):
            rows: list[list] = [[], [], [], [], []]
            raw = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                data = model.text(text or "") + last
                for i, (start, length) in enumerate(cut_lengths(len(data) // 4, capacity)):
                    own = data[4 * start : 4 * (start + length)]
                    for to, value in zip(rows, (doc_id, i, start, length, zlib.crc32(own))):
                        to.append(value)
                    if ids:
                        raw.append(own)
            arrays = [pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(raw, pa.binary())] * ids, names=names + ["ids"] * ids)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, SCHEMA + ", ids binary" * ids)


class Sums:
    """Index of the sums of one, two and three lengths, for looking up what fills a gap exactly.

    Pair sums are hashed to their lesser lengths; a triple sum to a length and the pair sum that it leaves. A lookup
    takes the fewest lengths, and of those the longest first or, if balanced, the least uneven, which spares short ones.
    """

    def __init__(self, counts: np.ndarray, balanced: bool = False):
        self.lengths = np.flatnonzero(counts)
        self.balanced = balanced
        one, two = (self.lengths[i] for i in np.triu_indices(len(self.lengths)))
        fits = one + two < len(counts)
        one, sums = one[fits], (one + two)[fits]
        order = np.lexsort((one, sums))
        one, sums = one[order], sums[order]
        at = np.flatnonzero(np.diff(sums, prepend=-1))
        self.pairs = dict(zip(sums[at].tolist(), np.split(one, at[1:]))) if len(at) else {}

    def pair(self, total: int, counts: np.ndarray) -> tuple[int, int] | None:
        low = self.pairs.get(total)
        if low is None:
            return None
        at = np.flatnonzero((counts[low] > 0) & (counts[total - low] > 0) & ((2 * low != total) | (counts[low] > 1)))
        if not len(at):
            return None
        own = int(low[at[-1 if self.balanced else 0]])
        return total - own, own

    def fill(self, gap: int, counts: np.ndarray) -> tuple[int, ...] | None:
        """One, two or three available lengths whose sum is the gap."""
        if gap <= 0:
            return None
        if counts[gap]:
            return (gap,)
        if found := self.pair(gap, counts):
            return found
        able = self.lengths[(self.lengths <= gap - 2) & (counts[self.lengths] > 0)]
        for third in able[np.argsort(np.abs(3 * able - gap), kind="stable")] if self.balanced else able[::-1]:
            counts[third] -= 1
            found = self.pair(int(gap - third), counts)
            counts[third] += 1
            if found:
                return (int(third), *found)
        return None


def exact_first(counts: np.ndarray, until: int = 0, balanced: bool = False) -> tuple[list[tuple[int, tuple[int, ...]]], np.ndarray]:
    """(multiplicity, lengths) patterns for the pieces longer than `until`, from the longest, and the counts left over:
    exact complements of a gap first, and where there is none the best fit, whose residual gap is looked up again.

    Each pattern uses up one length at least, or is followed by one that does.
    """
    capacity = len(counts) - 1
    counts = counts.astype(np.int64).copy()
    counts[0] = 0
    sums = Sums(counts, balanced)
    found: list[tuple[int, tuple[int, ...]]] = []

    def take(pattern: tuple[int, ...]) -> None:
        used = np.bincount(pattern, minlength=capacity + 1)
        at = np.flatnonzero(used)
        times = int((counts[at] // used[at]).min())
        counts[at] -= times * used[at]
        found.append((times, pattern))

    for length in range(capacity, until, -1):
        while counts[length]:
            pattern, gap, left, rest = [length], capacity - length, counts.copy(), None
            left[length] -= 1
            while gap > 0 and (rest := sums.fill(gap, left)) is None and len(at := np.flatnonzero(left[: gap + 1])):
                # no exact complement: the best fit, whose own gap may have one
                pattern.append(int(at[-1]))
                left[at[-1]] -= 1
                gap -= int(at[-1])
            take((*pattern, *(rest or ())))
    return found, counts


def best_fit(counts: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns of all pieces, from the longest, each into the least gap that holds it; equal sequences are one pattern."""
    capacity = len(counts) - 1
    by_gap: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            gap = next((g for g in range(length, capacity + 1) if by_gap.get(g)), None)
            if gap is None:  # new sequences, as many of this length in each as fit
                each = min(capacity // length, left)
                times, pattern = left // each, (length,) * each
                left -= times * each
            else:
                times, pattern = by_gap[gap].pop()
                if times > left:
                    by_gap[gap].append((times - left, pattern))
                    times = left
                left -= times
                pattern = (*pattern, length)
            by_gap.setdefault(capacity - sum(pattern), []).append((times, pattern))
    return [pattern for own in by_gap.values() for pattern in own]


def plan(counts: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """(multiplicity, lengths) patterns that use every piece; counts: pieces by length, up to the capacity.

    Exact complements come first, best fit packs the residual. Of STEPS lengths at which one may give way to the other
    and two orders of complements, the plan with the fewest sequences is taken, ties to the one with most complements;
    one without waste ends the search.
    """
    capacity = len(counts) - 1
    least = -(-int((np.arange(capacity + 1) * counts).sum()) // capacity)
    best, fewest = [], None
    for step in range(STEPS):
        for balanced in (False, True):
            found, left = exact_first(counts, capacity * step // STEPS, balanced)
            found += best_fit(left)
            total = sum(times for times, _ in found)
            if fewest is None or total < fewest:
                best, fewest = found, total
            if fewest <= least:
                return best
    return best


def assign(cut_up: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut_up (the columns of SCHEMA) with sequence_id and offset. cut_up must not change when it is read again."""
    spark = cut_up.sparkSession
    # at most `capacity` rows
    totals = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # n pieces of a length fall into sqrt(n) buckets of sqrt(n), so that neither a bucket nor their totals are many rows
    buckets = F.array(*[F.lit(math.isqrt(totals.get(length, 0)) + 1) for length in range(1, capacity + 1)])
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start"), F.element_at(buckets, F.col("length").cast("int")))
    placed = cut_up.withColumn("bucket", bucket.cast("int"))
    per_bucket = placed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in totals.items():
        counts[length] = n
    # by length, runs of ranks: (first rank, first sequence, pieces of this length a sequence, offset of the first)
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used = np.zeros(capacity + 1, dtype=np.int64)
    sequence = 0
    for times, pattern in plan(counts):
        offset = 0
        lengths = sorted(set(pattern), reverse=True)
        for length in lengths:
            each = pattern.count(length)
            runs.setdefault(length, []).append((int(used[length]), sequence, each, offset))
            used[length] += times * each
            offset += each * length
        sequence += times
    table = spark.sparkContext.broadcast({k: np.array(v, dtype=np.int64) for k, v in runs.items()})
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "bucket", "before")
    inside = Window.partitionBy("length", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "piece", "ids_crc32", "start")
    ranked = placed.withColumn("inside", F.row_number().over(inside) - 1).join(offsets, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("inside") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            to, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for one in np.unique(length):
                at = np.flatnonzero(length == one)
                run = table.value[int(one)]
                own = run[np.searchsorted(run[:, 0], rank[at], side="right") - 1]
                nth = rank[at] - own[:, 0]
                to[at], offset[at] = own[:, 1] + nth // own[:, 2], own[:, 3] + nth % own[:, 2] * one
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(to), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, SCHEMA + ", sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Every piece with its place: SCHEMA, sequence_id, offset."""
    return assign(cut(pieces(docs, path, capacity, end)), capacity)


def sequences(docs: DataFrame, placed: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(sequence_id, doc_ids, input_ids) of every sequence, made from the documents and their pieces' places."""
    own = pieces(docs, path, capacity, end, ids=True)
    keys = ["piece", "start", "length", "ids_crc32"]
    nth = Window.partitionBy("doc_id", *keys).orderBy(F.lit(0))
    own, placed = own.withColumn("nth", F.row_number().over(nth)), placed.withColumn("nth", F.row_number().over(nth))
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "nth"]]
    both = own.alias("a").join(placed.alias("b"), [F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), *same])
    parts = both.groupBy("b.sequence_id").agg(F.sort_array(F.collect_list(F.struct("b.offset", "a.doc_id", "a.ids"))).alias("parts"))

    def ids(batches):
        for batch in batches:
            joined = [np.frombuffer(b"".join(p["ids"] for p in row), "<u4").astype(np.int32) for row in batch.column(1).to_pylist()]
            owners = [[p["doc_id"] for p in row] for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(owners, pa.list_(pa.int64())), pa.array(joined, pa.list_(pa.int32()))], names=["sequence_id", "doc_ids", "input_ids"])

    return parts.mapInArrow(ids, "sequence_id long, doc_ids array<long>, input_ids array<int>")
