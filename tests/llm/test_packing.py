"""Packing: the query's rows against the tokenizer, plans against brute force and best fit."""

import itertools
import zlib

import numpy as np
import pytest
from nearfield.llm import catalogue, packing
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def cuts(n, capacity=1024):
    """(start, length): whole if it fits, else full pieces behind a first one that may be shorter."""
    first = n % capacity or capacity
    return [(0, n)] if n <= capacity else [(0, first)] + [(a, capacity) for a in range(first, n, capacity)]


def test_query_rows_are_the_documents_ids(spark):
    model, wanted = tokenizer(), []
    for x in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        ids = model.encode(x["text"] or "", add_special_tokens=False).ids + [2]
        for i, (a, n) in enumerate(cuts(len(ids))):
            wanted.append((x["doc_id"], i, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())))
    rows = catalogue.op2_pack(spark, DATA).collect()
    assert sorted((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in rows) == sorted(wanted)
    ends = {}
    for x in sorted(rows, key=lambda x: (x["sequence_id"], x["offset"])):
        assert x["offset"] == ends.get(x["sequence_id"], 0)
        ends[x["sequence_id"]] = x["offset"] + x["length"]
    assert max(ends.values()) <= 1024
    assert len(ends) <= -(-sum(n for *_, n, _ in wanted) // 1024) + 1


def test_names_of_added_tokens_are_the_tokenizer_s():
    model, words = tokenizer(), packing.text_ids(packing.tokenizer_path())
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "|endoftext|> <|", " <|endoftext|>\n\n <|endoftext|>  x ", "é<|endoftext|>é"]
    for text in texts:
        assert np.frombuffer(words.text(text), "<u4").tolist() == model.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("balanced", [False, True])
def test_fill_finds_a_sum_where_there_is_one(balanced):
    rng = np.random.default_rng(5)
    for _ in range(60):
        counts = rng.integers(0, 3, 25) * rng.integers(0, 2, 25)
        counts[0] = 0
        sums = packing.Sums(counts, balanced)
        counts = np.maximum(counts - rng.integers(0, 2, 25), 0)  # some are used up since
        items = [n for n in range(25) for _ in range(counts[n])]
        able = {sum(c) for k in (1, 2, 3) for c in itertools.combinations(items, k)}
        for gap in range(25):
            found = sums.fill(gap, counts)
            assert (found is not None) == (gap in able)
            assert found is None or (sum(found) == gap and (np.bincount(found, minlength=25) <= counts).all())


def test_plans_of_tables_are_no_worse_than_best_fit(spark):
    fewer = 0
    for sf in ("sf0.001", "sf0.01"):
        counts = np.zeros(1025, int)
        for n, rows in packing.pieces(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).groupBy("length").count().collect():
            counts[n] = rows
        found, left = packing.exact_first(counts, 0)
        assert sum(t for t, _ in found) and sum(left) == 0
        fewer += sum(t for t, _ in packing.best_fit(counts)) - sum(t for t, _ in packing.plan(counts))
    assert fewer >= 0


def test_one_length_in_many_buckets(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "one two").otherwise("one two three").alias("text"))
    ends = {}
    for x in sorted(packing.pack(rows).collect(), key=lambda x: (x["sequence_id"], x["offset"])):
        assert x["offset"] == ends.get(x["sequence_id"], 0)
        ends[x["sequence_id"]] = x["offset"] + x["length"]
    assert max(ends.values()) <= 1024 and len(ends) == -(-sum(ends.values()) // 1024)
