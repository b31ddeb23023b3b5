"""N-gram Jaccard join: brute force, crowded buckets, balls, shortening of prefixes."""

import random

import numpy as np
import pytest
from nearfield.llm import jaccard

DATA = "/root/testdata"


def brute(texts):
    """(links of each document, least id of its group) by comparing all pairs."""
    sets = [(d, jaccard.shingles(t)) for d, t in texts]
    links, parent = {d: 0 for d, _ in sets}, {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if min(len(s), len(t)) * 1.25 >= max(len(s), len(t)) and len(s) and (n := len(np.intersect1d(s, t, assume_unique=True))) * 1.8 >= 0.8 * (len(s) + len(t)):
                links[a], links[b] = links[a] + 1, links[b] + 1
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return links, {d: root(d) for d in parent}


def crowd(r, n, changes, size=120, start=10_000):
    """Texts that are each one text with some words changed."""
    base = [f"w{i}" for i in range(size)]
    found = []
    for i in range(n):
        words = list(base)
        for _ in range(changes if isinstance(changes, int) else r.choice(changes)):
            words[r.randrange(size)] = f"x{i}"
        found.append((start + i, " ".join(words)))
    return found


def joined(spark, texts, **options):
    rows = jaccard.join(spark.createDataFrame(texts, "doc_id long, text string").repartition(6), **options).collect()
    return {x["doc_id"]: x["n_links"] for x in rows}, {x["doc_id"]: x["group_id"] for x in rows}


def test_a_table_and_a_crowd(spark):
    texts = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()] + crowd(random.Random(5), 700, 1)
    links, groups = brute(texts)
    got, named = joined(spark, texts)
    assert named == groups and all(got[d] <= links[d] for d in got)
    assert sum(got.values()) >= jaccard.RECALL * sum(links.values())


@pytest.mark.parametrize("changes", [1, (0, 1, 2, 3), (1, 6)])
def test_crowded_buckets_with_balls(spark, monkeypatch, changes):
    monkeypatch.setattr(jaccard, "CROWDED", 40)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    texts = crowd(random.Random(2), 150, changes) + crowd(random.Random(3), 60, 1, 40, 20_000) + [(1, "some other text of a few words"), (2, None), (3, "")]
    links, groups = brute(texts)
    got, named = joined(spark, texts)
    assert named == groups and all(got[d] <= links[d] for d in got)
    assert sum(got.values()) >= jaccard.RECALL * sum(links.values())


def test_balls_hold_only_links(spark):
    texts = crowd(random.Random(4), 80, (1, 2, 4, 8))
    sets = [jaccard.shingles(t) for _, t in texts]
    rows = spark.createDataFrame([(0, i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "bucket long, class long, grams binary")
    found = jaccard.balls(rows, spark.createDataFrame([(0, 80)], "bucket long, size long"), 0.8).collect()
    assert len(found) > 10 and len({x["ball"] for x in found}) == 1
    for x in found:
        for y in found:
            n = len(np.intersect1d(sets[x["class"]], sets[y["class"]], assume_unique=True))
            assert n / (len(sets[x["class"]]) + len(sets[y["class"]]) - n) >= 0.8


def test_recall_on_a_table(spark):
    texts = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()]
    links, groups = brute(texts)
    got, named = joined(spark, texts)
    assert sum(links.values()) > 100 and sum(got.values()) >= jaccard.RECALL * sum(links.values())
    assert all(got[d] <= links[d] for d in got) and named == groups


def test_prefixes_are_shortened_until_the_recall():
    r = random.Random(8)
    texts = crowd(r, 40, 1) + crowd(r, 3, 8, 120, 20_000)
    sets = [jaccard.shingles(t) for _, t in texts]
    floor = jaccard.floor_depth()
    assert jaccard.chance(0.8, floor, jaccard.TREES) >= jaccard.RECALL > jaccard.chance(0.8, floor + 1, jaccard.TREES)
    labels = np.stack([jaccard.prefixes(s, jaccard.TREES, jaccard.DEPTH, floor) for s in sets])
    deep = np.stack([jaccard.further(s, jaccard.TREES, jaccard.DEPTH, floor) for s in sets])
    block = jaccard.Block(sets, labels, deep, np.zeros(len(sets), int), floor)
    every = np.arange(len(sets))
    i, j = block.candidates(np.arange(jaccard.TREES), every, every, 0.8)
    i, j = i[i < j], j[i < j]
    depths = block.depths(i, j)
    assert depths.min() >= floor and depths.max() == jaccard.DEPTH
    for x, y, d in list(zip(i, j, depths))[::17]:
        own = [floor + next((n for n in range(jaccard.DEPTH - floor) if deep[x, t, n] != deep[y, t, n]), jaccard.DEPTH - floor) for t in range(jaccard.TREES) if labels[x, t] == labels[y, t]]
        assert d == max(own)
    loose, tight = block.links(i, j, 0.8, 0.9), block.links(i, j, 0.8, 1.0)
    truth = {(x, y) for x, y in zip(i, j) if len(np.intersect1d(sets[x], sets[y])) * 1.8 >= 0.8 * (len(sets[x]) + len(sets[y]))}
    assert set(zip(*tight)) == truth and set(zip(*loose)) <= truth and len(loose[0]) >= 0.9 * len(truth)


def test_representatives_keep_every_column(spark):
    texts = crowd(random.Random(6), 5, 1) + [(10_000, "the same id with another text than the first one has"), (None, "no id"), (None, "no id"), (7, ""), (8, "")]
    rows = spark.createDataFrame([(d, t, i, str(i), "k", 1) for i, (d, t) in enumerate(texts)], "doc_id long, text string, `a b` int, row_key string, group string, n_links int")
    got = jaccard.representatives(rows)
    assert got.columns == rows.columns
    kept = sorted((x["doc_id"] or -1, x["text"]) for x in got.collect())
    assert kept == sorted([(10_000, texts[0][1]), (10_000, texts[5][1]), (-1, "no id"), (7, ""), (8, "")])
