"""Cells: block kernels against brute force, and what leaves and enters a task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import distances as D
from nearfield.operators import graph, inverted, kernels, sat, search, select


def table(spark, x, key="id", kind="float"):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, f"{key} long, v array<double>").withColumn("v", F.col("v").cast(f"array<{kind}>")).repartition(5)


def brute(dist, q, x, k):
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.array([dist.rows(np.repeat(row[None], len(x), 0), x) if dist.rows else dist.block(row[None], x)[0] for row in q])
    return {i: np.lexsort((np.arange(len(x)), row))[:k].tolist() for i, row in enumerate(d)}


@pytest.mark.parametrize("name", ["l2", "sql2", "cosine", "normangle", "l1"])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_cells_are_exact(spark, name, kind, monkeypatch):
    # several groups of either side, several tiles; copies, far-off and zero vectors
    monkeypatch.setattr(kernels, "WORTH", {True: 1 << 14, False: 1 << 14})
    monkeypatch.setattr(kernels, "HELD", 1 << 14)
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (700, 8)).astype(np.float32).astype(np.float64)
    x[100:200], x[650] = x[:100], 0
    if name in ("l2", "sql2"):
        x = (x + 1000).astype(np.float32).astype(np.float64)
    dist = D.VECTORS[name]
    got = {}
    for r in search.knn(table(spark, x[:300], "qid", kind), table(spark, x, "id", kind), dist, 6).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    assert got == brute(dist, x[:300], x, 6)


def test_a_cell_leaves_k_hits_a_query(spark):
    # a block of objects used to leave k hits a query, so that hits grew with the square of the rows
    x = np.random.default_rng(2).normal(0, 1, (6000, 4))
    e = table(spark, x)
    assert kernels.hits(e.withColumnRenamed("id", "qid"), e, D.L2, 3).count() <= 3 * 6000 * 8


def test_few_centers_copy_no_objects(spark):
    # objects used to be copied to every slot and met few centers in one
    e = table(spark, np.random.default_rng(2).normal(0, 1, (2000, 4)))
    rows = kernels.hits(e.withColumnRenamed("id", "qid"), e.where("id < 16"), D.L2, 1)
    assert rows.count() == 2000


def test_wide_hits_come_in_pieces(spark):
    dist = D.L2
    x = np.random.default_rng(2).normal(0, 1, (3000, 4))
    sizes = [len(d) for _, _, d in kernels.met(dist, x[:1000], np.full(1000, np.inf), np.arange(3000), x, None)]
    assert sum(sizes) == 3_000_000 and max(sizes) <= kernels.CHUNK


def test_queries_with_bounds_of_their_own(spark):
    x = np.random.default_rng(3).normal(0, 1, (400, 4))
    q = table(spark, x[:40], "qid").withColumn("k", F.when(F.col("qid") % 2 == 0, 3)).withColumn("radius", F.when(F.col("qid") % 3 == 0, 1.0))
    got = {}
    for r in search.mixed(q, table(spark, x), D.L2).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    x = x.astype(np.float32).astype(np.float64)
    for i in range(40):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(400), d)) if i % 3 or d[j] <= 1.0]
        assert got[i] == (order[:3] if i % 2 == 0 else order)


@pytest.mark.parametrize("name", ["bits_hamming", "bits_russellrao", "bits_rogerstanimoto"])
def test_bit_kernels(spark, name):
    # every pair used to be computed by an interpreted expression and sorted
    rng = np.random.default_rng(4)
    rows = [(i, [int(a) for a in rng.integers(-(2**63), 2**63 - 1, 2)]) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    both = df.alias("a").join(df.alias("b"), F.lit(True)).select(F.col("a.id").alias("qid"), F.col("b.id").alias("id"), D.BITS[name](F.col("a.v"), F.col("b.v")).alias("dist"))
    want = {(r["qid"], r["rank"]): (r["id"], r["dist"]) for r in search.ranked(both, 7).collect()}
    assert D.BITS[name].block is not None
    assert {(r["qid"], r["rank"]): (r["id"], r["dist"]) for r in search.knn(df.withColumnRenamed("id", "qid"), df, D.BITS[name], 7).collect()} == want


def test_whole_numbers_are_exact(spark):
    assert D.DOT.product is not None
    x = np.random.default_rng(4).integers(0, 256, (200, 16))
    df = spark.createDataFrame([(i, [int(c) for c in v]) for i, v in enumerate(x)], "id long, v array<int>")
    got = {(r["qid"], r["rank"]): (r["id"], r["dist"]) for r in search.knn(df.withColumnRenamed("id", "qid"), df, D.DOT, 5).collect()}
    for i in range(200):
        d = -(x @ x[i])
        assert [got[i, n + 1] for n in range(5)] == [(j, d[j]) for j in np.lexsort((np.arange(200), d))[:5]]


def test_small_slots_are_not_merged(spark):
    # slots used to be merged by size, so that all pairs met in a few tasks
    e = spark.range(100).select("id", F.col("id").alias("v"))
    assert search.pairs(e.withColumnRenamed("id", "qid"), e).select(F.spark_partition_id().alias("p")).distinct().count() > 3


@pytest.mark.parametrize("kind", ["cosine", "normcosine", "angle", "normangle"])
def test_sparse_cells_are_exact(spark, kind, monkeypatch):
    # joins by term used to make a row for each pair and term shared
    monkeypatch.setattr(inverted, "HELD", 8 * 8 * 60)
    monkeypatch.setattr(inverted, "OWN", 6)
    monkeypatch.setattr(inverted, "SPARSE_TILE", (16, 64))
    rng = np.random.default_rng(6)
    w = np.where(rng.random((200, 40)) < 0.15, rng.integers(1, 4, (200, 40)), 0).astype(float)
    w[150:170], w[:, :2] = w[10:30], np.where(rng.random((200, 2)) < 0.9, 1, w[:, :2])
    df = spark.createDataFrame([(i, f"t{t}", float(w[i, t])) for i in range(200) for t in np.flatnonzero(w[i])], "id long, term string, w double")
    own = select.cut(inverted.normalised(df) if kind.startswith("norm") else df)
    got = {}
    for r in inverted.sparse_search(own.where("id % 4 = 0"), own, kind, 5).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["id"], round(r["dist"], 9)))
    dot = np.round((w @ w.T) / np.outer(np.linalg.norm(w, axis=1), np.linalg.norm(w, axis=1)), 12)
    d = 1 - dot if "cosine" in kind else np.arccos(np.clip(dot, -1, 1))
    for i in range(0, 200, 4):
        shared = [j for j in np.lexsort((np.arange(200), d[i])) if (w[i] * w[j]).any()][:5]
        assert [g[1] for g in got[i]] == [round(d[i, j], 9) for j in shared]
        if kind != "cosine":
            assert [g[0] for g in got[i]] == shared


def test_graphs_are_stored(spark):
    # each round of a search used to build its graph anew
    e = table(spark, np.random.default_rng(2).normal(0, 1, (100, 4)))
    assert "ExistingRDD" in graph.build(e, D.L2)._jdf.queryExecution().toString()
    both = graph.reverse_links(spark.range(5).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    assert both._jdf.queryExecution().optimizedPlan().toString().count("Range") == 1 and both.count() == 10


def test_edit_distances_of_blocks(spark):
    rng = np.random.default_rng(8)
    words = ["", "é", "ab"] + ["".join(rng.choice(list("abcé"), n)) for n in (1, 3, 63, 64, 65, 90, 128, 129, 130, 200)] * 2
    df = spark.createDataFrame(list(enumerate(words)), "id long, v string")
    assert (D.edit_block(*[np.array([[1, 5, *[-1] * 99]])] * 2) == 0).all()  # much padding
    want = {(r["qid"], r["id"]): r["dist"] for r in search.knn_expression(df.withColumnRenamed("id", "qid"), df, D.SEQS["levenshtein"], 99).collect()}
    got = {(r["qid"], r["id"]): r["dist"] for r in search.knn_sequences(df.withColumnRenamed("id", "qid"), df, 99).collect()}
    assert got == want and len(got) == len(words) ** 2


def test_sparse_with_dense_makes_no_row_a_term(spark):
    dense = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [0.0, -1.0, 0.5])], "qid long, v array<double>")
    sparse = spark.createDataFrame([(7, 0, 2.0), (7, 2, 1.0), (7, 2, 1.0), (8, 1, 4.0), (9, 5, 1.0)], "id long, term long, w double")
    got = inverted.sparse_dense_dot(sparse, dense)
    assert {(r["qid"], r["id"], r["dot"]) for r in got.collect()} == {(1, 7, 8.0), (1, 8, 8.0), (2, 7, 1.0), (2, 8, -4.0)}
    assert "posexplode" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("block, own", [(None, True), (16, True), (16, False)])
def test_nets_make_no_list_of_all_links(spark, block, own, monkeypatch):
    # all pairs within epsilon used to be listed: of copies, the square of their number
    monkeypatch.setattr(select, "ROUND", 50)
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (300, 3))
    x[200:260] = x[3]
    e = table(spark, x, kind="double")
    links = search.within(e.select(F.col("id").alias("qid"), "v"), e, D.L2, 0.6)
    same = lambda df: sorted((r["id"], r["nn"], r["kept"], round(r["dist"], 9)) for r in df.collect())
    assert same(select.near_duplicates(e, D.L2, 0.6, block, own)) == same(select.near_duplicates(e, D.L2, 0.6, block, own, links=links))


def test_trees_are_searched_by_subtrees(spark, monkeypatch):
    # an exact search used to pass on the vectors of every pair, level by level
    monkeypatch.setattr(sat, "LIMIT", 40)
    e = table(spark, np.random.default_rng(7).normal(0, 1, (300, 5)))
    tree = sat.build(e, D.L2, parts=2)
    parent = {r["id"]: r["parent"] for r in tree.collect()}
    depth, own = sat.subtrees(tree)
    at = {r["id"]: r["depth"] for r in tree.collect()}
    for r in own.collect():
        top = r["id"]
        while at[top] > depth:
            top = parent[top]
        assert top == r["center"]
    assert own.count() == sum(d >= depth for d in at.values())
    rows = lambda df: {(r["qid"], r["rank"]): r["id"] for r in df.collect()}
    q = e.where("id % 10 = 0").withColumnRenamed("id", "qid")
    assert rows(sat.search(q, tree, D.L2, 5)) == rows(search.knn(q, e, D.L2, 5))
