"""Operators against brute force: quantiles, joins, searches, sequences, graphs, trees, stores and the command line."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield import cli
from nearfield.functions import distances as D
from nearfield.functions import vectors as V
from nearfield.operators import evaluate, graph, inverted, joins, sat, search, select
from nearfield.plans import catalogue
from nearfield.sources import tables
from nearfield.streaming import ingest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def e(spark):
    return select.cut(catalogue.vectors(spark, DATA))


@pytest.fixture(scope="module")
def edges(e):
    return select.cut(graph.build(e, D.L2))


@pytest.fixture(scope="module")
def dense(e):
    rows = sorted((r["id"], r["v"]) for r in e.collect())
    return np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)


def hits(df):
    return sorted((r["qid"], r["id"], round(r["dist"], 9)) for r in df.collect())


@pytest.mark.parametrize("at, group", [(0.0, 9), (0.3, 200), (0.5, 9), (0.9, 9), (0.9, 10**6), (1.0, 9)])
def test_quantiles(spark, at, group, monkeypatch):
    monkeypatch.setattr(evaluate, "GROUP", group)
    rng = np.random.default_rng(3)
    values = {g: np.round(rng.normal(0, 2, n), 1) for g, n in ((1, 1), (2, 2), (3, 500), (4, 37))}
    values[5] = np.zeros(200)
    df = spark.createDataFrame([(g, float(x)) for g, v in values.items() for x in v] + [(1, None)], "g long, x double").repartition(5)
    got = {r["g"]: (r["n"], r["quantile"]) for r in evaluate.quantiles(df, "x", at, "g").collect()}
    assert {g: n for g, (n, _) in got.items()} == {g: len(v) for g, v in values.items()}
    assert all(got[g][1] == pytest.approx(np.quantile(v, at)) for g, v in values.items())
    assert evaluate.quantiles(df, "x", at).first()["quantile"] == pytest.approx(np.quantile(np.concatenate(list(values.values())), at))
    assert evaluate.quantiles(df.limit(0), "x", at).collect() == [] and evaluate.describe(df.limit(0), "x").first()["median"] is None


def test_kernel_is_exact_near_ties(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(0, 1e6, 8)
    rows = [(i, [float(x) for x in base + rng.integers(0, 3, 8) * 1e-6]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    x = np.array([v for _, v in rows])
    got = {}
    for r in search.allknn(df, D.L2, 4).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"]))
    for i in range(300):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        assert [j for _, j in sorted(got[i])] == np.lexsort((np.arange(300), d))[:4].tolist()


def test_pivot_searches_are_exact(e):
    q, centers = catalogue.asked(e), select.random_centers(e, 12, 2)
    own = select.cut(search.baskets_of(e, centers, D.L2))
    assert hits(search.pivot_search(q, e, centers, D.L2, 7, baskets=own)) == hits(search.knn(q, e, D.L2, 7))
    assert hits(search.pivot_within(q, e, centers, D.L2, 1.25, own)) == hits(search.within(q, e, D.L2, 1.25))
    text = e.sparkSession.createDataFrame([(i, w) for i, w in enumerate(["abc", "abd", "xyz", "xya", "bcd", "q", "abcd"])], "id long, v string")
    by_words = search.pivot_search(text.withColumnRenamed("id", "qid"), text, text.where("id < 3"), D.SEQS["levenshtein"], 2)
    assert hits(by_words) == hits(search.knn(text.withColumnRenamed("id", "qid"), text, D.SEQS["levenshtein"], 2))
    with pytest.raises(ValueError, match="metric"):
        search.pivot_within(q, e, centers, D.NORMCOSINE, 0.5)


def test_batches_of_queries(e):
    assert search.search_batch(catalogue.asked(e), e, D.L2, 3, expected=catalogue.asked(e).count()).count() == 3 * catalogue.asked(e).count()
    for own, expected in ((catalogue.asked(e).limit(0), None), (catalogue.asked(e), 10**6)):
        with pytest.raises(ValueError, match="quer"):
            search.search_batch(own, e, D.L2, 3, expected)


def test_metric_self_join_and_its_fallback(e, dense):
    ids, x = dense
    got = joins.metric_join(e, e, D.L2, 5, rank=1, same=True, seed=2).collect()
    # a self join's first hits are the objects themselves: nobody votes, so the sample of random pairs decides
    sample = [(r["a"], r["b"], r["dist"]) for r in joins.cross_sample(e, e, D.L2, joins.CROSS_SAMPLE, True, 2).collect()]
    bound = np.quantile([d for *_, d in sample], 0.9)
    assert len(sample) == joins.CROSS_SAMPLE and all(a != b for a, b, _ in sample)
    want = set()
    for b in range(len(ids)):
        d = np.sqrt(((x - x[b]) ** 2).sum(1))
        want |= {(ids[a], ids[b]) for a in np.lexsort((ids, d))[:5] if a != b and d[a] <= bound}
    assert {(r["a"], r["b"]) for r in got} == want
    one = e.where("id = 0")
    assert joins.metric_join(one, one, D.L2, 2, same=True).collect() == []


def test_clouds_of_any_objects(spark):
    points = spark.createDataFrame([("p", 1, "abc"), ("p", 2, "abd"), ("q", 3, "xbc"), (None, 4, "q")], "cloud string, id long, v string").where("cloud is not null")
    by = {(r["cloud_a"], r["cloud_b"]): r for r in joins.cloud_distances(points, D.SEQS["levenshtein"]).collect()}
    assert by["p", "q"]["directed"] == 2 and by["q", "p"]["directed"] == 1 and by["p", "q"]["hausdorff"] == 2 and by["p", "p"]["chamfer"] == 0


def test_near_duplicates_by_baskets_links_and_graph(e, edges):
    plain = select.near_duplicates(e, D.L2, 1.1)
    by_baskets = select.near_duplicates(e, D.L2, 1.1, centers=select.random_centers(e, 8, 1))
    same = lambda df: sorted((r["id"], r["nn"], r["kept"]) for r in df.collect())
    assert same(plain) == same(by_baskets) == same(graph.near_duplicates_recall(e, D.L2, 1.1))
    kept = {r["id"] for r in plain.where("kept").collect()}
    near = {r["id"] for r in graph.near_duplicates_recall(e, D.L2, 1.1, 0.9, edges=edges).where("kept").collect()}
    assert len(kept & near) >= 0.8 * len(kept)


def test_closest_pairs_with_a_recall(e):
    exact = joins.closest_pairs(e, e, D.L2, 6, same=True).collect()
    assert hits(graph.closest_pairs_recall(e, e, D.L2, 6, same=True).select(F.col("a").alias("qid"), F.col("b").alias("id"), "dist")) == sorted((r["a"], r["b"], round(r["dist"], 9)) for r in exact)
    found = graph.closest_pairs_recall(e, e, D.L2, 6, 0.8, same=True).collect()
    assert found[0]["dist"] == pytest.approx(exact[0]["dist"]) and all(r["a"] != r["b"] for r in found)


def test_sequences_by_brute_force(spark):
    rows = catalogue.sequences(spark, DATA).where("id < 9").collect()

    def table(a, b, step):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                t[i][j] = step(t, i, j, a[i - 1] == b[j - 1] if i and j else False)
        return t[-1][-1]

    def common(t, i, j, same):
        return 0 if not i or not j else t[i - 1][j - 1] + 1 if same else max(t[i - 1][j], t[i][j - 1])

    def edits(t, i, j, same):
        return i + j if not i or not j else min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (not same))

    assert len(rows) > 5
    df = spark.createDataFrame(rows)
    both = df.select(F.col("id").alias("a"), F.col("v").alias("x")).crossJoin(df.select(F.col("id").alias("b"), F.col("v").alias("y")))
    got = both.select("x", "y", D.lcs(F.col("x"), F.col("y")).alias("lcs"), D.edit_udf(F.col("x"), F.col("y")).alias("edit"), D.levenshtein_seq(F.slice("x", 1, 12), F.slice("y", 1, 12)).alias("short")).collect()
    for r in got:
        x, y = list(r["x"]), list(r["y"])
        assert r["lcs"] == len(x) + len(y) - 2 * table(x, y, common) and r["edit"] == table(x, y, edits) and r["short"] == table(x[:12], y[:12], edits)
    assert D.edit_distance([], ["a"]) == 1 and D.lcs_length([], []) == 0


def test_whole_sequences_are_searched(spark):
    lengths = catalogue.sequences(spark, DATA).agg(F.sum(F.size("v"))).first()[0]
    assert lengths == spark.read.parquet(f"{DATA}/events.parquet").count()
    assert catalogue.queries()["seq_lcs"](spark, DATA).where("rank = 1 and dist <> 0").count() == 0


def test_single_precision_and_sparse_products(spark, e):
    row = spark.sql("SELECT array(1e0, 2e0, 3e0) AS a, array(0, 2) AS i, array(5e0, 7e0) AS x").select(D.dot32(F.col("a"), F.col("a")).alias("d"), D.norm32(F.col("a")).alias("n"), D.sparse_dense_dot(F.col("i"), F.col("x"), F.col("a")).alias("s")).first()
    assert row["d"] == 14 and row["n"] == pytest.approx(math.sqrt(14), abs=1e-6) and row["s"] == 26
    v = spark.createDataFrame([(1, "a", 3.0), (1, "b", 4.0), (2, "a", 0.0)], "id long, term string, w double")
    assert sorted(tuple(r) for r in inverted.normalised(v).collect()) == [(1, "a", pytest.approx(0.6)), (1, "b", pytest.approx(0.8))]


def test_tokenizer_of_an_inverted_file(spark):
    words = spark.createDataFrame([(1, "abcd"), (2, "bcde"), (3, "zz")], "id long, s string")
    shingles = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))
    got = inverted.search(words.withColumnRenamed("id", "qid"), words, D.JACCARD, 5, tokens=shingles).where("qid = 1").orderBy("rank").collect()
    assert [(r["id"], round(r["dist"], 6)) for r in got] == [(1, 0.0), (2, 0.5)]
    assert {r["token"] for r in inverted.postings(words, shingles).where("id = 3").collect()} == {"zz"}


def test_what_a_merge_gives(spark):
    sets = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["b", "c"]), (3, ["c"])], "id long, s array<string>")
    got = inverted.threshold(sets.withColumnRenamed("id", "qid"), sets, 2, (F.array_sort(F.collect_list("token")).alias("tokens"), F.min("token").alias("first")))
    assert {(r["qid"], r["id"]): (r["n"], r["tokens"], r["first"]) for r in got.where("qid = 1 and id > 1").collect()} == {(1, 2): (2, ["b", "c"], "b")}


def test_near_duplicates_of_a_query_are_thinned(e):
    near = search.knn(catalogue.asked(e), e, D.L2, 32).where("qid <> id")
    plain, spared = joins.hsp(near, e, D.L2), joins.hsp(near, e, D.L2, near=1.3, seed=4)
    again = joins.hsp(near, e, D.L2, near=1.3, seed=4)
    rows = lambda df: sorted((r["qid"], r["id"]) for r in df.collect())
    assert rows(spared) == rows(again) and rows(joins.hsp(near, e, D.L2, near=-1.0)) == rows(plain) != rows(spared)
    # each one kept within the bound halves the chance of the next: few stay
    few = spared.where("dist <= 1.3").groupBy("qid").count().agg(F.avg("count")).first()[0]
    assert 1 <= few < 9


def test_codes_must_fill_bytes(spark):
    for bits, dim in ((4, 17), (2, 18)):
        df = spark.createDataFrame([(1, [float(i) for i in range(dim)])], "id long, v array<double>")
        with pytest.raises(Exception, match="multiple"):
            df.select(V.quantise(F.col("v"), bits)["codes"]).collect()
    fine = spark.createDataFrame([(1, [float(i) for i in range(16)])], "id long, v array<double>")
    assert len(fine.select(V.pack(V.quantise(F.col("v"), 2)["codes"], 2).alias("p")).first()["p"]) == 4


def test_range_from_a_sample_and_sketches(e, dense):
    low, high = V.global_range(e)
    assert (low, high) == pytest.approx(tuple(np.quantile(dense[1], (0.025, 0.975))), abs=0.02)
    codes = e.select(V.quantise_global(F.col("v"), low, high, 8).alias("c")).select(F.array_min("c").alias("a"), F.array_max("c").alias("b"))
    assert codes.agg(F.min("a"), F.max("b")).first() == (0, 255)
    for method in ("gaussian", "qr"):
        own, matrix = V.bitsketches(e, method, 48, 64, 3)
        bits = (dense[1] @ matrix >= 0).astype(object)
        want = {int(i): sum(int(b) << k for k, b in enumerate(row)) for i, row in zip(dense[0], bits)}
        assert {r["id"]: r["v"][0] for r in own.collect()} == want
    with pytest.raises(ValueError, match="method"):
        V.bitsketches(e, "other", 48, 64)


def test_sampled_pairs(e, dense):
    n = len(dense[0])
    got = select.distance_sample(e, D.L2, 0.05, 3).collect()
    assert len(got) == math.ceil(n * (n - 1) // 2 * 0.05) and all(r["a"] != r["b"] for r in got)
    assert select.distance_sample(e.where("id < 30"), D.L2, 1.0).count() == 30 * 29 // 2
    assert [r["id"] for r in select.subset(e, [5, 2, 5]).orderBy("pos").collect()] == [5, 2, 5]
    assert select.masked(e, F.col("id") < 9).count() == 9


def test_neighbourhoods_grow_with_the_logarithm():
    assert graph.neighbourhood(0) == 2 and graph.neighbourhood(1000) == math.ceil(2 + math.log(1000, 1.3)) > graph.neighbourhood(100)


@pytest.mark.parametrize("kind", ["sat", "distal", "identity", "kcenters"])
def test_filters_of_neighbours(e, dense, kind):
    edges = select.cut(graph.build(e, D.L2, 12, kind))
    gold = search.knn(catalogue.asked(e), e, D.L2, 5)
    assert search.recall(gold, graph.search(catalogue.asked(e), e, edges, D.L2, 5, beam=32)).agg(F.avg("recall")).first()[0] >= 0.6
    with pytest.raises(ValueError):
        graph.build(e, D.L2, 4, "other")


def test_rebuilt_graphs_and_bounded_searches(e, edges):
    q = catalogue.asked(e)
    gold = search.knn(q, e, D.L2, 10)
    mean = lambda found: search.recall(gold, found).agg(F.avg("recall")).first()[0]
    again = select.cut(graph.rebuild(e, edges, D.L2))
    assert mean(graph.search(q, e, again, D.L2, 10, beam=32)) >= 0.8
    wide, narrow = (select.cut(graph.visits(q, e, edges, D.L2, 10, beam=32, delta=x)) for x in (1.2, 0.7))
    assert evaluate.cost_stats(evaluate.costs(wide)).first()["total"] >= evaluate.cost_stats(evaluate.costs(narrow)).first()["total"] > 0
    capped = evaluate.costs(graph.visits(q, e, edges, D.L2, 10, beam=32, hints=4, max_visits=20))
    assert capped.agg(F.max("blocks")).first()[0] <= evaluate.costs(wide).agg(F.max("blocks")).first()[0]
    first = graph.default_entries(e)
    assert first.count() == math.ceil(math.log2(e.count() + 1)) and mean(graph.search(q, e, edges, D.L2, 10, beam=32, entry=first.limit(0))) >= 0.6


@pytest.mark.parametrize("kind", ["random", "disjoint", "kdisjoint", "epsilon", "kcenters"])
def test_hints(e, edges, kind):
    found = graph.stored_hints(e, graph.hints(e, edges, 10, kind, D.L2))
    assert 0 < found.count() <= 10 and found.columns == ["id", "v"]
    near = edges.join(found.select(F.col("id").alias("src")), "src").join(found.select(F.col("id").alias("dst")), "dst")
    assert kind not in ("random", "disjoint", "kdisjoint") or near.count() == 0


@pytest.mark.parametrize("beam", [None, 8])
def test_trees_are_climbed(e, beam):
    tree = sat.build(e, D.L2)
    found = sat.allknn(tree, D.L2, 5, depth=3, factor=0.95, beam=beam)
    gold = search.allknn(e, D.L2, 5)
    assert search.recall(gold, found).agg(F.avg("recall"), F.count("*")).first()[0] >= 0.5
    assert found.where("rank = 1 and id <> qid").join(e.select(F.col("id").alias("qid")), "qid").where("dist > 0").count() == 0


def test_reports_count_distances(e):
    n = e.count()
    assert select.farthest_first(e, D.L2, 5, 0)[1]["costdists"] == 5 * n


def test_object_stores(spark, e, tmp_path):
    path = f"{tmp_path}/store"
    tables.create_store(spark, path, 64, "float")
    tables.append_store(e.where("id < 10"), path)
    tables.append_store(e.where("id >= 10"), path)
    assert hits(tables.open_store(spark, path).select(F.col("id").alias("qid"), "id", F.lit(0.0).alias("dist"))) == hits(e.select(F.col("id").alias("qid"), "id", F.lit(0.0).alias("dist")))
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        tables.create_store(spark, path, 64)
    with pytest.raises(TypeError):
        tables.append_store(e.select("id", F.col("v").cast("array<double>").alias("v")), path)
    with pytest.raises(Exception, match="dimension"):
        tables.append_store(e.select("id", F.slice("v", 1, 3).alias("v")), path)
    with pytest.raises(PermissionError):
        tables.append_store(e, path, read_only=True)


def test_work_that_follows_the_size(spark, e, tmp_path):
    assert [n for n in range(1, 40) if ingest.due(n - 1, n, 2.0)] == [1, 2, 3, 5, 9, 17, 33] and not ingest.due(5, 5) and not ingest.due(1, 2, start=10)
    e.select("id", "v").repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.select("id", "v").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sizes = []
    query = ingest.ingest(stream, f"{tmp_path}/out", f"{tmp_path}/state", ingest.by_size(lambda s, n: sizes.append(n), f"{tmp_path}/out", base=4.0))
    query.awaitTermination()
    assert 1 <= len(sizes) < 4 and sizes == sorted(sizes) and ingest.progress(query)["rows"] == e.count()


def test_results_and_the_command_line(spark, e, tmp_path, capsys):
    objects, queries = f"{tmp_path}/objects", f"{tmp_path}/queries"
    e.select("id", "v").write.parquet(objects)
    e.select("id", "v").where("id % 50 = 0").write.parquet(queries)
    cli.main(["search", f"{objects}:v", f"{queries}:v", f"{tmp_path}/exact", "-k", "5"])
    gold = search.knn(catalogue.asked(e), e, D.L2, 5)
    assert hits(tables.read_results(spark, f"{tmp_path}/exact")) == hits(gold)
    cli.main(["build", f"{objects}:v", f"{tmp_path}/index"])
    cli.main(["search", f"{objects}:v", f"{queries}:v", f"{tmp_path}/found", "-k", "5", "--index", f"{tmp_path}/index"])
    cli.main(["evaluate", f"{tmp_path}/exact", f"{tmp_path}/found"])
    cli.main(["analyze", f"{tmp_path}/index", f"{objects}:v"])
    shown = capsys.readouterr().out
    assert "recall" in shown and "median" in shown
    tables.write_results(gold.withColumnsRenamed({"qid": "q", "id": "o"}), f"{tmp_path}/own", distances=False)
    again = tables.read_results(spark, f"{tmp_path}/own", {"q": "qid", "o": "id"})
    assert again.columns == ["qid", "id", "rank"] and again.count() == gold.count()


def test_earth_movers_distance(spark):
    import itertools

    rng = np.random.default_rng(2)
    for m, n in ((1, 1), (3, 3), (5, 5), (2, 4), (3, 6), (6, 2), (1, 4)):
        cost = rng.random((m, n)).round(2)
        whole = np.lcm(m, n)  # each point as so many that both sides have one number
        a, b = np.repeat(np.arange(m), whole // m), np.repeat(np.arange(n), whole // n)
        best = min(sum(cost[a[i], p] for i, p in enumerate(order)) for order in set(itertools.permutations(b))) / whole
        assert joins.transport(cost) == pytest.approx(best)
    points = spark.createDataFrame([(c, 10 * c + i, [float(x) for x in rng.normal(c, 1, 2)]) for c in range(3) for i in range(4)], "cloud long, id long, v array<double>")
    got = {(r["cloud_a"], r["cloud_b"]): r["emd"] for r in joins.cloud_emd(points, D.L2).collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 2)} and got[0, 1] <= got[0, 2] + got[1, 2] + 1e-9
    same = points.where("cloud = 0").unionByName(points.where("cloud = 0").withColumn("cloud", F.lit(9).cast("long")))
    assert joins.cloud_emd(same, D.L2).first()["emd"] == pytest.approx(0.0)
