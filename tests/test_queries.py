"""Every query with SQL against DuckDB on the small tables; invariants of the others."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from nearfield.functions import distances as D
from nearfield.operators import graph, inverted, joins, sat, search, select
from nearfield.plans import catalogue
from nearfield.sources import tables
from nearfield.streaming import ingest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    return c


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    answer = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(answer.columns) == columns
    places = [answer.columns.index(c) for c in columns]
    expected = sorted(tuple(plain(r[i]) for i in places) for r in answer.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(*columns).collect()) == expected


def objects(spark):
    return catalogue.vectors(spark, DATA)


def test_farthest_first(spark):
    rows, report = select.farthest_first(objects(spark), D.L2, 6, 0)
    got = rows.collect()
    assert len(report["centers"]) == 6 and {r["center"] for r in got} == set(report["centers"])
    assert max(r["dist"] for r in got) == pytest.approx(report["covradius"])


def test_recall_of_approximate_indexes(spark):
    e = objects(spark)
    gold = search.knn(catalogue.asked(e), e, D.L2, 10)
    for name, least in (("graph_knn", 0.8), ("pivot_knn", 0.6), ("graph_references_knn", 0.7), ("sat_beam_knn", 0.6)):
        assert search.recall(gold, catalogue.queries()[name](spark, DATA)).agg(F.avg("recall")).first()[0] >= least


def test_tiny_closest_pairs(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0])], "id long, v array<double>")
    assert joins.closest_pairs(df, df, D.L2, 100, same=True).count() == 6


def test_warehouses(spark):
    a = spark.createDataFrame([(1, [0.0, 0.0]), (2, [10.0, 0.0]), (3, [0.0, 10.0]), (4, [10.0, 10.0])], "id long, v array<double>")
    b = spark.createDataFrame([(1, [1.0, 1.0]), (2, [9.0, 1.0]), (3, [1.0, 9.0]), (4, [9.0, 9.0]), (5, [5.0, 5.0]), (6, [0.5, 0.5])], "id long, v array<double>")
    row = joins.closest_pairs(a, b, D.L2).first()
    assert (row["a"], row["b"]) == (1, 6) and row["dist"] == pytest.approx(0.70710677)


@pytest.mark.parametrize("policy, limit, parts", [("proximal", 40, 1), ("distal", 64, 2), ("random", 40, 1), ("random", 4096, 3)])
def test_trees_are_exact(spark, policy, limit, parts):
    e = objects(spark).where("id < 300")
    tree = sat.build(e, D.L2, policy, parts=parts, limit=limit)
    rows = {r["id"]: r for r in tree.collect()}
    assert set(rows) == {r["id"] for r in e.select("id").collect()} and sum(r["parent"] is None for r in rows.values()) == parts
    assert all(r["parent"] is None or rows[r["parent"]]["depth"] == r["depth"] - 1 for r in rows.values())
    found = sat.search(catalogue.asked(e), tree, D.L2, 5)
    gold = search.knn(catalogue.asked(e), e, D.L2, 5)
    assert {(r["qid"], r["rank"]): r["id"] for r in found.collect()} == {(r["qid"], r["rank"]): r["id"] for r in gold.collect()}
    assert sat.permutation(tree).select("pos").distinct().count() == 300


def test_graph_upkeep(spark):
    e = objects(spark).select("id", "v")
    old, new = e.where("id % 10 <> 0"), e.where("id % 10 = 0")
    edges = select.cut(graph.append(old, graph.build(old, D.L2), new, D.L2))
    gold = search.knn(catalogue.asked(e), e, D.L2, 10)
    config, report = graph.tune(catalogue.asked(e), e, edges, D.L2, 10, graph.min_recall(0.8), beams=(8, 32), deltas=(0.95, 1.1))
    assert len(report) == 4 and max(r["recall"] for r in report) >= 0.8 and config["beam"] in (8, 32) and config["delta"] in (0.95, 1.1)
    hints = graph.hints(e, edges, 16, "kdisjoint")
    assert search.recall(gold, graph.search(catalogue.asked(e), e, edges, D.L2, 10, beam=32, entry=hints)).agg(F.avg("recall")).first()[0] >= 0.7
    exact = joins.closest_pairs(e, e, D.L2, 2, same=True).first()
    assert graph.closest_pairs_graph(e, edges, D.L2, 2).first()["dist"] == pytest.approx(exact["dist"])
    assert graph.neighbours(edges, e.where("id < 3")).count() == 3
    with pytest.raises(TypeError):
        graph.Frozen(e, edges).add(edges)


def test_rings_connect_large_groups(spark):
    members = spark.range(500).select(F.lit("k").alias("key"), "id")
    near = {}
    for r in graph.rings(members).collect():
        near.setdefault(r["src"], set()).add(r["dst"])
        near.setdefault(r["dst"], set()).add(r["src"])
    seen, waiting = {0}, [0]
    while waiting:
        fresh = near[waiting.pop()] - seen
        seen |= fresh
        waiting += fresh
    assert len(seen) == 500 and max(map(len, near.values())) < 40


def test_postings_append_once(spark):
    a = spark.createDataFrame([(1, ["x", "y"]), (2, ["y"])], "id long, s array<string>")
    assert inverted.append(inverted.postings(a.where("id = 1")), a).count() == 3


def test_zero_is_a_sentinel_among_numbers_only(spark):
    n = spark.createDataFrame([(1, [0, 1, 2]), (2, [0, 3]), (3, [2, None, 2])], "id long, s array<int>")
    got = inverted.overlap(n.withColumnRenamed("id", "qid"), n).where("qid = 1").collect()
    assert {(r["id"], r["i"], r["m"], r["n"]) for r in got} == {(1, 2, 2, 2), (3, 1, 2, 1)}
    text = spark.createDataFrame([(1, ["0"]), (2, ["0", "a"])], "id long, s array<string>")
    assert inverted.overlap(text.withColumnRenamed("id", "qid"), text).count() == 4


def test_density_net_covers_all(spark):
    got = select.density_net(objects(spark), D.L2, 5, 1)
    assert got.count() == objects(spark).count() == got.select("id").distinct().count()


def test_null_vectors_are_refused(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, None)], "id long, v array<double>")
    with pytest.raises(Exception, match="non-null"):
        search.allknn(df, D.L2, 1).collect()


def test_persistence_and_streaming(spark, tmp_path):
    e = objects(spark).select("id", "v")
    tables.save_index(spark, f"{tmp_path}/index", {"centers": e.limit(3)}, {"k": 3})
    own, params = tables.load_index(spark, f"{tmp_path}/index")
    assert params == {"k": 3} and own["centers"].count() == 3
    e.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ingest.ingest(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    log = ingest.logged(spark, f"{tmp_path}/out").orderBy("batch_id").collect()
    assert log[0]["sp"] == 1 and all(b["sp"] == a["ep"] + 1 for a, b in zip(log, log[1:])) and log[-1]["ep"] == e.count()
    assert tables.read_objects(spark, f"{tmp_path}/out/objects:v", "id").count() == e.count()
