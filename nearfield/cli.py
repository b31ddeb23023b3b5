"""python -m nearfield.cli search|evaluate|analyze|build: command line over Parquet tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .functions.distances import VECTORS
from .operators import evaluate, graph, search
from .sources import tables


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="nearfield")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, needs in (("search", ("objects", "queries", "out")), ("build", ("objects", "out")), ("evaluate", ("gold", "found")), ("analyze", ("index", "objects"))):
        p = sub.add_parser(name)
        for n in needs:
            p.add_argument(n)
        p.add_argument("--distance", default="l2", choices=sorted(VECTORS))
        p.add_argument("-k", type=int, default=10)
        if name == "search":
            p.add_argument("--index")
    a = parser.parse_args(argv)
    spark, dist = SparkSession.builder.getOrCreate(), VECTORS[a.distance]
    if a.command == "search":
        objects, queries = tables.read_objects(spark, a.objects), tables.read_objects(spark, a.queries).withColumnRenamed("id", "qid")
        if a.index:
            own, params = tables.load_index(spark, a.index)
            hits = graph.search(queries, objects, own["edges"], VECTORS[params["distance"]], a.k)
        else:
            hits = search.knn(queries, objects, dist, a.k)
        tables.write_results(hits, a.out)
    elif a.command == "build":
        edges = graph.build(tables.read_objects(spark, a.objects), dist)
        tables.save_index(spark, a.out, {"edges": edges}, {"distance": a.distance})
    elif a.command == "evaluate":
        evaluate.macro_recall(tables.read_results(spark, a.gold), tables.read_results(spark, a.found)).show()
    else:
        own, _ = tables.load_index(spark, a.index)
        nodes = tables.read_objects(spark, a.objects)
        evaluate.describe(graph.degrees(nodes, own["edges"]), "degree").show()


if __name__ == "__main__":
    main()
