"""python -m meshwork map|partition|deep|dynamic ...: reads a graph or a command log, solves, writes the placement and a summary."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from meshwork.operators import metrics
from meshwork.plans import solver
from meshwork.plans.options import machine_of, parser, profile_of
from meshwork.sources import files
from meshwork.sources.graph import Graph
from meshwork.streaming.dynamic import Session


def main(argv: list[str] | None = None, spark: SparkSession | None = None):
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("meshwork").getOrCreate()
    machine, profile = machine_of(args), profile_of(args)
    if args.program == "dynamic":
        solver.PROFILES["given"] = profile
        session = Session(spark, machine, args.imbalance, "given", args.seed)
        if args.commands == "-":
            session.listen(sys.stdin)
        else:
            session.run(files.read_commands(spark, args.commands))
        graph, assign, machine = session.graph, session.assign, session.m
        report = session.stats()
    else:
        if files.exists(spark, f"{args.graph}/vertices"):
            graph = Graph(spark.read.parquet(f"{args.graph}/vertices"), spark.read.parquet(f"{args.graph}/edges"))
        else:
            graph = files.read_metis(spark, args.graph)
        if args.program == "deep":
            assign = solver.solve_deep(graph, machine, args.imbalance, profile, args.seed)
        elif getattr(args, "hm_level", 0):
            assign = solver.solve_by_levels(graph, machine, args.imbalance, profile, args.seed, args.hm_level)
        else:
            assign = solver.solve(graph, machine, args.imbalance, profile, args.seed, dump=args.save_coarsest_graph)
        report = metrics.solution_report(graph.vertices, graph.edges, assign, machine, args.imbalance)
    if args.mapping and assign is not None:
        files.write_partition(assign, args.mapping)
    if args.items and assign is not None:
        files.write_items(metrics.multisection_items(graph, assign, machine), args.items)
    if args.dataset and assign is not None:
        files.write_dataset(graph, assign, report.first().asDict(), args.dataset)
    summary = files.to_json(report)
    if args.json_output:
        summary.write.mode("overwrite").text(args.json_output)
    print(summary.first()["json"])
    return assign


if __name__ == "__main__":
    main()
