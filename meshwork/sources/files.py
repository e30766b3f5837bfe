"""Text sources and sinks: METIS graphs, partitions, command logs, JSON summaries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from meshwork.sources.graph import Graph


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines of a text file, or of a folder's parts in the order of their names, with their number from 0. Spark reads the largest splits first
    and several in one task, so a line's number is its place in its split plus the lines of all splits before; the driver sees no lines."""
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    text = spark.read.text(path).select("value", *split, F.monotonically_increasing_id().alias("at"))
    splits = text.groupBy("file", "start").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    starts = splits.select("file", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("first"))
    return text.join(F.broadcast(starts), ["file", "start"]).select((F.col("first") + F.col("at")).alias("line"), "value")


def read_metis(spark: SparkSession, path: str) -> Graph:
    """A METIS graph: header `n m [fmt]`, `%` comments, then a line for each vertex: [weight] (neighbour [weight])*, ids from 1. Raises
    if the number of vertex lines or arcs isn't what the header says."""
    lines = numbered_lines(spark, path).where(~F.col("value").startswith("%"))
    head = lines.orderBy("line").first()
    if head is None:
        raise ValueError("no header")
    fields = head["value"].split()
    n, m, fmt = int(fields[0]), int(fields[1]), (fields[2] if len(fields) > 2 else "0").zfill(3)
    has_v, has_e = fmt[-2] == "1", fmt[-1] == "1"
    body = lines.where(F.col("line") > head["line"]).select("line", F.filter(F.split(F.trim("value"), "\\s+"), lambda x: x != "").alias("xs"))
    if has_comments := lines.where(F.col("line") > head["line"]).count() != (lines.agg(F.max("line")).first()[0] - head["line"]):
        ranked = body.rdd.sortBy(lambda r: r[0]).zipWithIndex().map(lambda x: (x[1], x[0][1]))
        body = spark.createDataFrame(ranked, "u long, xs array<string>")
    else:
        body = body.select((F.col("line") - head["line"] - 1).alias("u"), "xs")
    del has_comments
    body = body.where(F.col("u") < n)
    vertices = body.select("u", (F.col("xs")[0].cast("long") if has_v else F.lit(1).cast("long")).alias("vw"))
    rest = F.slice("xs", 2, F.greatest(F.size("xs") - 1, F.lit(0))) if has_v else F.col("xs")
    step = 2 if has_e else 1
    items = body.select("u", rest.alias("xs")).where(F.size("xs") > 0)
    places = items.select("u", "xs", F.explode(F.sequence(F.lit(1), F.size("xs"), F.lit(step))).alias("i"))
    edges = places.select("u", (F.element_at("xs", F.col("i")).cast("long") - 1).alias("v"), (F.element_at("xs", F.col("i") + 1).cast("long") if has_e else F.lit(1).cast("long")).alias("w"))
    found, lines_ = edges.count(), vertices.count()
    if found != 2 * m or lines_ != n:
        raise ValueError(f"the header says {n} vertices and {2 * m} arcs, the file has {lines_} and {found}")
    return Graph(vertices, edges)


def dense(graph: Graph) -> tuple[Graph, DataFrame]:
    """The graph with ids 0..n-1 in the order of the old ones, and (new_u, u)."""
    spark = graph.vertices.sparkSession
    ranked = graph.vertices.select("u").sort("u").rdd.zipWithIndex().map(lambda x: (x[1], x[0][0]))
    table = spark.createDataFrame(ranked, "new_u long, u long")
    vertices = graph.vertices.join(table, "u").select(F.col("new_u").alias("u"), "vw")
    edges = graph.edges.join(table, "u").select(F.col("new_u").alias("a"), "v", "w")
    edges = edges.join(table.withColumnRenamed("u", "v").withColumnRenamed("new_u", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"), "w")
    return Graph(vertices, edges), table


def metis_lines(graph: Graph, weights: bool = True) -> DataFrame:
    """(u, value): the vertex lines of a graph with ids 0..n-1."""
    near = graph.edges.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("v", "w"))).alias("es"))
    one = lambda e: F.concat_ws(" ", (e["v"] + 1).cast("string"), e["w"].cast("string")) if weights else (e["v"] + 1).cast("string")
    text = F.concat_ws(" ", F.transform(F.coalesce("es", F.array().cast("array<struct<v:bigint,w:bigint>>")), one))
    joined = graph.vertices.join(near, "u", "left")
    value = F.when(text == "", F.col("vw").cast("string")).otherwise(F.concat_ws(" ", F.col("vw").cast("string"), text)) if weights else text
    return joined.select("u", value.alias("value"))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_metis(graph: Graph, path: str, weights: bool = True) -> None:
    """A folder of text whose parts, in the order of their names, are the METIS file (fmt 011 with weights). Ids must be 0..n-1."""
    n, m = graph.vertices.count(), graph.edges.count()
    if m % 2:
        raise ValueError("an edge lacks its reverse")
    head = graph.vertices.sparkSession.createDataFrame([(-1, f"{n} {m // 2} 011" if weights else f"{n} {m // 2}")], "u long, value string")
    head.unionByName(metis_lines(graph, weights)).sort("u").select("value").write.mode("overwrite").text(path)


def write_partition(assign: DataFrame, path: str) -> None:
    """A block id on each line, in the order of the vertices."""
    assign.sort("u").select(F.col("pid").cast("string").alias("value")).write.mode("overwrite").text(path)


def read_partition(spark: SparkSession, path: str) -> DataFrame:
    return numbered_lines(spark, path).select(F.col("line").alias("u"), F.trim("value").cast("long").alias("pid"))


def fingerprint(graph: Graph) -> DataFrame:
    """One row that tells graphs apart: the xor of 60 bits of the MD5 of all vertices and edges."""
    text = graph.vertices.select(F.concat_ws(" ", F.lit("v"), "u", "vw").alias("x")).unionByName(graph.edges.select(F.concat_ws(" ", F.lit("e"), "u", "v", "w").alias("x")))
    return text.agg(F.bit_xor(F.conv(F.substring(F.md5(F.col("x").cast("binary")), 1, 15), 16, 10).cast("long")).alias("graph_hash"))


def write_dataset(graph: Graph, assign: DataFrame, result: dict, path: str) -> None:
    """Adds a solved instance to a collection of Parquet tables partitioned by the graph's fingerprint."""
    key = graph.vertices.sparkSession.createDataFrame([(json.dumps(result, sort_keys=True),)], "result string")
    tag = F.lit(str(fingerprint(graph).first()[0]))
    for name, df in (("vertices", graph.vertices), ("edges", graph.edges), ("assign", assign), ("result", key)):
        df.withColumn("graph_hash", tag).write.mode("append").partitionBy("graph_hash").parquet(f"{path}/{name}")


def write_items(items: DataFrame, path: str) -> None:
    """The index of the parts of a multisection (item, path, depth, n, m, k, ...) as CSV, appended."""
    items.write.mode("append").option("header", True).csv(path)


def to_json(report: DataFrame) -> DataFrame:
    """A report's rows as JSON text."""
    return report.select(F.to_json(F.struct(*report.columns)).alias("json"))


COMMANDS = ("+v", "+e", "-v", "-e", "vw", "ew", "set-hierarchy", "partition", "refine-fast", "autorefine", "no-refinement", "save-partition", "save-graph", "stats", "exec", "quit")


def parse_commands(lines: DataFrame) -> DataFrame:
    """(line, value) to (seq, op, u, v, w, args, rejected). Empty lines and `#` comments are skipped; unknown commands and
    wrong numbers of arguments are kept with `rejected` set, never dropped silently."""
    parts = F.split(F.trim("value"), "\\s+")
    rows = lines.where((F.trim("value") != "") & ~F.trim("value").startswith("#")).select(F.col("line").alias("seq"), parts[0].alias("op"), F.slice(parts, 2, 100).alias("args"))
    number = lambda i: F.get("args", F.lit(i)).try_cast("long") if hasattr(F.Column, "try_cast") else F.get("args", F.lit(i)).cast("long")
    vertex, edge = F.col("op").isin("+v", "-v", "vw"), F.col("op").isin("+e", "-e", "ew")
    n = F.size("args")
    bad = (vertex & (n < 1)) | (edge & (n < 2)) | ((F.col("op") == "vw") & (n < 2)) | ((F.col("op") == "ew") & (n < 3))
    numeric = F.col("op").isin("+v", "+e", "-v", "-e", "vw", "ew") & F.exists("args", lambda x: ~x.rlike("^-?[0-9]+$"))
    rejected = bad | numeric | ~F.col("op").isin(*COMMANDS)
    ok = ~rejected
    return rows.select(
        "seq", "op",
        F.when(ok & (vertex | edge), number(0)).alias("u"),
        F.when(ok & edge, number(1)).alias("v"),
        F.when(ok & edge, number(2)).when(ok & vertex, number(1)).alias("w"),
        "args", rejected.alias("rejected"),
    )


def read_commands(spark: SparkSession, path: str) -> DataFrame:
    return parse_commands(numbered_lines(spark, path))


def command_list(spark: SparkSession, commands: list[str]) -> DataFrame:
    return parse_commands(spark.createDataFrame(list(enumerate(commands)), "line long, value string"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["Window"]
