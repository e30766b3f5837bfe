"""Graphs as two tables: vertices (u, vw) and edges (u, v, w) in both directions, without loops, each pair once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meshwork.kernels import meetings


@dataclass
class Graph:
    vertices: DataFrame
    edges: DataFrame
    kept: bool = False  # whether both are tables that `Rounds` wrote

    @classmethod
    def of(cls, edges: DataFrame, vertices: DataFrame | None = None) -> Graph:
        """From edges in both directions; vertices of weight 1 are the edges' ends unless given."""
        if vertices is None:
            vertices = edges.select("u").distinct().withColumn("vw", F.lit(1).cast("long"))
        return cls(vertices, edges)

    @classmethod
    def from_lists(cls, spark: SparkSession, n: int, pairs: list[tuple], weights: list[int] | None = None) -> Graph:
        """From undirected (u, v[, w]) rows in memory; loops are rejected, parallel edges summed."""
        rows = [(int(p[0]), int(p[1]), int(p[2]) if len(p) > 2 else 1) for p in pairs]
        if any(u == v for u, v, _ in rows):
            raise ValueError("loops aren't edges")
        vertices = spark.createDataFrame([(i, int(weights[i]) if weights else 1) for i in range(n)], "u long, vw long")
        return cls(vertices, symmetric(spark.createDataFrame(rows, "u long, v long, w long")))

    def cached(self) -> Graph:
        return Graph(self.vertices.cache(), self.edges.cache())


def symmetric(edges: DataFrame) -> DataFrame:
    """Undirected rows to both directions: summed once in one direction, then each row is doubled, so one shuffle of half the rows."""
    one = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w").groupBy("u", "v").agg(F.sum("w").alias("w"))
    return both_ways(one)


def both_ways(one: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return one.select(F.explode(ends).alias("e"), "w").select("e.u", "e.v", "w")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows for each task where pairs are made and counted. Fixed value.
ROWS_A_TASK = 250_000


def spread(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """Dealt by key to as many tasks as `rows` ask for, so that what a task holds doesn't grow with the input; where the session's own number is enough, Spark may
    join small ones."""
    n = -(-rows // ROWS_A_TASK)
    return df.repartition(n, *key) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*key)


def _co_occurring(df: DataFrame, key: list, item: Column) -> Graph:
    """Distinct items that share keys of few items, w = the number of common keys: one shuffle by key, one by pair, to a number of tasks that grows with the rows. The
    vertices come from the lists, so counting them doesn't count the pairs."""
    rows = df.count()
    lists = spread(df, rows, *key).groupBy(*key).agg(F.array_sort(F.collect_set(item)).alias("xs")).select("xs").where(F.size("xs") > 1)
    first = lists.select(F.posexplode("xs").alias("i", "u"), "xs").where(F.col("i") + 1 < F.size("xs"))
    pairs = first.select("u", F.explode(F.slice("xs", F.col("i") + 2, F.size("xs"))).alias("v"))
    vertices = lists.select(F.explode("xs").alias("u")).distinct().withColumn("vw", F.lit(1).cast("long"))
    return Graph(vertices, both_ways(spread(pairs, rows, "u", "v").groupBy("u", "v").agg(F.count("*").alias("w"))))


def copurchase(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts that share orders (an order has a few lines), w = number of common orders."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return _co_occurring(lines, ["l_orderkey"], F.col("l_partkey"))


def copurchase_blocks(spark: SparkSession, sf_dir: str, assign: DataFrame) -> DataFrame:
    """(pu, pv, w): the weight of the co-purchase edges between blocks of a placement, both ways, a pair may come in several rows. Lines get their block before they are paired,
    so pairs of parts are counted where they are made and only pairs of blocks are shuffled."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("u"))
    rows = lines.count()
    placed = spread(lines, rows, "u").join(assign.select("u", "pid").hint("shuffle_hash"), "u")
    lists = spread(placed, rows, "l_orderkey").groupBy("l_orderkey").agg(F.collect_set(F.struct("u", "pid")).alias("xs")).select(F.col("xs.pid").alias("xs")).where(F.size("xs") > 1)
    first = lists.select(F.posexplode("xs").alias("i", "pu"), "xs").where(F.col("i") + 1 < F.size("xs"))
    one = first.select("pu", F.explode(F.slice("xs", F.col("i") + 2, F.size("xs"))).alias("pv")).groupBy("pu", "pv").agg(F.count("*").alias("w"))
    return both_ways(one.select(F.col("pu").alias("u"), F.col("pv").alias("v"), "w")).withColumnsRenamed({"u": "pu", "v": "pv"})


def customer_supplier(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers 2c and suppliers 2s+1, w = order lines between them."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    met = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return Graph.of(symmetric(met.select((F.col("o_custkey") * 2).alias("u"), (F.col("l_suppkey") * 2 + 1).alias("v"), F.lit(1).cast("long").alias("w"))))


def nation_flow(spark: SparkSession, sf_dir: str) -> Graph:
    """Order lines between the customer's and the supplier's nation; pairs inside a nation are dropped."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("u"))
    supplier = _table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("v"))
    met = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return Graph.of(symmetric(met.select("u", "v", F.lit(1).cast("long").alias("w"))))


def part_grid(spark: SparkSession, sf_dir: str, width: int = 20) -> Graph:
    """Parts as cells of a grid: (p, p+1) within a row of `width`, (p, p+width); w = 1 + p % 3; vw = size."""
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), F.col("p_size").cast("long").alias("vw"))
    w = (1 + F.col("p") % 3).alias("w")
    right = part.where(F.col("p") % width != width - 1).select(F.col("p").alias("u"), (F.col("p") + 1).alias("v"), w)
    down = part.select(F.col("p").alias("u"), (F.col("p") + width).alias("v"), w)
    inside = part.select(F.col("p").alias("v"))
    one = right.unionByName(down).join(inside, "v", "left_semi").select("u", "v", "w")
    return Graph(part.select(F.col("p").alias("u"), "vw"), both_ways(one))


def user_cooccur(spark: SparkSession, sf_dir: str) -> Graph:
    """Users with the same event type in the same hour, w = number of such hours and types. Keys may hold many users and most users may meet, so users are dealt to blocks of
    about ROWS_A_TASK rows, and a task counts the meetings of two blocks: what is shuffled is each block once for every other, never a pair of users."""
    events = _table(spark, sf_dir, "events").select(F.col("user_id").alias("u"), F.col("event_type").alias("kind"), F.unix_micros(F.date_trunc("hour", "ts").cast("timestamp")).alias("h"))
    # four blocks at least, so that small tables have tasks as well
    n = max(4, -(-events.count() // ROWS_A_TASK))
    met = events.dropna().withColumn("block", F.pmod(F.xxhash64("u"), F.lit(n))).repartition(n, "block").distinct()
    blocks = met.groupBy("block").applyInPandas(meetings.block_of, meetings.BLOCK)
    sent = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")})
    edges = sent.drop("other").repartition(n * (n + 1) // 2, "a", "b").sortWithinPartitions("a", "b", "block").mapInArrow(meetings.counted, meetings.PAIRS)
    shared = met.groupBy("kind", "h").agg(F.count("*").alias("many")).where("many > 1")
    return Graph.of(edges, met.join(shared, ["kind", "h"], "left_semi").select("u").distinct().withColumn("vw", F.lit(1).cast("long")))
