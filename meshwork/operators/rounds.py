"""State between rounds of iterative operators, and numbering of rows in order without a task that sees them all."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from meshwork.sources.graph import Graph

#: Written tables of more bytes are joined where their rows lie, never broadcast through the driver unless the join says so. Fixed value.
SMALL = 1 << 17


class Rounds:
    """State tables of iterative operators, written to the folder of spark.checkpoint.dir (to a temporary one only where the
    session names none and runs on one machine)."""

    _own: str | None = None

    def __init__(self, spark: SparkSession):
        given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not given:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            if Rounds._own is None:
                Rounds._own = tempfile.mkdtemp(prefix="meshwork-rounds-")
                atexit.register(shutil.rmtree, Rounds._own, True)
            given = "file://" + Rounds._own
        self.spark, self.root, self.n = spark, f"{given.rstrip('/')}/rounds-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        size = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
        kept = self.spark.read.schema(df.schema).parquet(path)
        if size > SMALL:
            return kept.hint("merge")
        kept.few = True
        return kept

    def graph(self, graph: Graph) -> Graph:
        """The graph as written tables, so that rounds don't make it anew from its sources."""
        return graph if graph.kept else Graph(self.keep(graph.vertices), self.keep(graph.edges), True)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that `keep` wrote and that nothing reads any more."""
        for t in tables:
            for name in t.inputFiles()[:1]:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
                if self.root.split(":")[-1].lstrip("/") in path.toString():
                    path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def few(table: DataFrame, *columns) -> DataFrame:
    """These columns of a table, broadcast where `keep` found it small: joins with large tables, which are to be joined where they lie, then shuffle neither."""
    chosen = table.select(*columns)
    return F.broadcast(chosen) if table.__dict__.get("few") else chosen


def ranked(rows: DataFrame, by: list[str], order: list[str], state: Rounds, amount: str | None = None) -> DataFrame:
    """Adds `rank`, a row's place 0, 1, .. in its group (all rows, if `by` is empty) in this order, and with `amount` also `ahead`, the sum of that column over
    the rows before it. Rows are range-partitioned by group and order; the driver and single tasks see a row for each group and partition only, so
    a group may hold all rows."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [*by, *order]
    placed = state.keep(rows.repartitionByRange(n, *key).sortWithinPartitions(*key).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    sums = [F.min("__at").alias("__low"), F.count("*").alias("__n")] + ([F.sum(amount).alias("__sum")] if amount else [])
    parts = placed.groupBy(*by, "__part").agg(*sums)
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*by, "__part", "__low", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), *([F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__ahead")] if amount else []))
    out = placed.join(starts, [*by, "__part"]).withColumn("rank", F.col("__start") + F.col("__at") - F.col("__low"))
    if amount:
        inside = Window.partitionBy(*by, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("ahead", F.col("__ahead") + F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return out.drop("__at", "__part", "__low", "__start", "__ahead")
