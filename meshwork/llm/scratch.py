"""Tables between the steps of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; only where the session names none and runs on one machine (tests), a temporary folder."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="meshwork-")
        import shutil

        atexit.register(shutil.rmtree, _own["dir"], True)
    return "file://" + _own["dir"]


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB, unless the session says otherwise: both sides of a stream of long texts hold whole batches."""
    if spark.conf.get(BATCH_BYTES, None) in (None, "268435456", "256MB", "256m"):
        spark.conf.set(BATCH_BYTES, "4m")


class Scratch:
    """Writes steps as Parquet, which cuts the lineage: a lost executor costs the tasks it ran, not the steps before.

    `drop` deletes a step that no later one reads. What the returned result still reads stays until the folder is cleaned
    as the cluster cleans its checkpoints.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame, name: str = "step", gone: list[DataFrame] | None = None) -> DataFrame:
        """Writes a step and reads it again; `gone` are steps that no later one reads."""
        self.n += 1
        path = f"{self.root}/{self.n:02d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        del df
        self.drop(*(gone or ()))
        self.collect_garbage()
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def collect_garbage(self) -> None:
        """Lets Spark's cleaner remove shuffle files that no plan refers to any more; once more a little later, when the listeners have let go of the step's plan. On one
        machine (tests, small tables) that is left to the JVM."""
        if self.spark.sparkContext.master.startswith("local"):
            return
        gc.collect()

        def in_jvm():
            with contextlib.suppress(Exception):
                self.spark._jvm.System.gc()

        in_jvm()
        later = threading.Timer(1.5, in_jvm)
        later.daemon = True
        later.start()


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
