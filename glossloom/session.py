"""Session settings, shared scratch tables and input tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("glossloom")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is used in local mode only; on a cluster it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="glossloom-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


class Scratch:
    """Tables written to the shared folder to cut the lineage of iterative plans.

    A written table survives the loss of executors, unlike a local checkpoint. Results read the tables
    written last, so these stay until :meth:`clear` is called, at best when the results are written.
    """

    bases: set[str] = set()

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
        self.n = 0
        Scratch.bases.add(self.base)

    @classmethod
    def clear(cls, spark: SparkSession) -> None:
        """Delete all tables of this process; results not yet written can't be read after."""
        one = cls(spark)
        while cls.bases:
            one.delete(cls.bases.pop())

    def new_path(self) -> str:
        """Where the next table goes."""
        self.n += 1
        return f"{self.base}/{self.n:04d}"

    def save(self, df: DataFrame, replaces: list[str] | None = None, **metrics: Column) -> DataFrame:
        """Write and read back; then delete the tables named in ``replaces``.

        ``metrics`` are aggregates taken while the rows are written, for :meth:`metric`.
        """
        path = self.new_path()
        schema, seen = df.schema, None
        if metrics:
            seen = Observation()
            df = df.observe(seen, *[c.alias(k) for k, c in metrics.items()])
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        for old in replaces or []:
            self.delete(old)
        back = self.spark.read.schema(schema).parquet(path)
        back._glossloom_path = path
        back._glossloom_metrics = seen.get if seen else {}
        return back

    def metric(self, df: DataFrame, name: str):
        return df._glossloom_metrics[name]

    def path(self, df: DataFrame) -> str:
        return df._glossloom_path

    def delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Ids of repeated rows that are sent to every task rather than shuffled with the texts they stand for.
MOST_REPEATED = 500_000


def rows_once(df: DataFrame, key: str) -> DataFrame:
    """``df`` (the key and one wide column or more) with repeated rows once, by key, without shuffling all of it.

    Only rows whose key stands in several rows are compared. Their keys are found by reading the key
    column alone and sent to every task if there are at most :data:`MOST_REPEATED`, else all rows are shuffled. Keys are not null.
    """
    scratch = Scratch(df.sparkSession)
    many = scratch.save(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key), n=F.count(F.lit(1)))
    n = scratch.metric(many, "n")
    if n == 0 or n > MOST_REPEATED:
        return df if n == 0 else df.distinct()
    small = F.broadcast(many)
    return df.join(small, key, "left_anti").unionByName(df.join(small, key, "left_semi").distinct())


_SCHEMAS: dict[tuple[str, int], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory; its schema is read from the files once, as long as they stay the same."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    if not os.path.exists(path):  # on another file system
        return spark.read.parquet(path)
    key = (path, os.stat(path).st_mtime_ns)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)
