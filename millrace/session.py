"""Sessions and the few settings the operators need."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "millrace", cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and small data; a cluster brings its own."""
    settings = {
        "spark.master": f"local[{cores}]",
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.appName(name).config(map=settings | conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for all executors; one of our own only where it names none, as in tests."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix=f"millrace-{os.getpid()}-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Whether Spark removes the files of a query's shuffles as soon as the query is over, rather than after the driver's next collection of garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stored:
    """Rows written as a table in the shared folder, and dropped when they are no longer needed; the shuffles that made them go at once. ``freed``: the driver also collects its garbage, for the shuffles and broadcasts of earlier queries."""

    def __init__(self, df: DataFrame, freed: bool = False):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/millrace-{uuid.uuid4().hex}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(self.path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        if freed:
            self.spark._jvm.System.gc()
        self.rows = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, so that a lost executor loses nothing and later plans do not repeat the work."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a plain scan over all cores where a small file would keep them on fewer; larger inputs have partitions enough and stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
