"""Cutting lineage in iterative plans."""

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StructField, StructType


def new_path(spark: SparkSession) -> str:
    """A new folder's name under the one that the cluster shares; a folder of this machine serves only where none is set in a local run."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/kgloom-{os.getuid()}"
    return f"{base.rstrip('/')}/kgloom-cut/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


#: Spark's setting for removing an execution's shuffle files at its end.
FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Spark's setting for the partitions of a shuffle.
PARTS = "spark.sql.shuffle.partitions"


#: Spark's setting that joins take sides as dealt only where they are dealt by all keys of the join.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def _freed(spark: SparkSession, parts: int | None = None):
    """Shuffle files of what is written go with the write: its rows are in the table, and rounds would leave theirs until the driver collects garbage.
    parts: the partitions of its shuffles, where they aren't the session's; sides dealt to them by some of a join's keys stay as they are."""
    new = {FREES: "true"} | ({PARTS: str(parts), ALL_KEYS: "false"} if parts else {})
    before = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """df as a table written to the folder that the cluster shares and read again: one pass, and the next plan knows its size, so that
    small rounds join by broadcast."""
    path = new_path(df.sparkSession)
    with _freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """The tables of a loop's rounds in one folder: each is written once, all are read together with the number of their round.
    parts: the partitions of a round's shuffles, where they aren't the session's."""

    def __init__(self, spark: SparkSession, number: str, parts: int | None = None) -> None:
        self.spark, self.path, self.number, self.parts, self.n, self.schema = spark, new_path(spark), number, parts, 0, None

    def add(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{self.number}={self.n}"
        with _freed(self.spark, self.parts):
            df.write.parquet(path)
        self.n, self.schema = self.n + 1, self.schema or df.schema
        return self.spark.read.schema(self.schema).parquet(path)

    def read(self) -> DataFrame:
        """The rounds so far, from 0."""
        return self.spark.read.schema(StructType([*self.schema.fields, StructField(self.number, IntegerType())])).parquet(self.path)


def drop(df: DataFrame) -> None:
    """Deletes the files of a cut table that no later step reads."""
    spark = df.sparkSession
    for name in {os.path.dirname(f) for f in df.inputFiles() if "/kgloom-cut/" in f}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
