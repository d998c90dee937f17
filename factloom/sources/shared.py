"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; a temporary one only where that is unset and all tasks run in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='factloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


class Workspace:
    """Written tables of one run in the shared folder. They cut lineage and outlive the executors that wrote them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.kept: list[DataFrame] = []

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """df written and read again; without Hadoop's mark of success, which nobody reads and for which a local file system starts a process from the driver."""
        df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def keep(self, df: DataFrame) -> DataFrame:
        """df on the executors' disks until ``release``; parts that a lost executor had are made again."""
        self.kept.append(df.persist(StorageLevel.DISK_ONLY))
        return self.kept[-1]

    def release(self) -> None:
        while self.kept:
            self.kept.pop().unpersist()

    def settle(self) -> None:
        """Let Spark delete the files of shuffles that nothing refers to any more, before a step that needs the room."""
        gc.collect()
        self.spark._jvm.System.gc()

    def close(self) -> None:
        """Delete all tables of this run, when nothing reads them any more."""
        self.release()
        self.drop("")

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        jvm, path = self.spark._jvm, self.path(name)
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
