"""Shared scratch space: the one place where jobs leave intermediate tables.

The folder is the cluster's ``spark.checkpoint.dir``; only a local session that
names none (unit tests) gets a temporary one of its own.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can read and write.

    A cluster must name it: a temporary folder of the driver is invisible to executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = spark.conf.get("spark.recordloom.scratch", None)
    if not own:
        own = tempfile.mkdtemp(prefix="recordloom-")
        spark.conf.set("spark.recordloom.scratch", own)
        spark.sparkContext.setCheckpointDir(own)
    return own


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared space, wherever its file system is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    This cuts lineage: a lost executor re-reads files instead of recomputing
    the plan, and a result used twice is computed once.
    """
    return _stored(df, f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}")


class Scratch:
    """Intermediate tables of one job; ``drop`` deletes one, ``close`` all of them.

    What a job returns must not read from here once it is closed: results are
    stored by ``materialize``.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """As ``materialize``; ``name`` may be used once."""
        return _stored(df, f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.path}/{name}")

    def close(self) -> None:
        delete(self.spark, self.path)
