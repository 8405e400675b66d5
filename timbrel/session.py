"""Session settings the library relies on, and the folder all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is set a temporary one is made on a local master; a cluster must name one."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        configured = sc.getConf().get("spark.checkpoint.dir", None)
        if configured is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="timbrel-"))
        current = sc.getCheckpointDir()
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    return (configured or current).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for a table that one query writes and reads again."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; its partitions stay as they are."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, for what is read by columns or more than once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, so that tasks find it wherever the driver runs from."""
    sc = spark.sparkContext
    if getattr(sc, "_timbrel_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="timbrel-"), "timbrel.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    sc._timbrel_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
