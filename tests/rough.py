"""The smallest tables emptied, and the same with nulls in every column, repeated rows and a column too many."""

from __future__ import annotations

import glob
import os

from pyspark.sql import functions as F


def emptied(spark, sf: str, out: str) -> str:
    for p in glob.glob(f"{sf}/*.parquet"):
        spark.read.parquet(p).limit(0).write.parquet(f"{out}/{os.path.basename(p)}")
    return out


def roughened(spark, sf: str, out: str) -> str:
    for p in glob.glob(f"{sf}/*.parquet"):
        x = spark.read.parquet(p)
        y = x.withColumn("_h", F.monotonically_increasing_id())
        z = y.select(*[F.when((F.col("_h") * 7 + i * 3) % 5 != 0, F.col(c)).alias(c) for i, c in enumerate(x.columns)])
        if "segments" in x.columns:
            gone = lambda g, i: F.when(i % 6 != 5, F.struct(F.when(i % 4 != 1, g["text"]).alias("text"), F.when(i % 5 != 2, g["start"]).alias("start"), F.when(i % 7 != 3, g["duration"]).alias("duration")))
            z = z.withColumn("segments", F.transform("segments", gone))
        z.unionByName(z.limit(5)).withColumn("tokens", F.lit(1)).write.parquet(f"{out}/{os.path.basename(p)}")
    return out
