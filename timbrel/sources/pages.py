"""Paged API answers that have landed as files: one answer a line, or one a file, each with its items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path: str, one_a_file: bool = False, items: str = "items") -> DataFrame:
    """(file, page, token, position, item): the items of every answer as JSON text, with the answer's place and next page token.

    Read by Spark from any file system. page tells the answers of a file apart, in their order; an answer without items has none, one that isn't JSON has none either.
    """
    text = spark.read.text(path, wholetext=one_a_file, lineSep=None if one_a_file else "\n")
    x = text.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("page"), F.try_parse_json("value").alias("t"))
    x = x.select("file", "page", F.try_variant_get("t", "$.nextPageToken", "string").alias("token"), F.posexplode(F.try_variant_get("t", f"$.{items}", "array<variant>")).alias("position", "item"))
    return x.withColumn("item", F.to_json("item"))
