"""Line-delimited JSON: exact lines with their numbers, strict and lenient reading, ordered writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from timbrel.operators.keyed import numbered


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): lines split at line feeds only, one trailing carriage return removed."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r$", "").alias("value"))


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value), lines counted from 1 in each file, however many tasks read it.

    A split's lines keep their order within a task; splits are ordered by their offset in the file.
    """
    text = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_seq"), F.regexp_replace("value", "\r$", "").alias("value"))
    return numbered(text, ["file"], ["_block", "_seq"], "line").select("file", "line", "value")


def read_lenient(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of the lines that are JSON objects; other lines, blank ones too, are left out."""
    lines = read_lines(spark, path).where(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"))
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_strict(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of all lines; a line that is no JSON raises an error with its file and number. Lines are numbered only if there is one."""
    bad = F.try_parse_json("value").isNull()
    lines = read_lines(spark, path)
    if not lines.where(bad).isEmpty():
        first = read_numbered_lines(spark, path).where(bad).orderBy("file", "line").select("file", "line").first()
        raise ValueError(f"{first['file']}, line {first['line']}: not JSON")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_exact_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value binary): the bytes of each line as they are, split at line feeds, invalid UTF-8 and carriage returns included."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))


def with_source_hash(lines: DataFrame) -> DataFrame:
    """Lines with the SHA-256 of their bytes."""
    return lines.withColumn("source_sha256", F.sha2(F.col("value").cast("binary"), 256))


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.option("lineSep", "\n").text(path).count()


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Compact objects, keys in column order, nulls written; in `order` over the files' names if given."""
    out = df.orderBy(*order) if order else df
    out.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path, lineSep="\n")
