"""CSV, plain id lists, JDBC, small report files and snapshots that may not change."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbrel.functions.text import strip
from timbrel.operators.keyed import same_rows


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; quoted line breaks and doubled quotes; a byte-order mark is no part of the first name."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").csv(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a text file with one a line; blank lines are none."""
    return spark.read.text(path).select(strip("value").alias("id")).where("id <> ''").distinct()


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    """A file that holds one array of objects, or one object."""
    return spark.read.option("multiLine", True).json(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A relational table read by `parts` tasks, each a range of a numeric column."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def write_report(df: DataFrame, path: str, order: list[str], most: int = 10_000) -> bool:
    """A small report as one CSV file with byte-order mark and CRLF on the shared file system; refused above `most` rows.

    Returns whether it differed from the file that was there. The text is made by Spark in one task
    of at most `most` rows, and the finished file is moved into place by the file system.
    """
    spark = df.sparkSession
    ordered = df.orderBy(*order).limit(most + 1)
    quoted = [F.when(F.col(c).cast("string").rlike('[",\r\n]'), F.concat(F.lit('"'), F.regexp_replace(F.col(c).cast("string"), '"', '""'), F.lit('"'))).otherwise(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns]
    lines = [r[0] for r in ordered.select(F.concat_ws(",", *quoted)).collect()]
    if len(lines) > most:
        raise ValueError(f"a report has at most {most} rows")
    head = ",".join(f'"{c.replace(chr(34), 2 * chr(34))}"' if set(c) & set('",\r\n') else c for c in df.columns)
    content = "\ufeff" + "".join(f"{x}\r\n" for x in [head, *lines])
    return replace_file(spark, path, content.encode())


def replace_file(spark: SparkSession, path: str, content: bytes) -> bool:
    """Make `content` the whole of a small file of any Hadoop file system; False if it is so already.

    The new file is closed under a name of its own before one rename puts it in the old one's place.
    """
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    if context.util().exists(target) and bytes(context.open(target).readAllBytes()) == content:
        return False
    fresh = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = fresh.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(fresh)
    stream.write(bytearray(content))
    stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(fresh, target, options)
    return True


def require_snapshot(df: DataFrame, path: str) -> bool:
    """Write an immutable snapshot if it is missing (True); if it is there, raise unless it holds the same rows (False)."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        df.write.parquet(path)
        return True
    if not same_rows(df, spark.read.parquet(path)):
        raise ValueError(f"the snapshot {path} differs")
    return False


def append_verified(df: DataFrame, path: str, commit: bool = False) -> dict:
    """Append and check that the count grew by exactly the rows given; without `commit` only the plan is returned."""
    spark, n = df.sparkSession, df.count()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    before = spark.read.parquet(path).count() if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else 0
    plan = {"before": before, "pending": n, "expected": before + n, "committed": False}
    if commit:
        df.write.mode("append").parquet(path)
        after = spark.read.parquet(path).agg(F.count("*")).first()[0]
        if after != before + n:
            raise RuntimeError(f"{after} rows after the load, {before + n} expected")
        plan["committed"] = True
    return plan
