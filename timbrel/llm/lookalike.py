"""Problem 4: texts that look the same but are stored with differing characters.

The consistent form is computed on code-point arrays (codepoints.py). Texts are compared by 128-bit
digests, so that only ids and digests are shuffled. Null text takes part in nothing; empty text
looks like text of invisible characters only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbrel.functions.text import strip
from timbrel.llm import codepoints
from timbrel.session import cut, ship, table


def consistent_text(df: DataFrame, column: str, fold_case: bool = False) -> DataFrame:
    """The table with one string column in its consistent form; other columns and nulls as they are."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(at, b.schema.field(at), codepoints.consistent(b.column(at), fold_case))

    ship(df.sparkSession)
    return df.mapInArrow(run, df.schema)


def stored_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(tbl, id, video, text) of every row: raw_text of transcripts, and the joined segments of each delivery."""
    a = table(spark, sf, "transcripts").select(F.lit("transcripts").alias("tbl"), F.col("transcript_id").cast("bigint").alias("id"), strip("video_id").alias("video"), F.col("raw_text").alias("text"))
    joined = F.array_join(F.transform("segments", lambda s: s["text"]), "\n")
    b = table(spark, sf, "transcripts_raw").select(F.lit("transcripts_raw").alias("tbl"), F.col("raw_id").alias("id"), strip("video_id").alias("video"), joined.alias("text"))
    return a.unionByName(b)


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """The stored texts that can be compared: those with a video and a text."""
    return stored_texts(spark, sf).where("video is not null and text is not null")


def digests(texts: DataFrame) -> DataFrame:
    """(tbl, id, video, exact, look): digests of each text as stored and in its consistent form."""
    keyed = texts.select("tbl", "id", "video", F.unhex(F.md5("text")).alias("exact"), "text")
    return consistent_text(keyed, "text").select("tbl", "id", "video", "exact", F.unhex(F.md5("text")).alias("look"))


def look_alike_pairs(rows: DataFrame) -> DataFrame:
    """(tbl, id_a, id_b) of different strings with one look; exact copies alone make no class.

    Classes with two spellings are found by a partial aggregation; only their members are joined
    with each other, on (tbl, video, look), where adaptive execution splits a hot class.
    """
    rows = cut(rows)
    classes = rows.groupBy("tbl", "video", "look").agg(F.min("exact").alias("lo"), F.max("exact").alias("hi")).where("lo <> hi").select("tbl", "video", "look")
    members = rows.join(classes, ["tbl", "video", "look"], "left_semi")
    a, b = members.alias("a"), members.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("tbl", "video", "look")]
    pairs = a.join(b, [*same, F.col("a.id") < F.col("b.id"), F.col("a.exact") != F.col("b.exact")])
    return pairs.select("a.tbl", F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return look_alike_pairs(digests(texts(spark, sf)))


def p4_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Each text with its class (the smallest id of the same video and look) and the class's spellings."""
    rows = cut(digests(texts(spark, sf)))
    classes = rows.groupBy("tbl", "video", "look").agg(F.min("id").alias("class_id"), F.count_distinct("exact").alias("spellings"), F.count("*").alias("members"))
    return rows.join(classes, ["tbl", "video", "look"]).select("tbl", "id", "class_id", "spellings", "members")


def p4_consistent(spark: SparkSession, sf: str) -> DataFrame:
    """(tbl, id, consistent_text) of every transcript and every delivery; null stays null."""
    return consistent_text(stored_texts(spark, sf).select("tbl", "id", F.col("text").alias("consistent_text")), "consistent_text")


QUERIES = {f.__name__: f for f in (p4_found, p4_classes, p4_consistent)}
SQL: dict[str, str] = {}
