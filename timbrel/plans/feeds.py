"""Queries through files and streams that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbrel.functions.text import instant_micros
from timbrel.operators import intervals
from timbrel.operators.keyed import numbered
from timbrel.plans import deliveries
from timbrel.session import shared_path, table
from timbrel.sources import jsonl, tabular
from timbrel.sources.pages import read_pages
from timbrel.streaming import state


def jsonl_lenient(s: SparkSession, d: str) -> DataFrame:
    """Deliveries written as JSON lines, those without a readable instant cut short, and read leniently."""
    path = shared_path(s, "lines")
    raw = table(s, d, "transcripts_raw").select("raw_id", "video_id", "language_code", instant_micros("fetched_at").isNull().alias("cut"))
    line = F.to_json(F.struct("raw_id", "video_id", "language_code"))
    raw.select(F.when(F.col("cut"), F.substring(line, F.lit(1), F.length(line) - 2)).otherwise(line).alias("value")).write.text(path)
    return jsonl.read_lenient(s, path, "raw_id bigint, video_id string, language_code string")


def jsonl_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Whole payloads written as ordered JSON lines and read strictly."""
    path = shared_path(s, "payloads")
    raw = table(s, d, "transcripts_raw").select("raw_id", "video_id", "is_generated", "segments")
    jsonl.write_jsonl(raw, path, ["raw_id"])
    back = jsonl.read_strict(s, path, raw.schema)
    return back.select("raw_id", "video_id", "is_generated", F.coalesce(F.size("segments"), F.lit(-1)).alias("segments"), F.length(F.array_join(F.transform("segments", lambda x: x["text"]), "\n")).alias("characters"))


def numbered_lines(s: SparkSession, d: str) -> DataFrame:
    """Lines of each file with their numbers: every file counts 1, 2, 3, ... to its end."""
    path = shared_path(s, "numbered")
    jsonl.write_jsonl(table(s, d, "videos").select("video_id", "title"), path)
    lines = jsonl.read_numbered_lines(s, path)
    per = lines.groupBy("file").agg(F.count("*").alias("n"), F.min("line").alias("lo"), F.max("line").alias("hi"), F.count_distinct("line").alias("k"))
    return per.agg(F.sum("n").alias("lines"), F.count_if(F.expr("lo <> 1 or hi <> n or k <> n")).alias("misnumbered"))


def csv_round_trip(s: SparkSession, d: str) -> DataFrame:
    path = shared_path(s, "csv")
    v = table(s, d, "videos").select("video_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("description", F.lit("")).alias("description"), F.col("view_count").cast("string").alias("view_count"))
    tabular.write_csv(v, path)
    return tabular.read_csv(s, path).select("video_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("description", F.lit("")).alias("description"), "view_count")


def landed_pages(s: SparkSession, d: str) -> DataFrame:
    """Videos of each channel written as API answers of fifty, and the items read back with their places."""
    path = shared_path(s, "pages")
    n = numbered(table(s, d, "videos").select("source_id", "video_id", "title"), ["source_id"], ["video_id"])
    item = F.struct(((F.col("number") - 1) % 50).alias("i"), F.struct("video_id", "title").alias("item"))
    # an answer has fifty items at most
    pages = n.groupBy("source_id", F.floor((F.col("number") - 1) / 50).alias("page")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    answer = F.to_json(F.struct(F.transform("items", lambda x: x["item"]).alias("items"), F.when(F.size("items") == 50, F.concat_ws("-", "source_id", "page")).alias("nextPageToken")))
    pages.select(answer.alias("value")).write.text(path)
    got = read_pages(s, path).select("position", F.from_json("item", "video_id string, title string").alias("i"), F.col("token").isNotNull().alias("more"))
    return got.select("i.video_id", "i.title", "position", "more")


def stream_latest_event(s: SparkSession, d: str) -> DataFrame:
    """The latest event of each user from a log that arrives in several files."""
    path = shared_path(s, "events")
    table(s, d, "events").select("user_id", "event_id", "event_type").where("user_id is not null and event_type <> ''").repartitionByRange(4, "event_id").write.parquet(path)
    log = s.readStream.schema("user_id bigint, event_id bigint, event_type string").option("maxFilesPerTrigger", 1).parquet(path)
    return state.latest_of_log(s, log, ["user_id"], "event_id")


def stream_coverage(s: SparkSession, d: str) -> DataFrame:
    """Coverage of each payload from a stream whose intervals arrive mixed, in three batches."""
    return intervals.coverage(deliveries.segment_state(s, d, batches=3)).withColumnRenamed("entity", "raw_id")


QUERIES = {f.__name__: f for f in (jsonl_lenient, jsonl_round_trip, numbered_lines, csv_round_trip, landed_pages, stream_latest_event, stream_coverage)}

_READABLE = r"regexp_matches(coalesce(fetched_at, ''), '^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$')"
SQL = {
    "jsonl_lenient": f"select raw_id, video_id, language_code from transcripts_raw where {_READABLE}",
    "jsonl_round_trip": "select raw_id, video_id, is_generated, cast(coalesce(len(segments), -1) as int) as segments, cast(length(array_to_string(list_transform(segments, lambda x: x.text), chr(10))) as int) as characters from transcripts_raw",
    "numbered_lines": "select count(*) as lines, cast(0 as bigint) as misnumbered from videos",
    "csv_round_trip": "select video_id, coalesce(title, '') as title, coalesce(description, '') as description, cast(view_count as varchar) as view_count from videos",
    "landed_pages": """with n as (select *, row_number() over (partition by source_id order by video_id) - 1 as k from videos)
      select video_id, title, cast(k % 50 as int) as position, count(*) over (partition by source_id, k // 50) = 50 as more from n""",
    "stream_latest_event": "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events where user_id is not null and event_type <> '' group by 1",
    "stream_coverage": deliveries.SQL["p3_coverage"],
}
