"""Queries on delivered payloads: continuous periods and gaps, and one copy of each message."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbrel.functions.text import instant_micros, millis, strip
from timbrel.operators import intervals
from timbrel.operators.messages import MessageStore
from timbrel.session import shared_path, table
from timbrel.streaming import state


def segment_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, start_ms, end_ms) of the valid segments: start >= 0 and duration > 0."""
    seg = table(spark, sf, "transcripts_raw").select(F.col("raw_id").alias("entity"), F.explode("segments").alias("s"))
    seg = seg.select("entity", millis("s.start").alias("start_ms"), millis("s.duration").alias("dur_ms"))
    return seg.where("start_ms >= 0 and dur_ms > 0").select("entity", "start_ms", F.expr("start_ms + dur_ms").alias("end_ms"))


def segment_state(spark: SparkSession, sf: str, batches: int = 1) -> DataFrame:
    """The interval maps of all payloads, grown as keyed state by a stream of their intervals that arrives in some batches."""
    path = shared_path(spark, "intervals")
    x = segment_intervals(spark, sf)
    (x.repartition(batches, "start_ms") if batches > 1 else x).write.parquet(path)
    stream = spark.readStream.schema(x.schema)
    stream = stream.option("maxFilesPerTrigger", 1) if batches > 1 else stream
    return state.keyed_state(spark, stream.parquet(path))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.gaps(segment_state(spark, sf)).withColumnRenamed("entity", "raw_id")


def p3_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.coverage(segment_state(spark, sf)).withColumnRenamed("entity", "raw_id")


def p3_periods(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.periods(segment_state(spark, sf)).withColumnRenamed("entity", "raw_id")


def periods_in_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The same periods without a stream, by one map at a time over range-partitioned starts."""
    return intervals.periods(intervals.interval_state(segment_intervals(spark, sf))).withColumnRenamed("entity", "raw_id")


def messages(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """Deliveries with their message (video, instant) and the month of their batch."""
    raw = table(spark, sf, "transcripts_raw")
    month = F.nullif(F.regexp_extract(F.col("bronze_file"), r"(\d{6})\d\d", 1), F.lit(""))
    return raw.select("raw_id", strip("video_id").alias("video"), instant_micros("fetched_at").alias("instant"), month.alias("month"), *more)


def delivered_store(spark: SparkSession, rows: DataFrame, batches: int = 2) -> MessageStore:
    """A store fed with the deliveries in order, in a few batches: history first, then what came later."""
    store = MessageStore(spark, shared_path(spark, "messages"), ["video", "instant"], "raw_id", "month")
    low, high = rows.agg(F.min("raw_id"), F.max("raw_id")).first()
    if low is None:
        store.upsert(rows)
        return store
    for i in range(batches):
        a, b = (low + (high + 1 - low) * k // batches for k in (i, i + 1))
        store.upsert(rows.where((F.col("raw_id") >= a) & (F.col("raw_id") < b)))
    return store


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = messages(spark, sf)
    kept = delivered_store(spark, rows).read()
    readable = rows.where("video is not null and instant is not null").select("raw_id")
    return readable if kept is None else readable.join(kept.select("raw_id"), "raw_id", "left_anti").distinct()


def p5_unique(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each message, with the size of the copy kept and the number of copies delivered."""
    rows = messages(spark, sf, "bronze_file", F.size("segments").alias("n_segments"))
    kept = delivered_store(spark, rows).read()
    if kept is None:
        kept = rows.dropna(subset=["video", "instant"])
    copies = rows.groupBy("video", "instant").agg(F.count("*").alias("copies"), F.countDistinct("bronze_file").alias("batches"))
    return kept.join(copies, ["video", "instant"]).select("raw_id", "video", "instant", "n_segments", "copies", "batches")


QUERIES = {f.__name__: f for f in (p3_found, p3_coverage, p3_periods, periods_in_batch, p5_found, p5_unique)}

_VALID = """
valid as (
  select raw_id, cast(round(s.start * 1000) as bigint) as a,
         cast(round(s.start * 1000) as bigint) + cast(round(s.duration * 1000) as bigint) as b
  from (select raw_id, unnest(segments) as s from transcripts_raw) where s.start >= 0 and s.duration > 0),
marked as (
  select *, max(b) over (partition by raw_id order by a, b rows between unbounded preceding and 1 preceding) as reach
  from valid)"""

_MESSAGES = r"""
stamped as (
  select raw_id, bronze_file, len(segments) as n, regexp_replace(video_id, '^\s+|\s+$', '', 'g') as video,
         case when regexp_matches(fetched_at, '^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$')
              then epoch_us(cast(fetched_at as timestamptz)) end as instant
  from transcripts_raw)"""

SQL = {
    "p3_found": f"with {_VALID} select raw_id, reach as gap_start_ms, a as gap_end_ms from marked where a > reach",
    "p3_coverage": f"""with {_VALID},
      holes as (select raw_id, cast(sum(a - reach) as bigint) as g, count(*) as n from marked where a > reach group by raw_id),
      span as (select raw_id, min(a) as lo, max(b) as hi from valid group by raw_id)
      select raw_id, lo as first_ms, hi as last_ms, hi - lo - coalesce(g, 0) as covered_ms, coalesce(g, 0) as gap_ms, coalesce(n, 0) + 1 as periods
      from span left join holes using (raw_id)""",
    "p3_periods": f"""with {_VALID},
      island as (select *, sum(case when reach is null or a > reach then 1 else 0 end) over (partition by raw_id order by a, b rows unbounded preceding) as k from marked)
      select raw_id, min(a) as start_ms, max(b) as end_ms from island group by raw_id, k""",
    "periods_in_batch": f"""with {_VALID},
      island as (select *, sum(case when reach is null or a > reach then 1 else 0 end) over (partition by raw_id order by a, b rows unbounded preceding) as k from marked)
      select raw_id, min(a) as start_ms, max(b) as end_ms from island group by raw_id, k""",
    "p5_found": f"""with {_MESSAGES},
      ranked as (select raw_id, row_number() over (partition by video, instant order by raw_id) as rn from stamped where video is not null and instant is not null)
      select raw_id from ranked where rn > 1""",
    "p5_unique": f"""with {_MESSAGES}
      select min(raw_id) as raw_id, video, instant, cast(nullif(arg_min(coalesce(n, -1), raw_id), -1) as int) as n_segments, count(*) as copies, count(distinct bronze_file) as batches
      from stamped where video is not null and instant is not null group by video, instant""",
}
