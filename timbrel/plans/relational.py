"""Relational audit of the corpus tables: summaries, joins, set relations, guarded inserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timbrel.functions.text import strip
from timbrel.operators import keyed
from timbrel.session import table


def year_summary(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "videos").withColumn("year", F.coalesce(F.year("publish_date").cast("string"), F.lit("unknown")))
    return v.groupBy("year").agg(F.count("*").alias("videos"), F.count("duration_seconds").alias("with_duration"), F.min("duration_seconds").alias("min_duration"), F.max("duration_seconds").alias("max_duration"), F.round(F.avg("duration_seconds"), 4).alias("avg_duration"))


def source_summary(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "videos").select("source_id", "video_id", "publish_date", "duration_seconds")
    # videos are reduced to one row per source before the join, so the large channels shuffle nothing
    per = v.groupBy("source_id").agg(F.count("video_id").alias("n"), F.min("publish_date").alias("lo"), F.max("publish_date").alias("hi"), F.avg("duration_seconds").alias("a"))
    j = table(s, d, "sources").join(per, "source_id", "left")
    return j.select("source_id", "source_name", F.coalesce("n", F.lit(0)).alias("videos"), F.col("lo").cast("string").alias("first_published"), F.col("hi").cast("string").alias("last_published"), F.round("a", 4).alias("avg_duration"))


def transcript_detail(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "transcripts").select("transcript_id", "video_id", "language", F.length("raw_text").alias("transcript_length"))
    v = table(s, d, "videos").select("video_id", "title", "duration_seconds")
    return t.join(v, "video_id").select("transcript_id", "video_id", "title", "duration_seconds", "language", "transcript_length")


def table_counts(s: SparkSession, d: str) -> DataFrame:
    names = ["sources", "videos", "transcripts", "chunks", "documents"]
    parts = [table(s, d, n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def videos_with_transcripts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "videos").select("video_id", "title").join(table(s, d, "transcripts"), "video_id", "left_semi")


def delivered_without_video(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "transcripts_raw").select(strip("video_id").alias("video_id"))
    return raw.join(table(s, d, "videos"), "video_id", "left_anti").groupBy("video_id").agg(F.count("*").alias("deliveries"))


def videos_without_transcript(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "videos").select("video_id", "source_id").join(table(s, d, "transcripts"), "video_id", "left_anti")


def _targets(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eval_questions").select(F.explode("relevant_video_ids").alias("video_id")).distinct()


def target_metadata(s: SparkSession, d: str) -> DataFrame:
    """Videos that the evaluation set names, with how many transcripts each has."""
    t = table(s, d, "transcripts").join(_targets(s, d), "video_id", "left_semi").groupBy("video_id").agg(F.count("*").alias("n"))
    v = table(s, d, "videos").join(_targets(s, d), "video_id", "left_semi")
    return v.join(t, "video_id", "left").select("video_id", "title", F.coalesce("n", F.lit(0)).alias("transcripts"))


def duplicate_videos(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "transcripts").groupBy("video_id").agg(F.count("*").alias("n")).where("n > 1")


def missing_fields(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "videos")
    empty = {"title": "coalesce(title, '') = ''", "description": "coalesce(description, '') = ''", "publish_date": "publish_date is null", "duration_seconds": "coalesce(duration_seconds, 0) = 0", "view_count": "view_count is null"}
    return keyed.long_metrics(v.agg(F.count("*").alias("records"), *(F.count_if(F.expr(e)).alias(f"missing_{k}") for k, e in empty.items())))


def orphans(s: SparkSession, d: str) -> DataFrame:
    v, t, c = table(s, d, "videos"), table(s, d, "transcripts"), table(s, d, "chunks")
    pairs = [("videos.source_id", v, table(s, d, "sources"), "source_id"), ("transcripts.video_id", t, v, "video_id"), ("chunks.transcript_id", c, t, "transcript_id")]
    parts = [a.select(k).join(b.select(k), k, "left_anti").agg(F.count("*").alias("orphans")).select(F.lit(n).alias("reference"), "orphans") for n, a, b, k in pairs]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def number_stats(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "videos")
    parts = [v.agg(F.lit(c).alias("field"), F.count(c).alias("n"), F.min(c).cast("bigint").alias("lo"), F.max(c).cast("bigint").alias("hi"), F.round(F.avg(c), 2).alias("mean")) for c in ("duration_seconds", "view_count")]
    return parts[0].unionByName(parts[1])


def most_viewed(s: SparkSession, d: str) -> DataFrame:
    """A top-k report: the twenty most viewed videos."""
    return table(s, d, "videos").where("view_count is not null").orderBy(F.desc("view_count"), "video_id").limit(20).select("video_id", "title", "view_count")


def insert_if_absent(s: SparkSession, d: str) -> DataFrame:
    """Delivered videos that the transcripts lack, first delivery first."""
    incoming = table(s, d, "transcripts_raw").select(strip("video_id").alias("video_id"), "raw_id", "language_code")
    return keyed.insert_if_absent(table(s, d, "transcripts"), incoming, ["video_id"], "raw_id").select("video_id", "raw_id", "language_code")


def insert_plan(s: SparkSession, d: str) -> DataFrame:
    incoming = table(s, d, "transcripts_raw").select(strip("video_id").alias("video_id"), "raw_id")
    return keyed.insert_plan(table(s, d, "transcripts"), incoming, ["video_id"], "raw_id")


def id_set_relations(s: SparkSession, d: str) -> DataFrame:
    """Video ids of videos, transcripts and documents: differences, union and intersection, counted."""
    v, t, x = (table(s, d, n).select("video_id").where("video_id is not null") for n in ("videos", "transcripts", "documents"))
    sets = {"videos - transcripts": v.exceptAll(t.distinct()).distinct(), "videos - documents": v.subtract(x), "documents - transcripts": x.subtract(t), "documents | transcripts": x.union(t).distinct(), "documents & transcripts": x.intersect(t)}
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("relation"), "n") for k, df in sets.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def latest_event(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").where("user_id is not null and event_type <> ''").select("user_id", "event_id", "event_type")
    return keyed.latest(e, ["user_id"], "event_id")


def history_and_latest(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("user_id", "event_id", F.coalesce("event_type", F.lit("missing")).alias("status"))
    a = e.groupBy("status").agg(F.count("*").alias("history"))
    b = keyed.latest(e, ["user_id"], "event_id").groupBy("status").agg(F.count("*").alias("latest"))
    return a.join(b, "status", "full").select("status", F.coalesce("history", F.lit(0)).alias("history"), F.coalesce("latest", F.lit(0)).alias("latest"))


def last_wins_pairs(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return keyed.latest(x, ["l_orderkey", "l_partkey"], "l_linenumber")


def first_seen_videos(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "transcripts_raw").select(strip("video_id").alias("video_id"), "raw_id")
    return keyed.first_seen(raw, ["video_id"], "raw_id")


def source_labels(s: SparkSession, d: str) -> DataFrame:
    """Per video: kinds of its documents as one ordered string, and its domain if all agree."""
    x = table(s, d, "documents").where("video_id is not null").select("video_id", "doc_kind", F.nullif(F.col("topic_domain"), F.lit("unresolved")).alias("domain"))
    kinds = F.array_join(F.array_sort(F.collect_set("doc_kind")), " | ")
    return x.groupBy("video_id").agg(kinds.alias("kinds"), keyed.unanimous("domain").alias("domain"), F.count("*").alias("documents"))


def domain_share(s: SparkSession, d: str) -> DataFrame:
    return keyed.shares(table(s, d, "documents").select(F.coalesce("topic_domain", F.lit("unresolved")).alias("domain")), ["domain"])


def common_language(s: SparkSession, d: str) -> DataFrame:
    """Most frequent language code of each channel's deliveries, the first delivered of equals."""
    raw = table(s, d, "transcripts_raw").select(strip("video_id").alias("video_id"), "raw_id", "language_code")
    j = raw.join(table(s, d, "videos").select("video_id", "source_id"), "video_id")
    return keyed.mode_first_seen(j, ["source_id"], "language_code", "raw_id")


def length_bands(s: SparkSession, d: str) -> DataFrame:
    n = F.length("raw_text")
    band = F.when(n < 5000, "<5k").when(n < 20000, "5k-20k").when(n < 50000, "20k-50k").otherwise(">=50k")
    t = table(s, d, "transcripts").where("raw_text is not null").select(band.alias("band"), n.alias("n"))
    return t.groupBy("band").agg(F.count("*").alias("transcripts"), F.sum("n").alias("characters"), F.percentile("n", 0.5).alias("median_length"))


def coverage(s: SparkSession, d: str) -> DataFrame:
    """Part of each channel's videos that have a transcript."""
    have = table(s, d, "transcripts").select("video_id").distinct().withColumn("has", F.lit(1))
    v = table(s, d, "videos").select("video_id", "source_id").join(have, "video_id", "left")
    return v.groupBy("source_id").agg(F.count("*").alias("videos"), F.count("has").alias("with_transcript"), F.round(F.count("has") / F.count("*"), 6).alias("coverage"))


def any_manual(s: SparkSession, d: str) -> DataFrame:
    """Per video whether any delivery wasn't generated by machine."""
    raw = table(s, d, "transcripts_raw").select(strip("video_id").alias("video_id"), "is_generated")
    return raw.groupBy("video_id").agg(F.max(~F.col("is_generated")).alias("any_manual"), F.count_if("is_generated").alias("generated"), F.count("*").alias("deliveries"))


def batches_of_50(s: SparkSession, d: str) -> DataFrame:
    """Videos of each channel in batches of fifty, in the order of their ids."""
    n = keyed.numbered(table(s, d, "videos").select("source_id", "video_id"), ["source_id"], ["video_id"])
    b = n.withColumn("batch", F.floor((F.col("number") - 1) / 50))
    return b.groupBy("source_id", "batch").agg(F.count("*").alias("n"), F.min("video_id").alias("first_id"), F.max("video_id").alias("last_id"))


def top_videos_by_source(s: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("source_id").orderBy(F.desc("view_count"), "video_id")
    v = table(s, d, "videos").where("view_count is not null").select("source_id", "video_id", "view_count", F.row_number().over(w).alias("place"))
    return v.where("place <= 5")


def chunk_contiguity(s: SparkSession, d: str) -> DataFrame:
    return keyed.contiguity(table(s, d, "chunks"), ["transcript_id"], "chunk_index")


def status_overview(s: SparkSession, d: str) -> DataFrame:
    """One row of buckets, as metrics."""
    e = table(s, d, "events")
    return keyed.long_metrics(e.agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("event_type").isin("click", "view")).alias("looked"), F.count_if(F.col("event_type") == "error").alias("failed")))


def props_profile(s: SparkSession, d: str) -> DataFrame:
    """Fields of a JSON column: rows that have one, rows without, other types than a number."""
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "string")
    whole = F.try_parse_json("props")
    return table(s, d, "events").agg(F.count("*").alias("total_records"), F.count(v).alias("present_count"), F.count_if(v.isNull()).alias("missing_count"), F.count_if(whole.isNull()).alias("unreadable_count"), F.count_if(v.isNotNull() & v.try_cast("double").isNull()).alias("invalid_type_count"))


#: Least and most approved questions of each category, and of all.
TARGETS = {"factual": (20, 60), "conceptual": (20, 60), "procedural": (10, 40), "unanswerable": (10, 40), "all": (40, 160)}


def questions_by_category(s: SparkSession, d: str) -> DataFrame:
    """The evaluation set against a target range for each category and for all; a category without a target, or without questions, isn't in range."""
    q = table(s, d, "eval_questions").where("review_status = 'approved'").rollup("category").agg(F.count("*").alias("questions"), F.count_if("answerable").alias("answerable"), F.grouping("category").alias("g"))
    q = q.select(F.when(F.col("g") == 1, "all").otherwise(F.col("category")).alias("category"), "questions", "answerable")
    targets = s.createDataFrame([(k, *v) for k, v in TARGETS.items()], "category string, low int, high int")
    out = q.join(targets, "category", "full")
    n = F.coalesce("questions", F.lit(0))
    return out.select("category", n.alias("questions"), F.coalesce("answerable", F.lit(0)).alias("answerable"), F.coalesce(n.between(F.col("low"), F.col("high")), F.lit(False)).alias("in_target"))


QUERIES = {f.__name__: f for f in (year_summary, source_summary, transcript_detail, table_counts, videos_with_transcripts, delivered_without_video, videos_without_transcript, target_metadata, duplicate_videos, missing_fields, orphans, number_stats, most_viewed, insert_if_absent, insert_plan, id_set_relations, latest_event, history_and_latest, last_wins_pairs, first_seen_videos, source_labels, domain_share, common_language, length_bands, coverage, any_manual, batches_of_50, top_videos_by_source, chunk_contiguity, status_overview, props_profile, questions_by_category)}

_RAW = r"raw as (select regexp_replace(video_id, '^\s+|\s+$', '', 'g') as video_id, raw_id, language_code, is_generated from transcripts_raw)"
SQL = {
    "year_summary": "select coalesce(cast(year(publish_date) as varchar), 'unknown') as year, count(*) as videos, count(duration_seconds) as with_duration, min(duration_seconds) as min_duration, max(duration_seconds) as max_duration, round(avg(duration_seconds), 4) as avg_duration from videos group by 1",
    "source_summary": "select s.source_id, s.source_name, count(v.video_id) as videos, cast(min(publish_date) as varchar) as first_published, cast(max(publish_date) as varchar) as last_published, round(avg(duration_seconds), 4) as avg_duration from sources s left join videos v on v.source_id = s.source_id group by 1, 2",
    "transcript_detail": "select transcript_id, t.video_id, title, duration_seconds, language, cast(length(raw_text) as int) as transcript_length from transcripts t join videos v on v.video_id = t.video_id",
    "table_counts": " union all ".join(f"select '{n}' as table_name, count(*) as rows from {n}" for n in ("sources", "videos", "transcripts", "chunks", "documents")),
    "videos_with_transcripts": "select distinct v.video_id, v.title from videos v join transcripts t on t.video_id = v.video_id",
    "delivered_without_video": f"with {_RAW} select r.video_id, count(*) as deliveries from raw r left join videos v on v.video_id = r.video_id where v.video_id is null group by 1",
    "videos_without_transcript": "select v.video_id, v.source_id from videos v left join transcripts t on t.video_id = v.video_id where t.video_id is null",
    "target_metadata": "with x as (select distinct unnest(relevant_video_ids) as video_id from eval_questions) select v.video_id, title, (select count(*) from transcripts t where t.video_id = v.video_id) as transcripts from videos v where v.video_id in (select video_id from x)",
    "duplicate_videos": "select video_id, count(*) as n from transcripts group by 1 having count(*) > 1",
    "missing_fields": """with m as (select count(*) as records, count(*) filter (coalesce(title, '') = '') as missing_title, count(*) filter (coalesce(description, '') = '') as missing_description,
      count(*) filter (publish_date is null) as missing_publish_date, count(*) filter (coalesce(duration_seconds, 0) = 0) as missing_duration_seconds, count(*) filter (view_count is null) as missing_view_count from videos)
      select metric, cast(v as varchar) as value from (unpivot m on columns(*) into name metric value v)""",
    "orphans": "select 'videos.source_id' as reference, count(*) as orphans from videos v left join sources s on s.source_id = v.source_id where s.source_id is null union all select 'transcripts.video_id', count(*) from transcripts t left join videos v on v.video_id = t.video_id where v.video_id is null union all select 'chunks.transcript_id', count(*) from chunks c left join transcripts t on t.transcript_id = c.transcript_id where t.transcript_id is null",
    "number_stats": " union all ".join(f"select '{c}' as field, count({c}) as n, cast(min({c}) as bigint) as lo, cast(max({c}) as bigint) as hi, round(avg({c}), 2) as mean from videos" for c in ("duration_seconds", "view_count")),
    "most_viewed": "select video_id, title, view_count from videos where view_count is not null order by view_count desc, video_id limit 20",
    "insert_if_absent": f"with {_RAW} select video_id, min(raw_id) as raw_id, arg_min(language_code, raw_id) as language_code from raw where video_id is not null and video_id not in (select video_id from transcripts where video_id is not null) group by video_id",
    "insert_plan": f"""with {_RAW}, n as (select count(distinct video_id) as inserted from raw where video_id not in (select video_id from transcripts where video_id is not null)),
      o as (select count(*) as offered, count(*) filter (video_id is null) as refused from raw), b as (select count(*) as before from transcripts)
      select before, offered, refused, inserted, offered - refused - inserted as skipped, before + inserted as after from b, o, n""",
    "id_set_relations": """with v as (select distinct video_id from videos where video_id is not null), t as (select distinct video_id from transcripts where video_id is not null), x as (select distinct video_id from documents where video_id is not null)
      select 'videos - transcripts' as relation, count(*) as n from (select * from v except select * from t) union all select 'videos - documents', count(*) from (select * from v except select * from x)
      union all select 'documents - transcripts', count(*) from (select * from x except select * from t) union all select 'documents | transcripts', count(*) from (select * from x union select * from t)
      union all select 'documents & transcripts', count(*) from (select * from x intersect select * from t)""",
    "latest_event": "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events where user_id is not null and event_type <> '' group by 1",
    "history_and_latest": "with l as (select user_id, arg_max(coalesce(event_type, 'missing'), event_id) as status from events group by 1), h as (select coalesce(event_type, 'missing') as status, count(*) as history from events group by 1), n as (select status, count(*) as latest from l group by 1) select coalesce(h.status, n.status) as status, coalesce(history, 0) as history, coalesce(latest, 0) as latest from h full join n on h.status = n.status",
    "last_wins_pairs": "select l_orderkey, l_partkey, l_linenumber, l_quantity from lineitem qualify row_number() over (partition by l_orderkey, l_partkey order by l_linenumber desc, l_quantity desc) = 1",
    "first_seen_videos": f"with {_RAW} select video_id, min(raw_id) as first_seen from raw group by 1",
    "source_labels": "select video_id, string_agg(distinct doc_kind, ' | ' order by doc_kind) as kinds, case when count(distinct nullif(topic_domain, 'unresolved')) = 1 then min(nullif(topic_domain, 'unresolved')) else 'unresolved' end as domain, count(*) as documents from documents where video_id is not null group by 1",
    "domain_share": "select coalesce(topic_domain, 'unresolved') as domain, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 2) as percent from documents group by 1",
    "common_language": f"with {_RAW}, c as (select source_id, language_code, count(*) as n, min(raw_id) as seen from raw r join videos v on v.video_id = r.video_id where language_code is not null group by 1, 2) select source_id, language_code from c qualify row_number() over (partition by source_id order by n desc, seen) = 1",
    "length_bands": "with t as (select length(raw_text) as n from transcripts where raw_text is not null) select case when n < 5000 then '<5k' when n < 20000 then '5k-20k' when n < 50000 then '20k-50k' else '>=50k' end as band, count(*) as transcripts, cast(sum(n) as bigint) as characters, quantile_cont(n, 0.5) as median_length from t group by 1",
    "coverage": "with h as (select distinct video_id from transcripts) select source_id, count(*) as videos, count(h.video_id) as with_transcript, round(count(h.video_id) / count(*), 6) as coverage from videos v left join h on h.video_id = v.video_id group by 1",
    "any_manual": f"with {_RAW} select video_id, bool_or(not is_generated) as any_manual, count(*) filter (is_generated) as generated, count(*) as deliveries from raw group by 1",
    "batches_of_50": "with b as (select source_id, video_id, (row_number() over (partition by source_id order by video_id) - 1) // 50 as batch from videos) select source_id, cast(batch as bigint) as batch, count(*) as n, min(video_id) as first_id, max(video_id) as last_id from b group by 1, 2",
    "top_videos_by_source": "select source_id, video_id, view_count, cast(row_number() over (partition by source_id order by view_count desc, video_id) as int) as place from videos where view_count is not null qualify place <= 5",
    "chunk_contiguity": "select transcript_id, count(*) as n, min(chunk_index) = 0 and max(chunk_index) = count(*) - 1 and count(distinct chunk_index) = count(*) as contiguous from chunks group by 1",
    "status_overview": "with m as (select count(*) as events, count(distinct user_id) as users, count(*) filter (event_type in ('click', 'view')) as looked, count(*) filter (event_type = 'error') as failed from events) select metric, cast(v as varchar) as value from (unpivot m on columns(*) into name metric value v)",
    "props_profile": "select count(*) as total_records, count(json_extract_string(props, '$.k')) as present_count, count(*) filter (json_extract_string(props, '$.k') is null) as missing_count, count(*) filter (not coalesce(json_valid(props), false)) as unreadable_count, count(*) filter (json_extract_string(props, '$.k') is not null and try_cast(json_extract_string(props, '$.k') as double) is null) as invalid_type_count from events",
    "questions_by_category": f"""with t(category, low, high) as (values {', '.join(f"('{k}', {lo}, {hi})" for k, (lo, hi) in TARGETS.items())}),
      q as (select case when grouping(category) = 1 then 'all' else category end as category, count(*) as questions, count(*) filter (answerable) as answerable from eval_questions where review_status = 'approved' group by rollup (category))
      select coalesce(q.category, t.category) as category, coalesce(questions, 0) as questions, coalesce(answerable, 0) as answerable, coalesce(coalesce(questions, 0) between low and high, false) as in_target from q full join t on t.category = q.category""",
}
