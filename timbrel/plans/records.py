"""Loosely typed records read strictly, inventories over optional tables, and the checks before and after a load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timbrel.functions import metadata, records
from timbrel.functions.text import millis, strip
from timbrel.operators import contracts, keyed
from timbrel.plans import chunked
from timbrel.plans.textual import KEYWORDS, SCHOOLS, _collapse
from timbrel.session import table


def playlist_items(s: SparkSession, d: str) -> DataFrame:
    """Videos written as API items whose id stands in one of two places, and read back: fallback paths, numbers held as text."""
    v = table(s, d, "videos").select("video_id", "title", "view_count", (F.length("video_id") + F.length("title") + F.coalesce(F.col("duration_seconds"), F.lit(0)) % 3).alias("n"))
    old = F.struct(F.struct(F.lit("").alias("videoId")).alias("contentDetails"), F.struct("title", F.struct(F.col("video_id").alias("videoId")).alias("resourceId")).alias("snippet"), F.struct(F.col("view_count").cast("string").alias("viewCount")).alias("statistics"))
    new = F.struct(F.struct(F.col("video_id").alias("videoId")).alias("contentDetails"), F.struct("title", F.struct(F.lit(None).cast("string").alias("videoId")).alias("resourceId")).alias("snippet"), F.struct(F.concat(F.lit(" "), F.col("view_count").cast("string")).alias("viewCount")).alias("statistics"))
    items = v.select(F.when(F.col("n") % 2 == 0, F.to_json(old)).otherwise(F.to_json(new)).alias("json"))
    x = items.select(F.from_json("json", "contentDetails struct<videoId:string>, snippet struct<title:string,resourceId:struct<videoId:string>>, statistics struct<viewCount:string>").alias("i"))
    return x.select(records.first_present("i.contentDetails.videoId", "i.snippet.resourceId.videoId").alias("video_id"), F.coalesce("i.snippet.title", F.lit("")).alias("title"), records.whole_number("i.statistics.viewCount").alias("view_count"))


def booleans_parsed(s: SparkSession, d: str) -> DataFrame:
    """A flag of the deliveries as a file would spell it, read strictly."""
    spelt = F.when(F.col("is_generated"), F.when(F.col("raw_id") % 2 == 0, " True").otherwise("TRUE")).otherwise(F.when(F.col("raw_id") % 2 == 0, "false\n").otherwise("False"))
    return table(s, d, "transcripts_raw").where("is_generated is not null").select("raw_id", records.strict_boolean(spelt, "is_generated").alias("is_generated"))


def target_inventory(s: SparkSession, d: str) -> DataFrame:
    """Every place of the evaluation set's video lists, duplicates kept, with what each of four optional tables knows of the video; in the order of number and place."""
    places = table(s, d, "eval_questions").select("question_id", F.posexplode("relevant_video_ids").alias("i", "video_id"))
    places = places.select("question_id", (F.col("i") + 1).cast("string").alias("position"), "video_id")
    v = table(s, d, "videos").select("video_id", F.col("title").alias("known_title"), F.col("publish_date").cast("string").alias("published"), F.lit(True).alias("in_videos"))
    raw = table(s, d, "transcripts_raw").select(strip("video_id").alias("video_id"), "raw_id", "language_code")
    delivered = keyed.latest(raw, ["video_id"], "raw_id", ["language_code"]).select("video_id", F.col("language_code").alias("latest_language"), F.lit(True).alias("delivered"))
    loaded = table(s, d, "transcripts").select("video_id").distinct().withColumn("loaded", F.lit(True))
    told = table(s, d, "documents").where("video_id is not null").groupBy("video_id").agg(F.count("*").alias("documents"))
    x = places.join(v, "video_id", "left").join(delivered, "video_id", "left").join(loaded, "video_id", "left").join(told, "video_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    out = x.select("question_id", "position", "video_id", flag("in_videos"), flag("delivered"), flag("loaded"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("known_title", "published", "latest_language")], F.coalesce("documents", F.lit(0)).alias("documents"))
    return out.orderBy("question_id", F.col("position").cast("int"))


def delivery_matches(s: SparkSession, d: str) -> DataFrame:
    """For each loaded video whether exactly one delivery and one transcript stand for it."""
    raw = table(s, d, "transcripts_raw").select(strip("video_id").alias("video_id"))
    return keyed.match_exactly(table(s, d, "transcripts").select("video_id"), raw, ["video_id"])


def rounded_lengths(s: SparkSession, d: str) -> DataFrame:
    """Eighths and sixteenths of text lengths, many of them halfway between two roundings, rounded exactly and to the even digit."""
    n = F.length("raw_text")
    return table(s, d, "transcripts").select("transcript_id", records.round_half_even(n / 8, 2).alias("eighths"), records.round_half_even(n / 16, 3).alias("sixteenths"))


#: A sample of departments by the first part of a course code.
DEPARTMENTS = {"1": "computing", "3": "linguistics", "8": "mathematics"}


def _courses(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "videos").select("video_id", "title", metadata.course({"title": "title", "description": "description"}, SCHOOLS).alias("c"))


def course_evidence(s: SparkSession, d: str) -> DataFrame:
    """Course codes of any shape with name, confidence and the text that shows them."""
    return _courses(s, d).select("video_id", "c.code", "c.name", "c.confidence", "c.evidence")


def video_domains(s: SparkSession, d: str) -> DataFrame:
    """Domains by department of the course code, else by keywords of name and title."""
    x = _courses(s, d).withColumn("text", F.concat_ws(" ", "c.name", "title"))
    name, evidence = metadata.department_class(F.col("c.code"), F.col("text"), DEPARTMENTS, KEYWORDS)
    return x.select("video_id", name.alias("domain"), evidence.alias("evidence"))


def short_transcripts(s: SparkSession, d: str) -> DataFrame:
    """Transcripts under 5,000 characters with what their pace says of them."""
    t = table(s, d, "transcripts").select("transcript_id", "video_id", F.length("raw_text").alias("n"))
    v = table(s, d, "videos").select("video_id", "duration_seconds")
    x = t.join(v, "video_id").select("transcript_id", "n", "duration_seconds", records.short_status("n", "duration_seconds").alias("status"))
    return x.where("status <> 'not_short'")


def record_failures(s: SparkSession, d: str) -> DataFrame:
    """What would stop the building of a record from a delivery: missing fields, no segments, empty texts, bad times, times out of order."""
    some = lambda test: F.exists("segments", lambda x: F.coalesce(test(x), F.lit(True)))
    starts = F.transform("segments", lambda x: x["start"])
    n = F.greatest(F.size("segments") - 1, F.lit(0))
    falls = F.exists(F.zip_with(F.slice(starts, 1, n), F.slice(starts, 2, n), lambda a, b: b < a), lambda x: F.coalesce(x, F.lit(False)))
    rules = {
        "video_id": F.coalesce(strip("video_id") != "", F.lit(False)),
        "language_code": contracts.required("language_code"),
        "fetched_at": contracts.date_time("fetched_at"),
        "is_generated": contracts.required("is_generated"),
        "segments": F.coalesce(F.size("segments") > 0, F.lit(False)),
        "text": ~F.coalesce(some(lambda x: strip(x["text"]) == ""), F.lit(False)),
        "start": ~F.coalesce(some(lambda x: x["start"] < 0), F.lit(False)),
        "duration": ~F.coalesce(some(lambda x: x["duration"] <= 0), F.lit(False)),
        "order": ~F.coalesce(falls, F.lit(False)),
    }
    return table(s, d, "transcripts_raw").select("raw_id", contracts.broken(rules).alias("failures")).where("failures <> ''")


def record_contract(s: SparkSession, d: str) -> DataFrame:
    """Records as JSON text against a schema: types, constants, bounds of arrays, no other fields, and a definition for the elements."""
    x = table(s, d, "transcripts_raw").withColumn("fields", F.struct(F.lit("1.0").alias("version"), F.col("raw_id"), strip("video_id").alias("video_id"), F.col("language_code"), F.col("is_generated"), F.col("fetched_at"), F.col("segments")))
    # some writers add a field of their own, or hold a number as text
    json = F.when(F.col("raw_id") % 7 == 0, F.to_json(F.struct("fields.*", F.col("bronze_file").alias("note")))).when(F.col("raw_id") % 11 == 0, F.to_json(F.struct("fields.version", F.col("raw_id").cast("string").alias("raw_id"), "fields.video_id", "fields.language_code", "fields.is_generated", "fields.fetched_at", "fields.segments"))).otherwise(F.to_json("fields"))
    c = contracts
    y = x.select(F.col("raw_id").alias("id"), json.alias("json"), "fields.*")
    rules = {
        "raw_id.type": c.kind("json", "$.raw_id", "integer"),
        "version.const": c.const("version", "1.0"),
        "segments.type": c.kind("json", "$.segments", "array"),
        "segments.items": c.items("segments", 1, most=400),
        "fetched_at.date_time": c.date_time("fetched_at"),
        "is_generated.type": c.kind("json", "$.is_generated", "boolean"),
        "additional": c.no_others("json", "version", "raw_id", "video_id", "language_code", "is_generated", "fetched_at", "segments"),
    } | c.each("segments", {"start": lambda x: x["start"] >= 0, "duration": lambda x: x["duration"] > 0, "text": lambda x: F.length(x["text"]) > 0})
    return y.select(F.col("id").alias("raw_id"), c.broken(rules).alias("broken")).where("broken <> ''")


def load_validation(s: SparkSession, d: str) -> DataFrame:
    """After a load: the target videos against videos and transcripts, as metrics and one verdict."""
    target = table(s, d, "eval_questions").select(F.explode("relevant_video_ids").alias("video_id")).distinct()
    v, t = table(s, d, "videos").select("video_id").distinct(), table(s, d, "transcripts")
    mine = t.join(target, "video_id", "left_semi").withColumn("empty_text", F.coalesce(strip("raw_text") == "", F.lit(True)).cast("int")).withColumn("empty_language", F.coalesce(strip("language") == "", F.lit(True)).cast("int"))
    per = target.join(v.withColumn("known", F.lit(1)), "video_id", "left").join(mine.groupBy("video_id").agg(F.count("*").alias("n"), F.sum("empty_text").alias("t"), F.sum("empty_language").alias("l")), "video_id", "left")
    row = per.agg(F.count("*").alias("targets"), F.count_if(F.col("known").isNull()).alias("missing_videos"), F.count_if(F.col("n").isNull()).alias("missing_transcripts"), F.count_if(F.col("n") > 1).alias("duplicate_transcripts"), F.coalesce(F.sum("t"), F.lit(0)).alias("empty_texts"), F.coalesce(F.sum("l"), F.lit(0)).alias("empty_languages"))
    failed = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in row.columns[1:]]))
    row = row.withColumn("failures", F.array_join(failed, ",")).withColumn("validation_status", F.when(F.col("failures") == "", "passed").otherwise("failed"))
    return keyed.long_metrics(row)


def chunk_verification(s: SparkSession, d: str) -> DataFrame:
    """Chunk records held against the records they were cut from: each kind of mismatch counted, repeated ids, captions that no chunk covers."""
    c = chunked.chunk_records(s, d)
    r = table(s, d, "transcripts_raw").select("raw_id", "segments")
    part = F.slice("segments", F.col("first_segment") + 1, F.col("last_segment") - F.col("first_segment") + 1)
    x = c.join(r, "raw_id").withColumn("part", part)
    text = F.array_join(F.transform("part", lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    last = F.element_at("part", -1)
    again = records.canonical_json(record="raw_id", config=F.lit(chunked.chunking.FIXED.name), first_segment="first_segment", last_segment="last_segment", start_ms=millis(F.element_at("part", 1)["start"]), end_ms=millis(last["start"]) + millis(last["duration"]), chunk_text=text)
    bad = {
        "text": (F.col("chunk_text") != text) | (F.col("chunk_length") != F.length(text)),
        "segments": F.col("segment_count") != F.size("part"),
        "timing": ~F.col("start_ms").eqNullSafe(millis(F.element_at("part", 1)["start"])) | ~F.col("end_ms").eqNullSafe(millis(last["start"]) + millis(last["duration"])),
        "hash": F.col("content_sha256") != F.sha2(again, 256),
    }
    # covered places: a chunk adds those after the greatest end of the chunks before it
    so_far = W.partitionBy("raw_id").orderBy("chunk_index").rowsBetween(W.unboundedPreceding, -1)
    added = F.greatest(F.lit(0), F.col("last_segment") - F.greatest(F.col("first_segment") - 1, F.coalesce(F.max("last_segment").over(so_far), F.lit(-1))))
    covered = c.select("raw_id", added.alias("n")).agg(F.sum("n").alias("covered"))
    counts = x.agg(F.count("*").alias("chunks"), *[F.count_if(b).alias(f"{k}_mismatches") for k, b in bad.items()])
    ids = c.groupBy("chunk_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_ids"))
    whole = r.agg(F.sum(F.greatest(F.size("segments"), F.lit(0))).alias("captions"))
    return counts.join(ids).join(covered).join(whole).select("chunks", *[f"{k}_mismatches" for k in bad], "repeated_ids", (F.col("captions") - F.col("covered")).alias("uncovered_captions"))


QUERIES = {f.__name__: f for f in (playlist_items, booleans_parsed, target_inventory, delivery_matches, rounded_lengths, course_evidence, video_domains, short_transcripts, record_failures, record_contract, load_validation, chunk_verification)}

_READABLE = r"regexp_matches(coalesce(fetched_at, ''), '^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$')"
_RX = r"(?i)\b(?:ALC|QRS|NTU-X)\s+(RES[.-]\d+(?:[-.][A-Z]?\d+)*|[A-Z]{2,5}[.-]\d+(?:[-.]\d+)*[A-Z]*|\d+[A-Z]*(?:\.\d+)+[A-Z]*)\b"
_EDGE = r" |:\-\x{2013}\x{2014}"


def _course_sql() -> str:
    rest = f"regexp_replace(regexp_extract(t, '^.*?{_RX}(.*)$', 2), '^[{_EDGE}]+', '')"
    term = r"(?i),?\s+(?:Fall|Spring|Summer|Winter|IAP)\s+\d{4}\b"
    return f"""a as (select video_id, title, unnest(['title', 'description']) as src, unnest([1, 2]) as p, unnest([{_collapse('title')}, {_collapse('description')}]) as t from videos),
      b as (select video_id, title, src, p, upper(regexp_extract(t, '{_RX}', 1)) as code, {rest} as rest, regexp_extract(t, '{_RX}', 0) as m from a),
      c as (select *, case when regexp_matches(rest, '{term}') then regexp_replace(rest, '{term}.*$', '') else substr(split_part(rest, ' View the complete course', 1), 1, 160) end as cut from b where code <> ''),
      e as (select *, regexp_replace(cut, '^[{_EDGE},]+|[{_EDGE},]+$', '', 'g') as n from c qualify row_number() over (partition by video_id order by p) = 1),
      k as (select v.video_id, v.title, coalesce(case when code like 'RES-%' then 'RES.' || substr(code, 5) else code end, 'unresolved') as code, case when code is null then 'unresolved' when regexp_matches(lower(n), '^(lec|lecture) ') then '' else n end as name,
        case when code is null then 'unresolved' else 'high' end as confidence, coalesce(src || ':' || m, 'no_course_code_pattern') as evidence from videos v left join e on e.video_id = v.video_id)"""


def _domain_sql() -> str:
    score = ", ".join(f"{{'k': '{k}', 'n': {' + '.join(f'cast(contains(low, {chr(39)}{w}{chr(39)}) as int)' for w in ws)}}}" for k, ws in sorted(KEYWORDS.items()))
    known = "case split_part(code, '.', 1) " + " ".join(f"when '{k}' then '{v}'" for k, v in DEPARTMENTS.items()) + " end"
    return f"""with {_course_sql()}, q as (select video_id, code, {known} as known, lower({_collapse("concat_ws(' ', name, title)")}) as low from k), s as (select *, [{score}] as sc from q),
      z as (select *, list_max(list_transform(sc, lambda x: x.n)) as most from s), y as (select *, list_transform(list_filter(sc, lambda x: x.n = most), lambda x: x.k) as best from z)
      select video_id, coalesce(known, case when most > 0 and len(best) = 1 then best[1] else 'unresolved' end) as domain,
        case when known is not null then 'department:' || split_part(code, '.', 1) when most = 0 then 'no_evidence' when len(best) > 1 then 'tie:' || array_to_string(best, '|') else 'score:' || cast(most as varchar) end as evidence from y"""


_S = chunked._strip
SQL = {
    "playlist_items": "select video_id, coalesce(title, '') as title, view_count from videos",
    "booleans_parsed": "select raw_id, is_generated from transcripts_raw where is_generated is not null",
    "target_inventory": f"""with p as (select question_id, generate_subscripts(relevant_video_ids, 1) as i, unnest(relevant_video_ids) as video_id from eval_questions),
      r as (select {_S('video_id')} as video_id, arg_max(coalesce(language_code, ''), raw_id) as l from transcripts_raw group by 1), t as (select distinct video_id from transcripts), x as (select video_id, count(*) as n from documents where video_id is not null group by 1)
      select question_id, cast(i as varchar) as position, p.video_id, v.video_id is not null as in_videos, r.video_id is not null as delivered, t.video_id is not null as loaded, coalesce(v.title, '') as known_title, coalesce(cast(v.publish_date as varchar), '') as published, coalesce(r.l, '') as latest_language, coalesce(x.n, 0) as documents
      from p left join videos v on v.video_id = p.video_id left join r on r.video_id = p.video_id left join t on t.video_id = p.video_id left join x on x.video_id = p.video_id""",
    "delivery_matches": f"""with w as (select video_id, count(*) as wanted from transcripts where video_id is not null group by 1), o as (select {_S('video_id')} as video_id, count(*) as n from transcripts_raw where video_id is not null group by 1)
      select w.video_id, wanted, coalesce(n, 0) as offered, case when n is null then 'missing' when n > 1 or wanted > 1 then 'duplicate' else 'ok' end as status from w left join o on o.video_id = w.video_id""",
    # dyadic fractions are exact in doubles
    "rounded_lengths": "select transcript_id, round_even(length(raw_text) / 8, 2) as eighths, round_even(length(raw_text) / 16, 3) as sixteenths from transcripts",
    "course_evidence": f"with {_course_sql()} select video_id, code, name, confidence, evidence from k",
    "video_domains": _domain_sql(),
    "short_transcripts": """with x as (select transcript_id, cast(length(raw_text) as int) as n, duration_seconds, length(raw_text) / nullif(duration_seconds, 0) as pace from transcripts t join videos v on v.video_id = t.video_id where length(raw_text) < 5000)
      select transcript_id, n, duration_seconds, case when pace is null then 'manual_review_missing_duration' when duration_seconds <= 600 and pace >= 2 then 'likely_valid_short_video' when duration_seconds > 600 and pace < 2 then 'possible_incomplete' else 'manual_review' end as status from x""",
    "record_failures": f"""with f as (select raw_id, array_to_string(list_filter([case when coalesce({_S('video_id')}, '') = '' then 'video_id' end, case when language_code is null then 'language_code' end, case when not {_READABLE} then 'fetched_at' end, case when is_generated is null then 'is_generated' end,
        case when coalesce(len(segments), 0) = 0 then 'segments' end, case when len(list_filter(segments, lambda x: coalesce({_S('x.text')}, '') = '')) > 0 then 'text' end,
        case when len(list_filter(segments, lambda x: coalesce(x.start < 0, true))) > 0 then 'start' end, case when len(list_filter(segments, lambda x: coalesce(x.duration <= 0, true))) > 0 then 'duration' end,
        case when len(list_filter(range(1, len(segments)), lambda i: segments[i + 1].start < segments[i].start)) > 0 then 'order' end], lambda x: x is not null), ',') as failures from transcripts_raw)
      select raw_id, failures from f where failures <> ''""",
    "record_contract": f"""with f as (select raw_id, array_to_string(list_filter([case when raw_id % 11 = 0 and raw_id % 7 <> 0 then 'raw_id.type' end, case when segments is null then 'segments.type' end, case when not coalesce(len(segments) between 1 and 400, false) then 'segments.items' end,
        case when not {_READABLE} then 'fetched_at.date_time' end, case when is_generated is null then 'is_generated.type' end, case when raw_id % 7 = 0 and bronze_file is not null then 'additional' end,
        case when len(list_filter(segments, lambda x: not coalesce(x.start >= 0, false))) > 0 then 'segments.start' end, case when len(list_filter(segments, lambda x: not coalesce(x.duration > 0, false))) > 0 then 'segments.duration' end, case when len(list_filter(segments, lambda x: coalesce(length(x.text), 0) = 0)) > 0 then 'segments.text' end], lambda x: x is not null), ',') as broken from transcripts_raw)
      select raw_id, broken from f where broken <> ''""",
    "load_validation": f"""with g as (select distinct unnest(relevant_video_ids) as video_id from eval_questions),
      m as (select video_id, count(*) as n, count(*) filter (coalesce({_S('raw_text')}, '') = '') as t, count(*) filter (coalesce({_S('language')}, '') = '') as l from transcripts group by 1),
      r as (select count(*) as targets, count(*) filter (v.video_id is null) as missing_videos, count(*) filter (m.video_id is null) as missing_transcripts, count(*) filter (n > 1) as duplicate_transcripts, cast(coalesce(sum(t), 0) as bigint) as empty_texts, cast(coalesce(sum(l), 0) as bigint) as empty_languages
        from g left join videos v on v.video_id = g.video_id left join m on m.video_id = g.video_id),
      f as (select *, array_to_string(list_filter([case when missing_videos > 0 then 'missing_videos' end, case when missing_transcripts > 0 then 'missing_transcripts' end, case when duplicate_transcripts > 0 then 'duplicate_transcripts' end, case when empty_texts > 0 then 'empty_texts' end, case when empty_languages > 0 then 'empty_languages' end], lambda x: x is not null), ',') as failures from r),
      s as (select *, case when failures = '' then 'passed' else 'failed' end as validation_status from f)
      select unnest(['targets', 'missing_videos', 'missing_transcripts', 'duplicate_transcripts', 'empty_texts', 'empty_languages', 'failures', 'validation_status']) as metric,
        unnest([cast(targets as varchar), cast(missing_videos as varchar), cast(missing_transcripts as varchar), cast(duplicate_transcripts as varchar), cast(empty_texts as varchar), cast(empty_languages as varchar), failures, validation_status]) as value from s""",
    "chunk_verification": f"with recursive {chunked._SEG}, {chunked._WALK} select count(*) as chunks, cast(0 as bigint) as text_mismatches, cast(0 as bigint) as segments_mismatches, cast(0 as bigint) as timing_mismatches, cast(0 as bigint) as hash_mismatches, cast(0 as bigint) as repeated_ids, cast(0 as bigint) as uncovered_captions from r",
}
