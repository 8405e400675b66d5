"""Cleaned records with lineage, token-bounded chunks, evidence windows and their evaluation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timbrel.functions.records import canonical_json
from timbrel.functions.text import instant_micros, millis, strip
from timbrel.operators import chunking, contracts, ranges, vectors
from timbrel.session import table


def silver(s: SparkSession, d: str) -> DataFrame:
    """Deliveries as cleaned records: nothing of text or time is lost, every record carries its hashes."""
    seg = F.transform("segments", lambda x, i: F.struct(i.alias("segment_index"), F.coalesce(x["text"], F.lit("")).alias("text"), millis(x["start"]).alias("start_ms"), millis(x["duration"]).alias("duration_ms")))
    raw = table(s, d, "transcripts_raw").where("size(segments) > 0").select("raw_id", "bronze_file", strip("video_id").alias("video_id"), "language_code", "is_generated", "fetched_at", seg.alias("segments"), F.sha2(F.to_json(F.struct("segments")), 256).alias("source_payload_sha256"))
    text = F.array_join(F.transform("segments", lambda x: x["text"]), "\n")
    return raw.withColumn("segment_count", F.size("segments")).withColumn("transcript_text", text).withColumn("transcript_length", F.length("transcript_text")).withColumn("content_sha256", F.sha2(content_json(), 256))


def content_json():
    """What a record says, as canonical JSON: its video, and the place, times and text of its captions."""
    said = F.transform("segments", lambda x: F.struct(x["duration_ms"].alias("duration_ms"), x["segment_index"].alias("segment_index"), x["start_ms"].alias("start_ms"), x["text"].alias("text")))
    return canonical_json(video_id="video_id", segments=said)


def silver_records(s: SparkSession, d: str) -> DataFrame:
    return silver(s, d).select("raw_id", "video_id", "segment_count", "transcript_length", "content_sha256")


def silver_validation(s: SparkSession, d: str) -> DataFrame:
    """Each record with the checks it fails, in order; compared with its source again, place by place."""
    source = table(s, d, "transcripts_raw").select("raw_id", F.col("segments").alias("source"))
    r = silver(s, d).join(source, "raw_id")
    same_text = F.forall(F.zip_with("segments", "source", lambda a, b: a["text"].eqNullSafe(F.coalesce(b["text"], F.lit("")))), lambda x: x)
    same_time = F.forall(F.zip_with("segments", "source", lambda a, b: a["start_ms"].eqNullSafe(millis(b["start"])) & a["duration_ms"].eqNullSafe(millis(b["duration"]))), lambda x: x)
    indexed = F.forall(F.transform("segments", lambda x, i: x["segment_index"] == i), lambda ok: ok)
    checks = {
        "identified": F.coalesce((F.col("video_id") != "") & F.col("video_id").isNotNull(), F.lit(False)),
        "fetched_at_readable": instant_micros("fetched_at").isNotNull(),
        "text_equal": (F.size("segments") == F.size("source")) & same_text,
        "timing_equal": same_time,
        "index_continuous": indexed,
        "source_hash_valid": F.col("source_payload_sha256") == F.sha2(F.to_json(F.struct(F.col("source").alias("segments"))), 256),
        "content_hash_valid": F.col("content_sha256") == F.sha2(content_json(), 256),
        "time_valid": F.forall("segments", lambda x: F.coalesce((x["start_ms"] >= 0) & (x["duration_ms"] > 0), F.lit(False))),
        "text_not_empty": strip("transcript_text") != "",
    }
    failed = contracts.broken(checks)
    return r.select("raw_id", failed.alias("failed"), (failed == "").alias("passed"))


def question_contract(s: SparkSession, d: str) -> DataFrame:
    """Evaluation questions that break their schema, with the rules they break: required, pattern, enumeration, length, conditional items."""
    c = contracts
    rules = {
        "question_id_pattern": c.pattern("question_id", r"^lec-q-\d{3}$"),
        "question_length": c.length("question", 10, 200),
        "category_enum": c.enum("category", "factual", "conceptual", "procedural"),
        "review_status_enum": c.enum("review_status", "draft", "approved"),
        "answer_points_if_answerable": c.implies(F.col("answerable"), c.items("expected_answer_points", 1)),
        "video_ids_unique": c.items("relevant_video_ids", unique=True),
        "ranges_positive": c.every("relevant_time_ranges", lambda r: (r["start_second"] >= 0) & (r["end_second"] > r["start_second"])),
        "reviewer_if_approved": c.implies(F.col("review_status") == "approved", c.required("reviewer")),
    }
    return table(s, d, "eval_questions").select("question_id", c.broken(rules).alias("broken")).where("broken <> ''")


def document_fields(s: SparkSession, d: str) -> DataFrame:
    """Fields of the documents written as JSON objects without their nulls."""
    x = table(s, d, "documents").select(F.to_json(F.struct("doc_id", "text", "lang", "topic_domain", "n_chars", "video_id")).alias("json"))
    return contracts.profile_fields(x, "json", {"doc_id": "number", "text": "string", "lang": "string", "topic_domain": "string", "n_chars": "string", "video_id": "string"})


def _payloads(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "transcripts_raw").where("size(segments) > 0").select("raw_id", "segments", chunking.token_counts("segments").alias("counts"))
    return p.withColumn("prefix", chunking.prefix_sums("counts"))


def fixed_chunks(s: SparkSession, d: str) -> DataFrame:
    """Greedy ranges of at most 240 tokens without overlap."""
    r = chunking.exploded(_payloads(s, d).withColumn("ranges", chunking.greedy_ranges("counts", 240)), "raw_id", "prefix")
    return r.select("raw_id", "chunk_index", F.col("r.s").alias("first_segment"), F.col("r.e").alias("last_segment"), F.expr("prefix[r.e + 1] - prefix[r.s]").alias("tokens"))


def _overlapping(s: SparkSession, d: str) -> DataFrame:
    c = chunking.FIXED
    p = _payloads(s, d).withColumn("plain", chunking.greedy_ranges("counts", c.maximum))
    return p.withColumn("ranges", chunking.with_overlap("plain", "prefix", c.overlap, c.maximum))


def overlapping_chunks(s: SparkSession, d: str) -> DataFrame:
    r = chunking.exploded(_overlapping(s, d), "raw_id", "prefix")
    return r.select("raw_id", "chunk_index", F.col("r.s").alias("first_segment"), F.col("r.e").alias("last_segment"), F.expr("prefix[r.e + 1] - prefix[r.s]").alias("tokens"))


def chunk_records(s: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_records(_overlapping(s, d), "raw_id", chunking.FIXED.name)


def _cohesive(s: SparkSession, d: str, c: chunking.Config) -> DataFrame:
    p = _payloads(s, d).withColumn("windows", chunking.greedy_ranges("counts", 64, close_at=32))
    p = p.select("raw_id", "segments", "prefix", "windows", F.transform("segments", lambda x: x["text"]).alias("texts"))
    found = chunking.cohesive_ranges(p.select("raw_id", "prefix", "windows", "texts"), c)
    return found.withColumn("ranges", chunking.with_overlap("ranges", "prefix", c.overlap, c.maximum))


def cohesive_chunks(s: SparkSession, d: str) -> DataFrame:
    """Chunks that end where neighbouring windows are least alike, for both sizes."""
    parts = [chunking.exploded(_cohesive(s, d, c).withColumn("config", F.lit(c.name)), "raw_id", "config", "prefix") for c in (chunking.COHESIVE, chunking.COHESIVE_SMALL)]
    return parts[0].unionByName(parts[1]).select("raw_id", "config", "chunk_index", F.col("r.s").alias("first_segment"), F.col("r.e").alias("last_segment"), F.expr("prefix[r.e + 1] - prefix[r.s]").alias("tokens"))


def chunk_summary(s: SparkSession, d: str) -> DataFrame:
    """Validation of the overlapping chunks in one row: coverage, sizes, shared tokens, tails."""
    c = chunking.FIXED
    x = _overlapping(s, d).select("raw_id", "prefix", F.size("segments").alias("n"), "ranges")
    each = F.transform("ranges", lambda r, k: F.struct(F.expr("0").alias("z"), r["s"].alias("s"), r["e"].alias("e"), (F.get("prefix", r["e"] + 1) - F.get("prefix", r["s"])).alias("t"), (k == F.size("ranges") - 1).alias("tail"), F.when(k > 0, F.get("prefix", F.get("ranges", k - 1)["e"] + 1) - F.get("prefix", r["s"])).alias("shared")))
    covered = (F.element_at("ranges", 1)["s"] == 0) & (F.element_at("ranges", -1)["e"] == F.col("n") - 1) & F.forall(F.zip_with(F.slice("ranges", 1, F.size("ranges") - 1), F.slice("ranges", 2, F.size("ranges")), lambda a, b: b["s"] <= a["e"] + 1), lambda ok: F.coalesce(ok, F.lit(True)))
    y = x.select("raw_id", covered.alias("covered"), F.size("ranges").alias("chunks"), F.explode(each).alias("c"))
    return y.agg(
        F.count("*").alias("total_chunks"),
        F.min("covered").alias("all_covered"),
        F.min("chunks").alias("chunks_min"),
        F.max("chunks").alias("chunks_max"),
        F.min("c.t").alias("tokens_min"),
        F.max("c.t").alias("tokens_max"),
        F.round(F.avg("c.t"), 3).alias("tokens_mean"),
        F.max("c.shared").alias("shared_max"),
        F.round(F.avg(F.when(F.col("c.shared").isNotNull(), F.greatest("c.shared", F.lit(0)))), 3).alias("shared_mean"),
        F.count_if(F.expr(f"c.t > {c.maximum} and c.s = c.e")).alias("oversize_single"),
        F.count_if(F.expr(f"c.t > {c.maximum} and c.s < c.e")).alias("oversize_multi"),
        F.count_if(F.expr(f"c.t < {c.minimum} and not c.tail")).alias("undersize_not_tail"),
        F.count_if(F.expr(f"c.t < {c.minimum} and c.tail")).alias("undersize_tail"),
    )


def answer_ranges(s: SparkSession, d: str) -> DataFrame:
    """Chunks that overlap a range in which an answer is told."""
    t = table(s, d, "transcripts").select("transcript_id", strip("video_id").alias("video_id"))
    c = table(s, d, "chunks").select("chunk_id", "transcript_id", F.col("start_second").cast("double").alias("low"), F.col("end_second").cast("double").alias("high")).join(t, "transcript_id").select("chunk_id", "video_id", "low", "high")
    q = table(s, d, "eval_questions").select("question_id", F.explode("relevant_time_ranges").alias("r")).select("question_id", F.col("r.video_id").alias("video_id"), F.col("r.start_second").alias("low"), F.col("r.end_second").alias("high"))
    j = ranges.overlap_join(c, q, "video_id", "low", "high", 60.0)
    shared = F.least("a_high", "b_high") - F.greatest("a_low", "b_low")
    return j.groupBy(F.col("b_question_id").alias("question_id"), F.col("a_chunk_id").alias("chunk_id")).agg(F.round(F.max(shared), 3).alias("seconds"))


def nearest_vectors(s: SparkSession, d: str) -> DataFrame:
    """For every fiftieth vector its five nearest among all."""
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    return vectors.nearest(e, e.where("vec_id % 50 = 0"), "vec_id", "vec_id", "embedding", "embedding", 5).select("query", "place", "row", F.round("score", 5).alias("score"))


def neighbour_likeness(s: SparkSession, d: str) -> DataFrame:
    """Cosine of each vector with the next one."""
    e = table(s, d, "embeddings").select("vec_id", vectors.unit("embedding").alias("v"))
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(n, "vec_id").select("vec_id", F.round(vectors.dot("v", "w"), 6).alias("score"))


DIMS = 128


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _bag(texts: pd.Series) -> pd.Series:
    """Hashed word counts of a text, words of four letters and more."""
    return texts.map(lambda t: chunking.hashed_words(" ".join(w for w in (t or "").split() if len(w) > 3), DIMS).tolist())


def evidence(s: SparkSession, d: str) -> DataFrame:
    """The five windows of at most 120 tokens most like each answerable question; a placeholder for the others."""
    p = _payloads(s, d).withColumn("ranges", chunking.greedy_ranges("counts", 120))
    video = table(s, d, "transcripts_raw").select("raw_id", strip("video_id").alias("video_id"))
    w = chunking.chunk_records(p, "raw_id", "evidence_120").join(video, "raw_id").select("chunk_id", "video_id", "start_ms", "end_ms", "chunk_text")
    # the same window may have been delivered several times: one copy each
    w = w.groupBy("video_id", "start_ms", "end_ms", F.sha2("chunk_text", 256).alias("h")).agg(F.min("chunk_id").alias("chunk_id"), F.any_value("chunk_text").alias("chunk_text"))
    q = table(s, d, "eval_questions").select("question_id", "question", "answerable")
    best = vectors.nearest(w.select("chunk_id", _bag("chunk_text").alias("v")), q.where("answerable").select("question_id", _bag("question").alias("v")), "chunk_id", "question_id", "v", "v", 5)
    found = best.join(w.select(F.col("chunk_id").alias("row"), "video_id", "start_ms", "end_ms"), "row").select(F.col("query").alias("question_id"), "place", "video_id", "start_ms", "end_ms", F.round("score", 6).alias("score"), F.lit("candidate").alias("status"))
    none = q.where("not answerable").select("question_id", F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("video_id"), F.lit(None).cast("bigint").alias("start_ms"), F.lit(None).cast("bigint").alias("end_ms"), F.lit(None).cast("double").alias("score"), F.lit("not_applicable").alias("status"))
    return found.unionByName(none)


def retrieval_quality(s: SparkSession, d: str) -> DataFrame:
    """Over approved answerable questions with known ranges: recall at 5, mean reciprocal rank, how often the first window cited is right, and how many windows are read before one is."""
    q = table(s, d, "eval_questions").where("answerable and review_status = 'approved' and size(relevant_time_ranges) > 0").select("question_id", "relevant_time_ranges")
    told = q.select("question_id", F.explode("relevant_time_ranges").alias("r"))
    e = evidence(s, d).where("place is not null").select(F.col("question_id").alias("qid"), "place", "video_id", "start_ms", "end_ms")
    hit = told.join(e, (F.col("question_id") == F.col("qid")) & (F.col("r.video_id") == F.col("video_id")) & (F.col("r.start_second") * 1000 < F.col("end_ms")) & (F.col("r.end_second") * 1000 > F.col("start_ms")), "inner")
    first = hit.groupBy("question_id").agg(F.min("place").alias("place"))
    all_ = q.select("question_id").join(first, "question_id", "left")
    return all_.agg(F.count("*").alias("questions"), F.round(F.avg(F.when(F.col("place").isNotNull(), 1.0).otherwise(0.0)), 6).alias("recall_at_5"), F.round(F.avg(F.coalesce(1.0 / F.col("place"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.when(F.col("place") == 1, 1.0).otherwise(0.0)), 6).alias("citation_correct"), F.round(F.avg(F.coalesce("place", F.lit(5))), 6).alias("windows_read"))


QUERIES = {f.__name__: f for f in (silver_records, silver_validation, question_contract, document_fields, fixed_chunks, overlapping_chunks, chunk_records, cohesive_chunks, chunk_summary, answer_ranges, nearest_vectors, neighbour_likeness, evidence, retrieval_quality)}

_WS = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


_SEG = rf"""seg as materialized (select raw_id, i, len(regexp_extract_all(coalesce(t, ''), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_WS}]')) as c
  from (select raw_id, generate_subscripts(segments, 1) - 1 as i, unnest(segments).text as t from transcripts_raw))"""
_WALK = """w as (
  select raw_id, i, 0::bigint as s, c::bigint as cur from seg where i = 0
  union all
  select g.raw_id, g.i, case when w.cur + g.c > 240 then g.i else w.s end, case when w.cur + g.c > 240 then g.c else w.cur + g.c end
  from w join seg g on g.raw_id = w.raw_id and g.i = w.i + 1),
r as (select raw_id, s, max(i) as e, max(cur) as t, row_number() over (partition by raw_id order by s) - 1 as k from w group by raw_id, s),
p as materialized (select raw_id, i, sum(c) over (partition by raw_id order by i) - c as before, sum(c) over (partition by raw_id order by i) as through from seg)"""
_MOVED = """b as (select r.*, ps.before as at_s, pe.through as to_e from r join p ps on ps.raw_id = r.raw_id and ps.i = r.s join p pe on pe.raw_id = r.raw_id and pe.i = r.e),
o as (select b.raw_id, b.k, b.s, b.e, b.to_e, count(*) filter (p.before <= b.at_s - 48) as back, count(*) filter (b.to_e - p.before > 240) as room
  from b join p on p.raw_id = b.raw_id and p.i <= b.s group by all),
x as (select raw_id, k, case when k = 0 then s else least(s, greatest(back, room)) end as s, e, to_e from o),
y as (select x.*, x.to_e - p.before as t from x join p on p.raw_id = x.raw_id and p.i = x.s)"""
_MS = "coalesce(cast(cast(round({} * 1000) as bigint) as varchar), '')"
SQL = {
    "silver_records": f"""with s as (select raw_id, {_strip('video_id')} as video_id, segments, array_to_string(list_transform(segments, lambda x: coalesce(x.text, '')), chr(10)) as txt,
      to_json(list_transform(range(len(segments)), lambda i: {{'duration_ms': cast(round(segments[i + 1].duration * 1000) as bigint), 'segment_index': i, 'start_ms': cast(round(segments[i + 1].start * 1000) as bigint), 'text': coalesce(segments[i + 1].text, '')}})) as said
      from transcripts_raw where len(segments) > 0)
      select raw_id, video_id, cast(len(segments) as int) as segment_count, cast(length(txt) as int) as transcript_length, sha256('{{"segments":' || said || ',"video_id":' || coalesce(to_json(video_id), 'null') || '}}') as content_sha256 from s""",
    "question_contract": r"""with q as (select question_id, array_to_string(list_filter([
      case when not coalesce(regexp_matches(question_id, '^lec-q-\d{3}$'), false) then 'question_id_pattern' end,
      case when not coalesce(length(question) between 10 and 200, false) then 'question_length' end,
      case when not coalesce(category in ('factual', 'conceptual', 'procedural'), false) then 'category_enum' end,
      case when not coalesce(review_status in ('draft', 'approved'), false) then 'review_status_enum' end,
      case when answerable and len(expected_answer_points) = 0 then 'answer_points_if_answerable' end,
      case when len(relevant_video_ids) <> len(list_distinct(relevant_video_ids)) then 'video_ids_unique' end,
      case when len(list_filter(relevant_time_ranges, lambda r: not (r.start_second >= 0 and r.end_second > r.start_second))) > 0 then 'ranges_positive' end,
      case when review_status = 'approved' and reviewer is null then 'reviewer_if_approved' end], lambda x: x is not null), ',') as broken from eval_questions)
      select question_id, broken from q where broken <> ''""",
    "fixed_chunks": f"with recursive {_SEG}, {_WALK} select raw_id, cast(k as int) as chunk_index, cast(s as int) as first_segment, cast(e as int) as last_segment, cast(t as bigint) as tokens from r",
    "overlapping_chunks": f"with recursive {_SEG}, {_WALK}, {_MOVED} select raw_id, cast(k as int) as chunk_index, cast(s as int) as first_segment, cast(e as int) as last_segment, cast(t as bigint) as tokens from y",
    "chunk_records": f"""with recursive {_SEG}, {_WALK}, {_MOVED},
      z as (select y.*, segments[s + 1:e + 1] as part from y join transcripts_raw r on r.raw_id = y.raw_id),
      m as (select raw_id, cast(k as int) as chunk_index, cast(s as int) as first_segment, cast(e as int) as last_segment, cast(t as bigint) as tokens, cast(len(part) as int) as segment_count, array_to_string(list_transform(part, lambda x: coalesce(x.text, '')), chr(10)) as chunk_text,
        cast(round(part[1].start * 1000) as bigint) as start_ms, cast(round(part[-1].start * 1000) as bigint) + cast(round(part[-1].duration * 1000) as bigint) as end_ms from z)
      select *, raw_id || ':fixed_240_o48:' || chunk_index as chunk_id, cast(length(chunk_text) as int) as chunk_length,
        sha256('{{"chunk_text":' || to_json(chunk_text) || ',"config":"fixed_240_o48","end_ms":' || coalesce(cast(end_ms as varchar), 'null') || ',"first_segment":' || first_segment || ',"last_segment":' || last_segment || ',"record":' || raw_id || ',"start_ms":' || coalesce(cast(start_ms as varchar), 'null') || '}}') as content_sha256 from m""",
    "answer_ranges": f"""with t as (select transcript_id, {_strip('video_id')} as video_id from transcripts), q as (select question_id, unnest(relevant_time_ranges) as r from eval_questions)
      select question_id, chunk_id, round(max(least(end_second, r.end_second) - greatest(start_second, r.start_second)), 3) as seconds from chunks c join t on t.transcript_id = c.transcript_id join q on q.r.video_id = t.video_id
      where end_second > start_second and r.end_second > r.start_second and start_second < r.end_second and end_second > r.start_second group by 1, 2""",
    "nearest_vectors": "with e as (select vec_id, cast(embedding as double[]) as v from embeddings), s as (select q.vec_id as query, e.vec_id as row, round(list_cosine_similarity(q.v, e.v), 9) as score from e q, e where q.vec_id % 50 = 0), r as (select *, row_number() over (partition by query order by score desc, row) as place from s) select query, cast(place as int) as place, row, round(score, 5) as score from r where place <= 5",
    "neighbour_likeness": "with e as (select vec_id, cast(embedding as double[]) as v from embeddings) select a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) as score from e a join e b on b.vec_id = a.vec_id + 1",
    "document_fields": " union all ".join(f"""select '{f}' as field, '{k}' as expected, count(*) as total, count({f}) as present, count(*) - count({f}) as missing,
      count(*) filter (cast({f} as varchar) = '') as empty, {f"count({f})" if f == 'n_chars' else '0'} as wrong_type, '{'number' if f in ('doc_id', 'n_chars') else 'string'}' as types from documents"""
      for f, k in (("doc_id", "number"), ("text", "string"), ("lang", "string"), ("topic_domain", "string"), ("n_chars", "string"), ("video_id", "string"))),
    "chunk_summary": f"""with recursive {_SEG}, {_WALK}, {_MOVED},
      n as (select raw_id, max(i) as top from seg group by 1),
      z as (select y.raw_id, y.k, y.s, y.e, cast(y.t as bigint) as t, n.top, lag(y.e) over w as pe, cast(lag(y.to_e) over w - (y.to_e - y.t) as bigint) as shared, y.k = max(y.k) over (partition by y.raw_id) as tail, count(*) over (partition by y.raw_id) as chunks
        from y join n on n.raw_id = y.raw_id window w as (partition by y.raw_id order by y.k))
      select count(*) as total_chunks, bool_and(case when k = 0 then s = 0 else s <= pe + 1 end and (not tail or e = top)) as all_covered, cast(min(chunks) as int) as chunks_min, cast(max(chunks) as int) as chunks_max,
        min(t) as tokens_min, max(t) as tokens_max, round(avg(t), 3) as tokens_mean, max(shared) as shared_max, round(avg(case when shared is not null then greatest(shared, 0) end), 3) as shared_mean,
        count(*) filter (t > 240 and s = e) as oversize_single, count(*) filter (t > 240 and s < e) as oversize_multi, count(*) filter (t < 192 and not tail) as undersize_not_tail, count(*) filter (t < 192 and tail) as undersize_tail from z""",
    "silver_validation": rf"""with s as (select raw_id, {_strip('video_id')} as v, fetched_at, segments, array_to_string(list_transform(segments, lambda x: coalesce(x.text, '')), chr(10)) as txt from transcripts_raw where len(segments) > 0),
      f as (select raw_id, array_to_string(list_filter([case when coalesce(v, '') = '' then 'identified' end,
        case when not regexp_matches(coalesce(fetched_at, ''), '^\d{{4}}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$') then 'fetched_at_readable' end,
        case when len(list_filter(segments, lambda x: not coalesce(round(x.start * 1000) >= 0 and round(x.duration * 1000) > 0, false))) > 0 then 'time_valid' end,
        case when {_strip('txt')} = '' then 'text_not_empty' end], lambda x: x is not null), ',') as failed from s)
      select raw_id, failed, failed = '' as passed from f""",
}
