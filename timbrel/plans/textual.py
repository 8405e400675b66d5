"""Profiles of captions and metadata: nested segments, neighbours in sequence, parsed spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbrel.functions import metadata, profile
from timbrel.functions.text import casefold, collapse, instant_micros, millis, strip
from timbrel.session import table

SCHOOLS = ["ALC", "QRS", "NTU-X"]


def _segments(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "transcripts_raw").select("raw_id", F.posexplode("segments").alias("idx", "s"))
    return raw.select("raw_id", "idx", "s.text", "s.start", "s.duration")


def segment_text_profile(s: SparkSession, d: str) -> DataFrame:
    """One row per payload: counters over its captions in one pass and one partial aggregation."""
    x = _segments(s, d).select("raw_id", "text").withColumn("blank", F.coalesce(strip("text") == "", F.lit(True)))
    flags = profile.text_flags("text")
    held = x.select("raw_id", "blank", *[F.when(~F.col("blank"), e).otherwise(0).alias(k) for k, e in flags.items()])
    return held.groupBy("raw_id").agg(F.count("*").alias("segments"), F.count_if("blank").alias("empty_segments"), *[F.sum(k).alias(k) for k in flags])


def unicode_profile(s: SparkSession, d: str) -> DataFrame:
    """Captions not in composed form, and captions whose text an HTML parser would change."""
    x = _segments(s, d).where("text is not null").select("raw_id", profile.is_nfc("text").alias("nfc"), profile.has_entity("text").alias("entity"), (casefold("text") != F.lower("text")).alias("folds"))
    return x.groupBy("raw_id").agg(F.count_if(~F.col("nfc")).alias("not_composed"), F.count_if("entity").alias("with_entity"), F.count_if("folds").alias("folds_beyond_lower"))


def segment_timing_profile(s: SparkSession, d: str) -> DataFrame:
    """Invalid and out-of-order times and overlaps with the valid segment before, in array order.

    The look-behind is over a payload's own array, so it is a filter and a zip of the array with itself: no
    shuffle, no sort.
    """
    seg = F.transform("segments", lambda x: F.struct(millis(x["start"]).alias("a"), millis(x["duration"]).alias("n")))
    bad_start = F.filter("seg", lambda x: F.coalesce(x["a"] < 0, F.lit(True)))
    bad_length = F.filter("seg", lambda x: F.coalesce((x["a"] >= 0) & F.coalesce(x["n"] <= 0, F.lit(True)), F.lit(False)))
    valid = F.filter("seg", lambda x: F.coalesce((x["a"] >= 0) & (x["n"] > 0), F.lit(False)))
    pairs = F.zip_with(F.slice("valid", 1, F.greatest(F.size("valid") - 1, F.lit(0))), F.slice("valid", 2, F.greatest(F.size("valid") - 1, F.lit(0))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    x = table(s, d, "transcripts_raw").where("size(segments) > 0").select("raw_id", seg.alias("seg"))
    x = x.select("raw_id", F.size(bad_start).alias("invalid_start"), F.size(bad_length).alias("nonpositive_duration"), valid.alias("valid")).withColumn("pairs", pairs)
    return x.select(
        "raw_id",
        "invalid_start",
        "nonpositive_duration",
        F.size(F.filter("pairs", lambda x: x["q"]["a"] < x["p"]["a"])).alias("out_of_order"),
        F.size(F.filter("pairs", lambda x: x["q"]["a"] < x["p"]["a"] + x["p"]["n"])).alias("overlapping"),
        F.coalesce(F.array_max(F.transform("valid", lambda x: x["a"] + x["n"])), F.lit(0)).alias("max_end_ms"),
    )


def adjacent_captions(s: SparkSession, d: str) -> DataFrame:
    """Neighbouring captions that repeat: exactly, but for case and spacing, or one within the other.

    Neighbours are zipped within the payload's own array: no text is shuffled.
    """
    said = F.transform("segments", lambda x: F.struct(strip(x["text"]).alias("a"), casefold(collapse(x["text"])).alias("n")))
    x = table(s, d, "transcripts_raw").select("raw_id", F.filter(said, lambda x: x["a"] != "").alias("said")).where("size(said) > 1")
    n = F.size("said") - 1
    pair = lambda p, q: F.struct((p["a"] == q["a"]).alias("exact"), (p["n"] == q["n"]).alias("same"), (F.contains(p["n"], q["n"]) | F.contains(q["n"], p["n"])).alias("inside"))
    y = x.select("raw_id", F.zip_with(F.slice("said", 1, n), F.slice("said", 2, n), pair).alias("pairs"))
    count = lambda test: F.size(F.filter("pairs", test)).cast("bigint")
    return y.select("raw_id", count(lambda p: p["exact"]).alias("exact"), count(lambda p: p["same"] & ~p["exact"]).alias("normalised"), count(lambda p: p["inside"] & ~p["same"]).alias("contained"))


def joined_texts(s: SparkSession, d: str) -> DataFrame:
    """Lengths of a payload's text: captions as they are, and stripped without empty ones."""
    t = F.transform("segments", lambda x: x["text"])
    kept = F.filter(F.transform("segments", lambda x: strip(x["text"])), lambda x: x != "")
    raw = table(s, d, "transcripts_raw").where("segments is not null")
    first, last = F.try_element_at("segments", F.lit(1)), F.try_element_at("segments", F.lit(-1))
    return raw.select("raw_id", F.length(F.array_join(t, "\n")).alias("raw_length"), F.length(F.array_join(kept, "\n")).alias("clean_length"), millis(first["start"]).alias("first_ms"), millis(last["start"]).alias("last_ms"))


def collapsed_titles(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "videos").select("video_id", collapse("title").alias("title"), F.upper(collapse("title")).alias("upper_title"), F.length(collapse("description")).alias("description_length"))


def durations_parsed(s: SparkSession, d: str) -> DataFrame:
    """Durations written the way the video service writes them, and read back."""
    v = table(s, d, "videos").select("video_id", F.when(F.coalesce("duration_seconds", F.lit(0)) == 0, F.lit("P0D")).otherwise(metadata.iso_duration("duration_seconds")).alias("duration"))
    return v.select("video_id", "duration", metadata.iso_duration_seconds("duration").alias("seconds"))


def dates_parsed(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "videos").select("video_id", F.concat(F.col("publish_date").cast("string"), F.lit("T08:30:00Z")).alias("published_at"))
    return v.select("video_id", metadata.published_date("published_at").cast("string").alias("published"))


def fetched_instants(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "transcripts_raw").select("raw_id", instant_micros("fetched_at").alias("instant"))
    return raw.select("raw_id", "instant", F.col("instant").isNotNull().alias("parseable"))


def course_codes(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "videos").select("video_id", metadata.course_code(["title", "description"], SCHOOLS).alias("code"), metadata.course_name("title", SCHOOLS).alias("name"))
    return v.where("code <> 'unresolved' or name <> ''")


def course_distribution(s: SparkSession, d: str) -> DataFrame:
    """Videos of each course code with the name most often given to it, the first of equals."""
    from timbrel.operators import keyed

    v = table(s, d, "videos").select("video_id", metadata.course_code(["title", "description"], SCHOOLS).alias("code"), F.nullif(metadata.course_name("title", SCHOOLS), F.lit("")).alias("name")).where("code <> 'unresolved'")
    n = v.groupBy("code").agg(F.count("*").alias("videos"))
    return n.join(keyed.mode_first_seen(v, ["code"], "name", "video_id"), "code", "left")


KEYWORDS = {
    "computing": ["computing", "algorithm", "recursion", "dictionary", "abstraction"],
    "mathematics": ["mathematics", "polynomial", "derivative", "inequality", "probability"],
    "physics": ["physics", "momentum", "electricity", "resistance", "equilibrium"],
    "biology": ["biology", "evolution", "population"],
    "economics": ["economics", "market", "budget"],
}


def keyword_domains(s: SparkSession, d: str) -> DataFrame:
    name, evidence = metadata.keyword_class(F.concat_ws(" ", "title", "description"), KEYWORDS)
    return table(s, d, "videos").select("video_id", name.alias("domain"), evidence.alias("evidence"))


def transcript_pace(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "transcripts").select("transcript_id", "video_id", F.length("raw_text").alias("n"))
    v = table(s, d, "videos").select("video_id", "duration_seconds")
    return t.join(v, "video_id").where("n < 5000").select("transcript_id", "n", "duration_seconds", metadata.characters_per_second("n", "duration_seconds").alias("pace"))


QUERIES = {f.__name__: f for f in (segment_text_profile, unicode_profile, segment_timing_profile, adjacent_captions, joined_texts, collapsed_titles, durations_parsed, dates_parsed, fetched_instants, course_codes, course_distribution, keyword_domains, transcript_pace)}

#: Unicode white space, spelt out: DuckDB's \s is ASCII only.
_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_WS}+', ' ', 'g'))"


#: Letters whose folding isn't their small letter, those that captions have.
_BEYOND = r"\x{b5}\x{df}\x{149}\x{17f}\x{3c2}\x{1e9e}\x{fb00}-\x{fb06}\x{fb13}-\x{fb17}"
_SEG = "seg as (select raw_id, generate_subscripts(segments, 1) - 1 as idx, unnest(segments) as s from transcripts_raw)"


def _flags() -> str:
    t = "s.text"
    conds = {
        "edge_whitespace": f"{t} <> {_strip(t)}",
        "multiline": f"regexp_matches({t}, '[\\n\\r]')",
        "carriage_return": f"contains({t}, chr(13))",
        "tab": f"contains({t}, chr(9))",
        "no_break_space": f"contains({t}, chr(160))",
        "zero_width": f"contains({t}, chr(8203)) or contains({t}, chr(8204)) or contains({t}, chr(8205)) or contains({t}, chr(65279))",
        "replacement_character": f"contains({t}, chr(65533))",
        "double_space": f"contains({t}, '  ')",
        "line_edge_whitespace": f"len(list_filter(regexp_split_to_array({t}, '\\r\\n|[\\n\\r\\x{{0b}}\\x{{0c}}\\x{{1c}}-\\x{{1e}}\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: x <> {_strip('x')})) > 0",
        "bracket_only": f"regexp_full_match({t}, '{_WS}*\\[[^\\]]+\\]{_WS}*')",
        "round_only": f"regexp_full_match({t}, '{_WS}*\\([^\\)]+\\){_WS}*')",
        "html_tag": f"regexp_matches({t}, '<[^>]+>')",
    }
    parts = [f"cast(sum(case when not blank and ({c}) then 1 else 0 end) as bigint) as {k}" for k, c in conds.items()]
    # DuckDB's word boundary knows ASCII letters only: other letters become one
    t = f"regexp_replace({t}, '[\\x{{aa}}\\x{{b5}}\\x{{ba}}\\x{{c0}}-\\x{{d6}}\\x{{d8}}-\\x{{f6}}\\x{{f8}}-\\x{{52f}}\\x{{1e00}}-\\x{{1fff}}\\x{{3041}}-\\x{{9fff}}\\x{{fb00}}-\\x{{fb06}}\\x{{ff21}}-\\x{{ff3a}}\\x{{ff41}}-\\x{{ff5a}}\\x{{ff66}}-\\x{{ff9d}}]', 'Z', 'g')"
    parts.append(f"cast(sum(case when blank then 0 else len(regexp_extract_all({t}, '{profile.CODE_SIGNAL}')) end) as bigint) as code_signals")
    return ", ".join(parts)


_CODE = r"(?i)\b(?:ALC|QRS|NTU-X)\s+(\d+[A-Z]*(?:\.\d+)+[A-Z]*)\b"


def _course() -> str:
    found = [f"nullif(upper(regexp_extract({_collapse(c)}, '{_CODE}', 1)), '')" for c in ("title", "description")]
    code = f"coalesce({found[0]}, {found[1]}, 'unresolved')"
    rest = f"regexp_extract({_collapse('title')}, '(?i)^.*?\\b(?:ALC|QRS|NTU-X)\\s+\\d+[A-Z]*(?:\\.\\d+)+[A-Z]*\\b(.*)$', 1)"
    cut = f"regexp_replace({rest}, '(?i),?\\s+(?:Fall|Spring|Summer|Winter)\\s+\\d{{4}}\\b.*$', '')"
    name = f"regexp_replace(substr(regexp_replace({cut}, '^[ |:\\-–—()]+', ''), 1, 160), '[ ,|:\\-–—()]+$', '')"
    return f"c as (select video_id, {code} as code, {name} as n from videos), k as (select video_id, code, case when regexp_matches(lower(n), '^(lec|lecture) ') then '' else n end as name from c)"


def _keyword_sql() -> str:
    text = f"lower({_collapse('t')})"
    score = ", ".join(f"{{'k': '{k}', 'n': {' + '.join(f'cast(contains(low, {chr(39)}{w}{chr(39)}) as int)' for w in ws)}}}" for k, ws in sorted(KEYWORDS.items()))
    return f"""with a as (select video_id, concat_ws(' ', title, description) as t from videos), b as (select video_id, {text} as low from a), c as (select video_id, [{score}] as sc from b),
      e as (select video_id, list_max(list_transform(sc, lambda x: x.n)) as most, sc from c), f as (select video_id, most, list_transform(list_filter(sc, lambda x: x.n = most), lambda x: x.k) as best from e)
      select video_id, case when most > 0 and len(best) = 1 then best[1] else 'unresolved' end as domain,
        case when most = 0 then 'no_evidence' when len(best) > 1 then 'tie:' || array_to_string(best, '|') else 'score:' || cast(most as varchar) end as evidence from f"""


_ISO = "case when coalesce(duration_seconds, 0) = 0 then 'P0D' else 'PT' || case when duration_seconds >= 3600 then cast(duration_seconds // 3600 as varchar) || 'H' else '' end || case when duration_seconds % 3600 >= 60 then cast(duration_seconds % 3600 // 60 as varchar) || 'M' else '' end || case when duration_seconds % 60 > 0 then cast(duration_seconds % 60 as varchar) || 'S' else '' end end"
SQL = {
    "segment_text_profile": f"with {_SEG}, b as (select *, coalesce({_strip('s.text')} = '', true) as blank from seg) select raw_id, count(*) as segments, count(*) filter (blank) as empty_segments, {_flags()} from b group by 1",
    "segment_timing_profile": f"""with {_SEG}, m as (select raw_id, idx, cast(round(s.start * 1000) as bigint) as a, cast(round(s.duration * 1000) as bigint) as n from seg),
      v as (select *, lag(a) over w as pa, lag(a + n) over w as pe from m where a >= 0 and n > 0 window w as (partition by raw_id order by idx)),
      q as (select raw_id, count(*) filter (a < pa) as o, count(*) filter (a < pe) as p, max(a + n) as e from v group by 1)
      select m.raw_id, cast(count(*) filter (coalesce(a < 0, true)) as int) as invalid_start, cast(count(*) filter (a >= 0 and coalesce(n <= 0, true)) as int) as nonpositive_duration,
        cast(coalesce(any_value(o), 0) as int) as out_of_order, cast(coalesce(any_value(p), 0) as int) as overlapping, coalesce(any_value(e), 0) as max_end_ms from m left join q on q.raw_id = m.raw_id group by 1""",
    "unicode_profile": f"""with {_SEG} select raw_id, count(*) filter (nfc_normalize(s.text) <> s.text) as not_composed, count(*) filter (regexp_matches(s.text, '&(#\\d+|#[xX][0-9a-fA-F]+|[a-zA-Z]+;|amp|lt|gt|quot|nbsp|copy|reg)')) as with_entity,
      count(*) filter (regexp_matches(s.text, '[{_BEYOND}]')) as folds_beyond_lower from seg where s.text is not null group by 1""",
    "adjacent_captions": f"""with {_SEG}, x as (select raw_id, idx, {_strip('s.text')} as a, replace(lower({_collapse('s.text')}), 'ß', 'ss') as n from seg), y as (select *, lag(a) over w as pa, lag(n) over w as pn from x where a <> '' window w as (partition by raw_id order by idx))
      select raw_id, count(*) filter (a = pa) as exact, count(*) filter (n = pn and a <> pa) as normalised, count(*) filter (n <> pn and (contains(n, pn) or contains(pn, n))) as contained from y where pa is not null group by 1""",
    "joined_texts": f"""select raw_id, cast(length(array_to_string(list_transform(segments, lambda x: x.text), chr(10))) as int) as raw_length,
      cast(length(array_to_string(list_filter(list_transform(segments, lambda x: {_strip('x.text')}), lambda x: x <> ''), chr(10))) as int) as clean_length,
      cast(round(segments[1].start * 1000) as bigint) as first_ms, cast(round(segments[-1].start * 1000) as bigint) as last_ms from transcripts_raw where segments is not null""",
    "collapsed_titles": f"select video_id, {_collapse('title')} as title, upper({_collapse('title')}) as upper_title, cast(length({_collapse('description')}) as int) as description_length from videos",
    "durations_parsed": f"select video_id, {_ISO} as duration, nullif(duration_seconds, 0) as seconds from videos",
    "dates_parsed": "select video_id, cast(publish_date as varchar) as published from videos",
    "fetched_instants": r"with x as (select raw_id, case when regexp_matches(fetched_at, '^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$') then epoch_us(cast(fetched_at as timestamptz)) end as instant from transcripts_raw) select raw_id, instant, instant is not null as parseable from x",
    "course_codes": f"with {_course()} select video_id, code, name from k where code <> 'unresolved' or name <> ''",
    "course_distribution": f"with {_course()}, g as (select code, name, count(*) as n, min(video_id) as seen from k where code <> 'unresolved' and name <> '' group by 1, 2), best as (select code, name from g qualify row_number() over (partition by code order by n desc, seen) = 1) select k.code, count(*) as videos, any_value(best.name) as name from k left join best on best.code = k.code where k.code <> 'unresolved' group by 1",
    "keyword_domains": _keyword_sql(),
    "transcript_pace": "select transcript_id, cast(length(raw_text) as int) as n, duration_seconds, case when coalesce(duration_seconds, 0) <> 0 then round(length(raw_text) / duration_seconds, 3) end as pace from transcripts t join videos v on v.video_id = t.video_id where length(raw_text) < 5000",
}
