"""Parsing of metadata spellings: durations, dates, course codes, keyword evidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from timbrel.functions.text import collapse

# A term that ends a course name, a sentence that does, and the shapes of course codes.
TERM = r"(?i),?\s+(?:Fall|Spring|Summer|Winter)\s+\d{4}\b"
TERMS = r"(?i),?\s+(?:Fall|Spring|Summer|Winter|IAP)\s+\d{4}\b"
CATALOGUE = " View the complete course"
CODE_SHAPES = r"RES[.-]\d+(?:[-.][A-Z]?\d+)*|[A-Z]{2,5}[.-]\d+(?:[-.]\d+)*[A-Z]*|\d+[A-Z]*(?:\.\d+)+[A-Z]*"


def iso_duration_seconds(c: Column | str) -> Column:
    """'PT1H18M14S' to seconds. 'P0D' (a live stream) and anything unreadable, days included, are null; 'PT' is 0."""
    c = F.col(c) if isinstance(c, str) else c
    part = lambda u: F.coalesce(F.nullif(F.regexp_extract(c, rf"(\d+){u}", 1), F.lit("")).cast("int"), F.lit(0))
    return F.when(c.rlike(r"^PT(\d+H)?(\d+M)?(\d+S)?$"), part("H") * 3600 + part("M") * 60 + part("S"))


def iso_duration(seconds: Column | str) -> Column:
    """Seconds to the shortest such spelling; the inverse of iso_duration_seconds for whole seconds."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    piece = lambda v, u: F.when(v > 0, F.concat(v.cast("string"), F.lit(u))).otherwise(F.lit(""))
    return F.concat(F.lit("PT"), piece(h, "H"), piece(m, "M"), piece(r, "S"))


def published_date(c: Column | str) -> Column:
    """'2020-04-10T08:30:00Z' to its date; null unless spelt exactly so."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).cast("date"))


def course_code(texts: Sequence[Column | str], schools: Sequence[str]) -> Column:
    """First code 'SCHOOL 6.104' in the first of the texts that has one, upper case, without its school; else 'unresolved'."""
    rx = rf"(?i)\b(?:{'|'.join(schools)})\s+(\d+[A-Z]*(?:\.\d+)+[A-Z]*)\b"
    found = [F.nullif(F.upper(F.regexp_extract(collapse(t), rx, 1)), F.lit("")) for t in texts]
    return F.coalesce(*found, F.lit("unresolved"))


def course_name(title: Column | str, schools: Sequence[str]) -> Column:
    """What follows the code in a title up to a term or 160 characters; '' if that is a lecture number or nothing."""
    rest = F.regexp_extract(collapse(title), rf"(?i)^.*?\b(?:{'|'.join(schools)})\s+\d+[A-Z]*(?:\.\d+)+[A-Z]*\b(.*)$", 1)
    rest = F.regexp_replace(F.split(rest, TERM, 2)[0], r"^[ |:\-–—()]+", "")
    name = F.regexp_replace(F.substring(rest, 1, 160), r"[ ,|:\-–—()]+$", "")
    return F.when(F.lower(name).rlike("^(lec|lecture) "), F.lit("")).otherwise(name)


def course(sources: Mapping[str, Column | str], schools: Sequence[str]) -> Column:
    """struct(code, name, confidence, evidence) of the first code that follows a school's name in the first of the named texts that has one.

    Codes are upper case, a catalogue code 'RES-6' is written 'RES.6'. The name is what follows, up to a
    term, else up to the catalogue sentence and 160 characters; '' if it is a lecture number or nothing.
    """
    edge = " |:\\-\u2013\u2014"
    rx = rf"(?i)\b(?:{'|'.join(schools)})\s+({CODE_SHAPES})\b"

    def found(source: str, text: Column) -> Column:
        code = F.upper(F.regexp_extract(text, rx, 1))
        code = F.when(code.startswith("RES-"), F.concat(F.lit("RES."), F.substring(code, F.lit(5), F.length(code)))).otherwise(code)
        rest = F.regexp_replace(F.regexp_extract(text, rf"^.*?{rx}(.*)$", 2), f"^[{edge}]+", "")
        until = F.when(rest.rlike(TERMS), F.get(F.split(rest, TERMS, 2), 0)).otherwise(F.substring(F.substring_index(rest, CATALOGUE, 1), 1, 160))
        name = F.regexp_replace(until, f"^[{edge},]+|[{edge},]+$", "")
        name = F.when(F.lower(name).rlike("^(lec|lecture) "), "").otherwise(name)
        return F.when(code != "", F.struct(code.alias("code"), name.alias("name"), F.lit("high").alias("confidence"), F.concat(F.lit(f"{source}:"), F.regexp_extract(text, rx, 0)).alias("evidence")))

    none = F.struct(F.lit("unresolved").alias("code"), F.lit("unresolved").alias("name"), F.lit("unresolved").alias("confidence"), F.lit("no_course_code_pattern").alias("evidence"))
    return F.coalesce(*[found(k, collapse(t)) for k, t in sources.items()], none)


def department_class(code: Column, text: Column, departments: Mapping[str, str], keywords: Mapping[str, Sequence[str]]) -> tuple[Column, Column]:
    """(class, evidence): by the part of a course code before its first stop, if that is a known department, else by keywords."""
    part = F.substring_index(code, ".", 1)
    known = F.create_map(*[F.lit(x) for kv in departments.items() for x in kv])[part]
    name, evidence = keyword_class(text, keywords)
    return F.coalesce(known, name), F.when(known.isNotNull(), F.concat(F.lit("department:"), part)).otherwise(evidence)


def keyword_class(text: Column, keywords: Mapping[str, Sequence[str]]) -> tuple[Column, Column]:
    """(class, evidence): the class with most keywords present in a text.

    Presence counts, not occurrences. No keyword: ('unresolved', 'no_evidence'); several classes
    with the most: ('unresolved', 'tie:a|b').
    """

    def scores(low: Column) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("k"), sum((F.contains(low, F.lit(w)).cast("int") for w in ws), F.lit(0)).alias("n")) for k, ws in sorted(keywords.items())])

    def verdict(found: Column, most: Column) -> Column:
        best = F.transform(F.filter(found, lambda x: x["n"] == most), lambda x: x["k"])
        name = F.when((most > 0) & (F.size(best) == 1), F.get(best, 0)).otherwise("unresolved")
        evidence = F.when(most == 0, "no_evidence").when(F.size(best) > 1, F.concat(F.lit("tie:"), F.array_join(best, "|"))).otherwise(F.concat(F.lit("score:"), most.cast("string")))
        return F.struct(name.alias("name"), evidence.alias("evidence"))

    # each step is bound to a lambda's variable, so that the text is collapsed and scored once
    scored = F.transform(F.array(F.lower(collapse(text))), scores)
    out = F.transform(F.transform(scored, lambda f: F.struct(f.alias("f"), F.array_max(F.transform(f, lambda x: x["n"])).alias("most"))), lambda s: verdict(s["f"], s["most"]))
    return F.get(out, 0)["name"], F.get(out, 0)["evidence"]


def characters_per_second(length: Column | str, duration: Column | str) -> Column:
    """Pace of a transcript, rounded to three places; null for a null or zero duration."""
    n, s = (F.col(x) if isinstance(x, str) else x for x in (length, duration))
    return F.when(F.coalesce(s, F.lit(0)) != 0, F.round(n / s, 3))
