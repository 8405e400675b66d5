"""Contracts as columns: each rule is a boolean, a row's verdict the names of the rules it breaks.

The helpers stand for the keywords of a JSON schema, read strictly: a null breaks every rule but
`optional`. `profile_fields` looks at JSON text before any schema is laid on it, where a missing
field and a null are different things.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbrel.functions.text import instant_micros


def _strict(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def required(name: str) -> Column:
    return F.col(name).isNotNull()


def pattern(name: str, regex: str) -> Column:
    return _strict(F.col(name).rlike(regex))


def enum(name: str, *values: object) -> Column:
    return _strict(F.col(name).isin(*values))


def length(name: str, least: int = 0, most: int | None = None) -> Column:
    n = F.length(name)
    return _strict((n >= least) & (n <= most if most is not None else F.lit(True)))


def bounds(name: str, least: float | None = None, most: float | None = None, above: float | None = None) -> Column:
    c = F.col(name)
    tests = [t for t in (c >= least if least is not None else None, c <= most if most is not None else None, c > above if above is not None else None) if t is not None]
    out = c.isNotNull()
    for t in tests:
        out &= t
    return _strict(out)


def items(name: str, least: int = 0, unique: bool = False, most: int | None = None) -> Column:
    c = F.size(name) >= least
    if most is not None:
        c &= F.size(name) <= most
    return _strict(c & (F.size(name) == F.size(F.array_distinct(name))) if unique else c)


def const(name: str, value: object) -> Column:
    return _strict(F.col(name) == F.lit(value))


def date_time(name: str) -> Column:
    """A date and time of day with its zone, that exists."""
    return instant_micros(name).isNotNull()


def kind(json: str | Column, path: str, *kinds: str) -> Column:
    """The JSON type at a path of JSON text is one of string, number, integer, boolean, array, object or null; a missing field has none."""
    v = F.try_variant_get(F.try_parse_json(json), path, "variant")
    t = F.schema_of_variant(v)
    tests = {"string": t == "STRING", "boolean": t == "BOOLEAN", "array": t.startswith("ARRAY"), "object": t.startswith("OBJECT"), "null": F.is_variant_null(v) | (t == "VOID"), "integer": t == "BIGINT", "number": t.isin("BIGINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL")}
    out = F.lit(False)
    for k in kinds:
        out |= tests[k]
    return _strict(v.isNotNull() & out)


def no_others(json: str | Column, *allowed: str) -> Column:
    """The object holds no field but those allowed."""
    return _strict(F.size(F.array_except(F.json_object_keys(json), F.array(*map(F.lit, allowed)))) == 0)


def each(name: str, rules: Mapping[str, object]) -> dict[str, Column]:
    """A definition for the elements of an array, as rules of the row: name.rule holds if every element holds it."""
    return {f"{name}.{k}": every(name, rule) for k, rule in rules.items()}


def require(df: DataFrame, rules: Mapping[str, Column], key: str) -> DataFrame:
    """The table as it is, but reading a row that breaks a rule raises an error that names the row and the rules: put it before a write."""
    bad = broken(rules)
    return df.where(F.when(bad == "", True).otherwise(F.raise_error(F.concat(F.lit(f"{key} "), F.col(key).cast("string"), F.lit(" breaks "), bad)).cast("boolean")))


def every(name: str, rule) -> Column:
    """All elements of an array hold a rule; a null array has none to break it."""
    return F.coalesce(F.forall(F.col(name), lambda x: _strict(rule(x))), F.lit(True))


def implies(condition: Column, then: Column, otherwise: Column | None = None) -> Column:
    c = _strict(condition)
    return F.when(c, _strict(then)).otherwise(_strict(otherwise) if otherwise is not None else F.lit(True))


def optional(name: str, rule: Column) -> Column:
    return F.col(name).isNull() | _strict(rule)


def broken(rules: Mapping[str, Column]) -> Column:
    """Names of the rules a row breaks, in order, with commas between; '' if it holds all."""
    return F.array_join(F.array_compact(F.array(*[F.when(~c, F.lit(k)) for k, c in rules.items()])), ",")


def profile_fields(df: DataFrame, json: str, expected: Mapping[str, str]) -> DataFrame:
    """(field, expected, total, present, missing, empty, wrong_type, types) of the fields of JSON objects.

    expected: field to string, number, boolean, array or object. A null counts as present and empty
    and of type null; '' and [] are empty. Text that is no JSON has no fields. One pass.
    """
    v = df.select(F.try_parse_json(json).alias("v"))
    aggs = [F.count("*").alias("total")]
    for i, (name, kind) in enumerate(expected.items()):
        x = F.try_variant_get("v", f"$.{name}", "variant")
        t = F.schema_of_variant(x)
        typed = F.when(F.is_variant_null(x) | (t == "VOID"), "null").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").otherwise("number")
        typed = F.when(x.isNotNull(), typed)
        empty = (typed == "null") | x.try_cast("string").isin("", "[]")
        aggs += [F.count(x).alias(f"p{i}"), F.count_if(x.isNotNull() & _strict(empty)).alias(f"e{i}"), F.count_if(typed != kind).alias(f"w{i}"), F.array_join(F.array_sort(F.collect_set(typed)), ",").alias(f"t{i}")]
    row = v.agg(*aggs)
    each = [F.struct(F.lit(name).alias("field"), F.lit(kind).alias("expected"), F.col("total"), F.col(f"p{i}").alias("present"), (F.col("total") - F.col(f"p{i}")).alias("missing"), F.col(f"e{i}").alias("empty"), F.col(f"w{i}").alias("wrong_type"), F.col(f"t{i}").alias("types")) for i, (name, kind) in enumerate(expected.items())]
    return row.select(F.explode(F.array(*each)).alias("f")).select("f.*")
