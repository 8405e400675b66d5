"""Operators on keys and sequences: latest, first, mode, unanimity, shares, set relations, guarded inserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timbrel.session import cut


def latest(df: DataFrame, keys: list[str], order: str, values: list[str] | None = None) -> DataFrame:
    """The last row of each key by an explicit sequence column; partial aggregates, no sort, no window.

    Rows of equal order are told apart by their values. Null keys form a key of their own.
    """
    values = values or [c for c in df.columns if c not in [*keys, order]]
    picked = df.groupBy(*keys).agg(F.max(F.struct(order, *values)).alias("r"))
    return picked.select(*keys, *[F.col(f"r.{c}").alias(c) for c in [order, *values]])


def first_seen(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Distinct keys with the place where each was first seen, for an order-preserving dedup."""
    return df.groupBy(*keys).agg(F.min(order).alias("first_seen"))


def mode_first_seen(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Most frequent value of each group; of equals the one seen first. Nulls aren't counted."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    best = counts.groupBy(*by).agg(F.min(F.struct(-F.col("n"), "seen", value)).alias("b"))
    return best.select(*by, F.col(f"b.{value}").alias(value))


def unanimous(value: Column | str, otherwise: str = "unresolved") -> Column:
    """The group's one distinct non-null value, else `otherwise`; min and max suffice, no set is collected."""
    return F.when(F.min(value) == F.max(value), F.min(value)).otherwise(F.lit(otherwise))


def shares(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows and percent of all rows of each group, rounded to two places."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    # the window runs over the groups, not over the rows
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()), 2))


def joined_in_order(value: str, order: list[str], sep: str) -> Column:
    """The group's values in an explicit order as one string, for groups known to be small."""
    pairs = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("v"))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), sep)


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Incoming rows to append: the first of each key by `order` whose key isn't there yet; null keys are refused."""
    rest = [c for c in incoming.columns if c not in keys]
    first = incoming.dropna(subset=keys).groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
    return first.join(existing.select(*keys), keys, "left_anti")


def insert_plan(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Dry run of insert_if_absent in one row: rows before, offered, refused, to insert, skipped, expected after."""
    before = existing.agg(F.count("*").alias("before"))
    offered = incoming.agg(F.count("*").alias("offered"), F.count_if(F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))).alias("refused"))
    new = insert_if_absent(existing, incoming, keys, order).agg(F.count("*").alias("inserted"))
    both = before.join(offered).join(new)
    return both.withColumn("skipped", F.expr("offered - refused - inserted")).withColumn("after", F.expr("before + inserted"))


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "number") -> DataFrame:
    """1, 2, 3, ... within each group in a given order, without bringing a group into one task.

    Rows are range-partitioned by group and order; a row's number is its place within its range plus
    the rows of its group in the ranges before, of which there is one small count per range and group.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id()))
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    offsets = counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("_range", *by).orderBy(*order))
    same = F.col("_range") == F.col("_at")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return ranged.withColumn("_place", place).join(offsets, same).withColumn(name, F.col("_place") + F.col("_before")).select(*df.columns, name)


def running_max(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The greatest value of the rows before each row of its group, null for the first, without bringing a group into one task.

    Like `numbered`: rows are range-partitioned by group and order, and what the ranges before have
    reached is one value per range and group. Rows of equal order see one another in any sequence.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id()))
    tops = ranged.groupBy(*by, "_range").agg(F.max(value).alias("_top"))
    earlier = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = tops.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_at"), F.max("_top").over(earlier).alias("_before"))
    same = F.col("_range") == F.col("_at")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    here = W.partitionBy("_range", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = ranged.withColumn("_here", F.max(value).over(here)).join(offsets, same)
    # greatest skips nulls
    return out.select(*df.columns, F.greatest("_here", "_before").alias(name))


def match_exactly(wanted: DataFrame, offered: DataFrame, keys: list[str]) -> DataFrame:
    """Each distinct wanted key with how many wanted and offered rows it has, and whether it is ok, missing or duplicate.

    Only counts meet, so a key with many rows joins nothing large; null keys are left out.
    """
    a = wanted.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("wanted"))
    b = offered.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("offered"))
    x = a.join(b, keys, "left").withColumn("offered", F.coalesce("offered", F.lit(0)))
    return x.withColumn("status", F.when(F.col("offered") == 0, "missing").when((F.col("offered") > 1) | (F.col("wanted") > 1), "duplicate").otherwise("ok"))


def join_exactly(wanted: DataFrame, offered: DataFrame, keys: list[str], most: int = 20) -> DataFrame:
    """Join one to one; raises, naming the first few, if a wanted key has no partner or several, or is wanted twice."""
    bad = match_exactly(wanted, offered, keys).where("status <> 'ok'").orderBy(*keys).limit(most).collect()
    if bad:
        raise ValueError(f"not one to one: {[(*[r[k] for k in keys], r['status']) for r in bad]}")
    return wanted.join(offered, keys)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two snapshots hold the same rows, duplicates counted, in any order."""
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def require_subset(part: DataFrame, whole: DataFrame, key: str, most: int = 20) -> None:
    """Raise if `part` has keys that `whole` lacks, naming the first few."""
    extra = [r[0] for r in part.select(key).join(whole.select(key), key, "left_anti").distinct().orderBy(key).limit(most).collect()]
    if extra:
        raise ValueError(f"{key} outside the scope: {extra}")


def contiguity(df: DataFrame, by: list[str], position: str) -> DataFrame:
    """Per group whether the positions are 0, 1, 2, ... without gap or repetition."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.min(position).alias("lo"), F.max(position).alias("hi"), F.count_distinct(position).alias("d"))
    return g.select(*by, "n", F.expr("coalesce(lo = 0 and hi = n - 1 and d = n, false)").alias("contiguous"))


def long_metrics(row: DataFrame) -> DataFrame:
    """A one-row report to rows (metric, value), values as text."""
    names = row.columns
    pairs = ", ".join(f"'{n}', cast(`{n}` as string)" for n in names)
    return row.select(F.expr(f"stack({len(names)}, {pairs}) as (metric, value)"))
