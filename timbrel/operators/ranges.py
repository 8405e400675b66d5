"""Joins on overlapping ranges, as equi-joins on buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_join(a: DataFrame, b: DataFrame, key: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs of rows of equal key whose [low, high) ranges overlap; columns of a are prefixed a_, of b b_.

    Both sides are laid into buckets of `width` and joined on (key, bucket), so a key with many rows is
    spread over its buckets; a pair that shares several buckets is reported in the first. Rows with
    a null or reversed range have no partner. Choose the width near the usual length of a range.
    """

    def laid(df: DataFrame, p: str) -> DataFrame:
        x = df.where(F.col(key).isNotNull() & (F.col(high) > F.col(low))).select(*[F.col(c).alias(p + c) for c in df.columns])
        last = F.ceil(F.col(p + high) / width) - 1
        return x.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(p + low) / width), last)))

    x, y = laid(a, "a_"), laid(b, "b_").withColumnRenamed("_bucket", "_other")
    on = (F.col(f"a_{key}") == F.col(f"b_{key}")) & (F.col("_bucket") == F.col("_other"))
    meet = (F.col(f"a_{low}") < F.col(f"b_{high}")) & (F.col(f"b_{low}") < F.col(f"a_{high}"))
    first = F.col("_bucket") == F.floor(F.greatest(f"a_{low}", f"b_{low}") / width)
    return x.join(y, on & meet & first).drop("_bucket", "_other")
