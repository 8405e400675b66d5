"""Continuous periods and gaps of timed intervals, by keyed ordered interval maps.

An :class:`IntervalMap` is kept for each entity and stretch of time (part); an interval belongs to the
part it starts in. Every interval is inserted by binary search, merged with what it touches, and the
gaps beside it are updated. In a stream the maps are keyed state (``timbrel.streaming.state``); in
batch, `interval_state` holds one map at a time over range-partitioned starts. Both leave the maps'
contents, periods and gaps by part, and what the intervals of earlier parts still cover of a later
one is settled afterwards by a running maximum of the ends, computed in ranges. So an entity with a
third of all rows is spread over tasks in every step, and nothing is broadcast by us.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from timbrel.operators.keyed import numbered, running_max
from timbrel.session import cut, ship


class IntervalMap:
    """Ordered disjoint intervals; touching ones are one. An insertion costs one binary search."""

    __slots__ = ("starts", "ends")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None) -> None:
        self.starts, self.ends = starts or [], ends or []

    def add(self, start: int, end: int) -> list[tuple[int, int, int, int]]:
        """Insert an interval. Returns what it changed: (kind 0 period or 1 gap, start, end, 1 come or -1 gone)."""
        i = bisect_left(self.ends, start)
        j = bisect_right(self.starts, end, i)
        starts, ends, n = self.starts, self.ends, len(self.starts)
        if j == i + 1 and starts[i] <= start and end <= ends[i]:
            return []
        low, high = (min(start, starts[i]), max(end, ends[j - 1])) if i < j else (start, end)
        changed = [(0, starts[k], ends[k], -1) for k in range(i, j)]
        changed.append((0, low, high, 1))
        # the gaps between and beside what is touched, and those beside what comes of it
        old = [(1, ends[k - 1], starts[k]) for k in range(max(i, 1), min(j, n - 1) + 1)]
        new = [(1, ends[i - 1], low)] if i else []
        if j < n:
            new.append((1, high, starts[j]))
        changed += [(*g, -1) for g in old if g not in new]
        changed += [(*g, 1) for g in new if g not in old]
        starts[i:j], ends[i:j] = [low], [high]
        return changed

    def periods(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends))

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends, self.starts[1:]))


def _fold(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (entity, start, end), an entity's rows together, to its periods and gaps in this task."""
    part = TaskContext.get().partitionId()
    state, entity, begun = IntervalMap(), None, False
    entities, kinds, lows, highs = [], [], [], []

    def flush() -> None:
        for kind, spans in ((0, state.periods()), (1, state.gaps())):
            for a, b in spans:
                entities.append(entity)
                kinds.append(kind)
                lows.append(a)
                highs.append(b)

    def batch() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(entities, schema.field(0).type), pa.array([part] * len(kinds), pa.int32()), pa.array(kinds, pa.int32()), pa.array(lows, pa.int64()), pa.array(highs, pa.int64())], schema=schema)
        for x in (entities, kinds, lows, highs):
            x.clear()
        return out

    for b in batches:
        for key, start, end in zip(*(c.to_pylist() for c in b.columns)):
            if not begun or key != entity:
                if begun:
                    flush()
                state, entity, begun = IntervalMap(), key, True
            state.add(start, end)
        if len(kinds) > 50_000:
            yield batch()
    if begun:
        flush()
    if kinds:
        yield batch()


def interval_state(intervals: DataFrame) -> DataFrame:
    """(entity, start_ms, end_ms) to the maps' contents: (entity, part, kind 0 period or 1 gap, start_ms, end_ms).

    Rows with a null bound or an end not after the start are no intervals and are left out; a null
    entity is an entity of its own; repeated rows and ties change nothing; an empty table gives an
    empty one.
    """
    spark = intervals.sparkSession
    kept = intervals.select("entity", "start_ms", "end_ms").where("end_ms > start_ms")
    schema = T.StructType([kept.schema["entity"], T.StructField("part", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("start_ms", T.LongType()), T.StructField("end_ms", T.LongType())])
    arrow = to_arrow_schema(schema)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ship(spark)
    parts = kept.repartitionByRange(n, "entity", "start_ms").sortWithinPartitions("entity", "start_ms")
    return cut(parts.mapInArrow(lambda it: _fold(it, arrow), schema))


def _carried(state: DataFrame) -> DataFrame:
    """(entity, part, first, carry): where an entity goes on in a later part, how far earlier parts cover it."""
    spans = state.where("kind = 0").groupBy("entity", "part").agg(F.min("start_ms").alias("first"), F.max("end_ms").alias("last"))
    return running_max(spans, ["entity"], ["part"], "last", "carry").select("entity", "part", "first", "carry").where("carry is not null")


def gaps(state: DataFrame) -> DataFrame:
    """(entity, gap_start_ms, gap_end_ms): each maximal stretch inside an entity's span that nothing covers."""
    carried = cut(_carried(state))
    s, c = state.where("kind = 1").alias("s"), carried.alias("c")
    low = F.greatest("s.start_ms", F.coalesce("c.carry", "s.start_ms"))
    inner = s.join(c, F.expr("s.entity <=> c.entity and s.part = c.part"), "left").select("s.entity", low.alias("gap_start_ms"), F.col("s.end_ms").alias("gap_end_ms"))
    between = carried.select("entity", F.col("carry").alias("gap_start_ms"), F.col("first").alias("gap_end_ms"))
    return inner.unionByName(between).where("gap_start_ms < gap_end_ms")


def coverage(state: DataFrame) -> DataFrame:
    """One row per entity: first and last covered instant, covered and uncovered milliseconds, periods."""
    span = state.where("kind = 0").groupBy("entity").agg(F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"))
    holes = gaps(state).groupBy("entity").agg(F.sum(F.expr("gap_end_ms - gap_start_ms")).alias("gap_ms"), F.count("*").alias("n"))
    a, b = span.alias("a"), holes.alias("b")
    return a.join(b, F.expr("a.entity <=> b.entity"), "left").select("a.entity", "first_ms", "last_ms", F.expr("last_ms - first_ms - coalesce(gap_ms, 0)").alias("covered_ms"), F.expr("coalesce(gap_ms, 0)").alias("gap_ms"), F.expr("coalesce(n, 0) + 1").alias("periods"))


def periods(state: DataFrame) -> DataFrame:
    """(entity, start_ms, end_ms): the continuous covered periods, from the span and the gaps between.

    The gaps are numbered in ranges; period k begins where gap k ends and ends where gap k + 1 begins.
    """
    span = state.where("kind = 0").groupBy("entity").agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("b"))
    holes = numbered(gaps(state), ["entity"], ["gap_start_ms"], "k")
    count = holes.groupBy("entity").agg(F.max("k").alias("n"))
    s, c = span.alias("s"), count.alias("c")
    whole = s.join(c, F.expr("s.entity <=> c.entity"), "left").select("s.entity", "a", "b", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    begins = whole.select("entity", F.lit(0).cast("bigint").alias("k"), F.col("a").alias("start_ms")).unionByName(holes.select("entity", F.col("k").cast("bigint").alias("k"), F.col("gap_end_ms").alias("start_ms")))
    ends = whole.select("entity", F.col("n").alias("k"), F.col("b").alias("end_ms")).unionByName(holes.select("entity", (F.col("k") - 1).cast("bigint").alias("k"), F.col("gap_start_ms").alias("end_ms")))
    x, y = begins.alias("x"), ends.alias("y")
    return x.join(y, F.expr("x.entity <=> y.entity and x.k = y.k")).select("x.entity", "start_ms", "end_ms")
