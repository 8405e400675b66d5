"""Problem 6: runs of consecutive events with the same or nearly the same content, collapsed into one event.

A state machine walks each entity's events in order and compares every event with the anchor (the
first event) of the run at hand: alike in content under a similarity, and not later than a gap after
the run's end. Equal content is the setting similarity 1. Content is the letters and digits of a text
in one look and one case; events without any are passed over.

Events are range-partitioned by (entity, order), so a hot entity is walked by many tasks. A task
begins as if its first event began a run; its first and last run (two rows a task, the bound of what
the driver sees) are then put together in order. Where a run that comes from an earlier task takes in
events of a later one under another anchor, that task is walked again from the run's state, until no
task's entering run changes any more. Usually that is once or never; the result is exact either way.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from timbrel.functions.text import millis
from timbrel.llm import codepoints as C
from timbrel.session import cut, kept, ship, table

#: Buckets of the hashed letter pairs that rule out most neighbours before the exact comparison.
DIMS = 128


def content(column: pa.Array, letters: bool) -> tuple[pa.Array, pa.Array | None]:
    """64-bit key of the letters and digits of each text in order, null if there are none; and they themselves if asked for."""
    keys, none, kept_text = [], [], []
    for _, _, cps, rows in C.slices(column):
        cps, rows = C.form(True).apply(cps, rows)
        kind = C.classes()[cps]
        kept = kind > 0
        at = np.zeros(len(cps) + 1, np.int64)
        np.cumsum(kept, out=at[1:])
        solid = np.zeros(len(cps) + 1, np.int64)
        np.cumsum((kind & (C.WORD | C.ACCENT)) == C.WORD, out=solid[1:])
        keys.append(C.span_hashes(C.mix(cps[kept]), at[rows[:-1]], at[rows[1:]]).view(np.int64))
        none.append(solid[rows[1:]] == solid[rows[:-1]])
        if letters:
            kept_text.append(C.encoded(cps[kept], at[rows]))
    if not keys:
        return pa.array([], pa.int64()), pa.array([], pa.string()) if letters else None
    return pa.array(np.concatenate(keys), mask=np.concatenate(none)), pa.concat_arrays(kept_text).cast(pa.string()) if letters else None


def keyed(events: DataFrame, letters: bool = False) -> DataFrame:
    """Events with a bigint `key`, and `letters` if asked for, in place of the text."""
    added = [T.StructField("key", T.LongType()), *([T.StructField("letters", T.StringType())] if letters else [])]
    schema = T.StructType([*(f for f in events.schema if f.name != "text"), *added])
    at = events.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, said = content(b.column(at), letters)
            out = b.remove_column(at).append_column("key", key)
            yield out.append_column("letters", said) if letters else out

    ship(events.sparkSession)
    return events.mapInArrow(run, schema)


def _pairs(letters: str) -> Counter:
    padded = " " + letters
    return Counter(padded[i : i + 2] for i in range(len(letters)))


def likeness(a: str, b: str) -> float:
    """Dice likeness of two texts' pairs of neighbouring letters, 1 for equal texts."""
    if a == b:
        return 1.0
    x, y = _pairs(a), _pairs(b)
    return 2 * (x & y).total() / max(1, x.total() + y.total())


def _near(letters: pa.Array, a: np.ndarray, least: float) -> np.ndarray:
    """Which places p of `a` may have likeness(p - 1, p) >= least: hashing pairs into few buckets only adds to what is shared."""
    out = np.zeros(len(a), bool)
    for i, j, cps, rows in C.slices(letters):
        mine = np.flatnonzero((a - 1 >= i) & (a < j))
        # a pair that two slices share isn't ruled out
        out[(a - 1 < i) & (a >= i) & (a < j)] = True
        if not len(mine):
            continue
        first = np.zeros(len(cps), bool)
        first[rows[:-1][rows[:-1] < len(cps)]] = True
        before = np.where(first, 32, np.concatenate([[32], cps[:-1]])).astype(np.uint64)
        bucket = (C.mix(before << np.uint64(21) | cps) % np.uint64(DIMS)).astype(np.int64)
        row = np.repeat(np.arange(j - i), np.diff(rows))
        count = np.bincount(row * DIMS + bucket, minlength=(j - i) * DIMS).reshape(j - i, DIMS).astype(np.int32)
        p = a[mine] - i
        shared = np.minimum(count[p - 1], count[p]).sum(1)
        size = np.diff(rows)
        out[mine] = 2 * shared >= least * np.maximum(1, size[p - 1] + size[p]) - 1e-9
    return out


class Run:
    """The run at hand: what is reported of it, and its anchor."""

    __slots__ = ("entity", "first", "last", "n", "start", "end", "total", "key", "letters", "opens")

    def __init__(self, entity, first: int, last: int, n: int, start: int, end: int, total: int, key: int, letters: str | None, opens: bool = False) -> None:
        self.entity, self.first, self.last, self.n, self.start, self.end, self.total, self.key, self.letters, self.opens = entity, first, last, n, start, end, total, key, letters, opens

    def takes(self, entity, start: int, key: int, letters: str | None, gap: int | None, similarity: float) -> bool:
        """Whether an event, or a stretch of events of one content, goes on with this run."""
        if self.entity != entity or gap is not None and start - self.end > gap:
            return False
        return self.key == key or similarity < 1 and likeness(self.letters, letters) >= similarity

    def grow(self, last: int, n: int, end: int, total: int) -> None:
        self.last, self.n, self.end, self.total = last, self.n + n, max(self.end, end), self.total + total

    def values(self) -> tuple:
        return self.entity, self.first, self.last, self.n, self.start, self.end, self.total, self.key, self.letters

    def row(self, part: int, closes: bool) -> tuple:
        edge = self.opens or closes
        return (*self.values()[:8], self.letters if edge else None, part, self.opens, closes)

    def copy(self, opens: bool) -> Run:
        return Run(*self.values(), opens)


_OUT = [("first_index", T.IntegerType()), ("last_index", T.IntegerType()), ("n", T.LongType()), ("start_ms", T.LongType()), ("end_ms", T.LongType()), ("total_ms", T.LongType()), ("key", T.LongType()), ("letters", T.StringType()), ("part", T.IntegerType()), ("opens", T.BooleanType()), ("closes", T.BooleanType())]


def _walk(batches: Iterator[pa.RecordBatch], schema: pa.Schema, least: int, gap: int | None, similarity: float, entering: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
    """Sorted events to finished runs; the run at hand is the only state between batches.

    entering: by task the run that comes into it from those before.
    """
    part = TaskContext.get().partitionId()
    held: Run | None = None
    begun = False
    for b in batches:
        if not b.num_rows:
            continue
        if not begun and part in entering:
            held = Run(*entering[part], True)
        c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        ent = np.array(c["entity"].to_pylist(), object)
        idx, key = (c[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in ("idx", "key"))
        start, dur = (np.nan_to_num(c[n].to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64) for n in ("start_ms", "dur_ms"))
        dur = np.maximum(dur, 0)
        end = start + dur
        # stretches of events of one content are taken as one; most hold a single event
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (ent[1:] != ent[:-1]) | ((start[1:] - end[:-1] > gap) if gap is not None else False)
        at = np.flatnonzero(fresh)
        stop = np.append(at[1:], len(key))
        total, high, entity = np.add.reduceat(dur, at), np.maximum.reduceat(end, at), ent[at]
        said = c["letters"].take(pa.array(at)) if similarity < 1 else None
        linked = np.flatnonzero(_linked(entity, start[at], high, key[at], said, gap, similarity))

        def run(k: int, opens: bool = False) -> Run:
            i, j = at[k], stop[k]
            return Run(entity[k], int(idx[i]), int(idx[j - 1]), int(j - i), int(start[i]), int(high[k]), int(total[k]), int(key[i]), said[k].as_py() if said is not None else None, opens)

        out: list[tuple] = []
        k, m = 0, len(at)
        while k < m:
            if held is not None and held.takes(entity[k], int(start[at[k]]), int(key[at[k]]), said[k].as_py() if said is not None else None, gap, similarity):
                held.grow(int(idx[stop[k] - 1]), int(stop[k] - at[k]), int(high[k]), int(total[k]))
                k += 1
                begun = True
                continue
            if held is not None and (held.n >= least or held.opens):
                out.append(held.row(part, False))
            held, begun = run(k, opens=not begun and part not in entering), True
            k += 1
            # up to the next stretch that is like the one before it, each is a run of its own
            p = np.searchsorted(linked, k)
            ahead = int(linked[p]) if p < len(linked) else m
            if ahead > k:
                if held.n >= least or held.opens:
                    out.append(held.row(part, False))
                inner = np.arange(k, ahead - 1)
                for x in inner[stop[inner] - at[inner] >= least].tolist():
                    out.append(run(x).row(part, False))
                held, k = run(ahead - 1), ahead
        if out:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)
    if held is not None:
        yield pa.record_batch([pa.array([x], t) for x, t in zip(held.row(part, True), schema.types)], schema=schema)


def _linked(entity: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray, said: pa.Array | None, gap: int | None, similarity: float) -> np.ndarray:
    """Which stretches a run that consists of the stretch before them would take in."""
    out = np.zeros(len(entity), bool)
    if len(out) < 2:
        return out
    near = entity[1:] == entity[:-1]
    if gap is not None:
        near &= start[1:] - end[:-1] <= gap
    out[1:] = near & (key[1:] == key[:-1])
    if said is not None:
        ask = np.flatnonzero(near & ~out[1:]) + 1
        ask = ask[_near(said, ask, similarity)]
        out[ask] = [likeness(said[k - 1].as_py(), said[k].as_py()) >= similarity for k in ask.tolist()]
    return out


def collapse_runs(events: DataFrame, least: int = 1, max_gap_ms: int | None = None, similarity: float = 1.0) -> DataFrame:
    """(entity, idx, start, dur, text) to one row per run: first_index, last_index, n, start_ms, end_ms, total_ms.

    Order: start (null last), then idx. Events whose text is null or has no letter or digit are
    passed over and end no run; a null duration counts as 0, so does a negative one; a null start is
    placed at 0. An event goes on with a run if its letters and digits are those of the run's first
    event, or have at least `similarity` with them (Dice, pairs of neighbouring letters), and it
    starts at most max_gap_ms after the end of the run. least: runs shorter than this are left out.
    A null entity is an entity; equal rows are events of their own; an empty table gives no runs.
    """
    spark = events.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("start").asc_nulls_last(), F.col("idx")]
    base = events.select("entity", "idx", "start", millis("start").alias("start_ms"), millis("dur").alias("dur_ms"), "text")
    # written first: finding the ranges reads the events once more
    said = kept(keyed(base, similarity < 1).where("key is not null"), "events")
    walked = cut(said.repartitionByRange(n, F.col("entity"), *order).sortWithinPartitions("entity", *order))
    schema = T.StructType([events.schema["entity"], *(T.StructField(a, b) for a, b in _OUT)])
    arrow = to_arrow_schema(schema)

    def walk(rows: DataFrame, entering: dict[int, tuple]) -> DataFrame:
        return cut(rows.mapInArrow(lambda it: _walk(it, arrow, least, max_gap_ms, similarity, entering), schema))

    runs, entered = walk(walked, {}), {}
    while True:
        joined, again = _joined(runs.where("opens or closes").collect(), entered, max_gap_ms, similarity)
        if not again:
            break
        parts = sorted(again)
        entered |= again
        runs = runs.where(~F.col("part").isin(parts)).unionByName(walk(walked.where(F.spark_partition_id().isin(parts)), again))
    inner = runs.where("not opens and not closes").drop("key", "letters", "part", "opens", "closes")
    edges = spark.createDataFrame([r.values()[:7] for r in joined if r.n >= least], inner.schema)
    return inner.unionByName(edges)


def _joined(edges: list, entered: dict[int, tuple], gap: int | None, similarity: float) -> tuple[list[Run], dict[int, tuple]]:
    """The runs at the edges of tasks put together, and the tasks to walk again with the run that enters them."""
    by_part: dict[int, list] = {}
    for r in edges:
        by_part.setdefault(r["part"], []).append(r)
    done: list[Run] = []
    again: dict[int, tuple] = {}
    now: Run | None = None
    for part in sorted(by_part):
        rows = sorted(by_part[part], key=lambda r: not r["opens"])
        first, last = (Run(*r[:9]) for r in (rows[0], rows[-1]))
        alone = len(rows) == 1
        goes_on = now is not None and now.takes(first.entity, first.start, first.key, first.letters, gap, similarity)
        if part in entered and now is not None and entered[part] == now.values():
            now = None  # its first run holds the entering one already
        elif part in entered:  # the run that it was walked with has changed since
            again[part] = now.values() if now is not None else entered[part]
            now = None
        elif goes_on and now.key == first.key and (gap is None or alone or now.end <= first.end):
            now.grow(first.last, first.n, first.end, first.total)
            first, now = now, None
            last = first if alone else last
        elif goes_on:
            again[part] = now.values()
            now = None
        if now is not None:
            done.append(now)
        if not alone:
            done.append(first)
        now = last if not alone else first
    if now is not None:
        done.append(now)
    return done, again


def segment_events(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, idx, start, dur, text) of all segments."""
    raw = table(spark, sf, "transcripts_raw").select(F.col("raw_id").alias("entity"), F.posexplode("segments").alias("idx", "s"))
    return raw.select("entity", "idx", F.col("s.start").alias("start"), F.col("s.duration").alias("dur"), F.col("s.text").alias("text"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of equal content: the anchor comparison at similarity 1, with no bound on the gap."""
    runs = collapse_runs(segment_events(spark, sf), least=2)
    return runs.select(F.col("entity").alias("raw_id"), "first_index", "last_index")


def p6_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    """Every sequence with its runs collapsed, runs of one included."""
    return collapse_runs(segment_events(spark, sf)).withColumnRenamed("entity", "raw_id")


#: Production tolerances of p6_near: likeness to the anchor, and silence after the run's end.
NEAR, NEAR_GAP_MS = 0.9, 10_000


def p6_near(spark: SparkSession, sf: str) -> DataFrame:
    """Every sequence with its runs of equal and nearly equal captions collapsed."""
    return collapse_runs(segment_events(spark, sf), max_gap_ms=NEAR_GAP_MS, similarity=NEAR).withColumnRenamed("entity", "raw_id")


QUERIES = {f.__name__: f for f in (p6_found, p6_collapsed, p6_near)}
SQL: dict[str, str] = {}
