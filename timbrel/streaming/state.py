"""Streams with keyed state: the latest entry of an append-only log, and growing interval maps."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from timbrel.operators.intervals import IntervalMap
from timbrel.operators.keyed import latest
from timbrel.operators.store import Store, bucket
from timbrel.session import cut, kept, shared_path, ship


#: Buckets of the latest entries.
BUCKETS = 8


def run_to_table(stream: DataFrame, path: str, mode: str, prepare=None) -> None:
    """Run a stream over all that is there now; each batch is written below its number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        out = prepare(batch) if prepare else batch
        out.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{path}/data/n={number}")

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def latest_of_log(spark: SparkSession, log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Latest entry of each key of a log that is read as a stream: each batch's winners are merged into the buckets that they fall into.

    The winners so far lie in a versioned store, in buckets by key; a batch rewrites the buckets of its
    keys only. A batch that is repeated after a failure changes nothing.
    """
    store = Store(spark, shared_path(spark, "log"))

    def merge(batch: DataFrame, number: int) -> None:
        now = {"buckets": {}, "batch": -1} | store.manifest()
        if number <= now["batch"]:
            return
        new = cut(latest(batch, keys, order).withColumn("_bucket", bucket(keys, BUCKETS)))
        touched = [b for (b,) in new.select("_bucket").distinct().collect()]
        held = store.read(now["buckets"], touched)
        both = new if held is None else new.unionByName(held)
        written = store.write(latest(both, [*keys, "_bucket"], order), "_bucket", "latest", now["version"] + 1)
        store.publish({"version": now["version"] + 1, "buckets": now["buckets"] | {b: [d] for b, d in written.items()}, "batch": number})
        store.vacuum(2)

    q = log.writeStream.foreachBatch(merge).option("checkpointLocation", f"{store.root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    found = store.read(store.manifest().get("buckets", {}))
    return found.drop("_bucket").select(*keys, order, *[c for c in log.columns if c not in [*keys, order]]) if found is not None else spark.createDataFrame([], log.schema)


#: Milliseconds of starts that one map holds; an entity's maps are spread over the tasks.
PART_MS = 3_600_000

#: What `_grow` returns; one object, which pandas needn't compare when it joins the groups' frames.
CHANGES = pd.Index(["entity", "part", "kind", "start_ms", "end_ms", "sign"])


def _grow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One batch of a part's intervals into its map: each is inserted by binary search, in the order they come; what that changed of periods and gaps is added up."""
    m, net = IntervalMap(*(np.frombuffer(x, np.int64).tolist() for x in state.get)) if state.exists else IntervalMap(), defaultdict(int)
    for f in frames:
        bounds = list(map(int, " ".join(f["span"]).split()))
        for start, end in zip(bounds[::2], bounds[1::2]):
            for kind, low, high, sign in m.add(start, end):
                net[kind, low, high] += sign
    changes = [(key[1], *what, n) for what, n in net.items() if n]
    if changes:
        # the arrays as bytes: one value each for the state store
        state.update((np.array(m.starts, np.int64).tobytes(), np.array(m.ends, np.int64).tobytes()))
        if isinstance(key[0], np.integer):
            # one block of numbers costs pandas half of what a column beside it does
            yield pd.DataFrame(np.array([(key[0], *c) for c in changes], np.int64), columns=CHANGES)
        else:
            out = pd.DataFrame(np.array(changes, np.int64), columns=CHANGES[1:])
            out.insert(0, "entity", key[0])
            yield out


def interval_changes(intervals: DataFrame, part_ms: int = PART_MS) -> DataFrame:
    """(entity, start_ms, end_ms) as a stream to what each batch changes in the interval maps: (entity, part, kind 0 period or 1 gap, start_ms, end_ms, sign).

    The state is one ordered map for each entity and stretch of `part_ms` in which its intervals start:
    it is the map of a part alone that a batch reads and writes. Rows with a null bound or an end not
    after the start are no intervals; a null entity is an entity of its own; a repeated row changes nothing.
    """
    kind = intervals.schema["entity"].dataType.simpleString()
    ship(intervals.sparkSession)
    # both bounds in one text: each column of a group costs Python about as much as all of its insertions
    span = F.concat_ws(" ", F.col("start_ms").cast("bigint"), F.col("end_ms").cast("bigint"))
    rows = intervals.where("end_ms > start_ms").select("entity", F.floor(F.col("start_ms") / part_ms).alias("part"), span.alias("span"))
    out = f"entity {kind}, part bigint, kind bigint, start_ms bigint, end_ms bigint, sign bigint"
    return rows.groupBy("entity", "part").applyInPandasWithState(_grow, out, "starts binary, ends binary", "append", GroupStateTimeout.NoTimeout)


def keyed_state(spark: SparkSession, stream: DataFrame, part_ms: int = PART_MS) -> DataFrame:
    """Run the stream over all that is there; the contents of its interval maps, as `intervals.gaps`, `coverage` and `periods` take them."""
    out, kind = shared_path(spark, "changes"), stream.schema["entity"].dataType.simpleString()
    schema = f"entity {kind}, part bigint, kind bigint, start_ms bigint, end_ms bigint, sign bigint"
    # a stream without files has no batch
    spark.createDataFrame([], schema).write.parquet(f"{out}/data/n=none")
    run_to_table(interval_changes(stream, part_ms), out, "append")
    changes = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{out}/data")
    # a period or gap that a later batch has replaced adds up to nothing
    held = changes.groupBy("entity", "part", "kind", "start_ms", "end_ms").agg(F.sum("sign").alias("n")).where("n > 0").drop("n")
    return kept(held, "maps")
