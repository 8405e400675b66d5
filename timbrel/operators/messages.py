"""Exactly one copy of each message, kept in a partitioned store that is updated in place.

The store holds the winners, partitioned by when they arrived, and an index that names each
identifier's partition. The index lies in buckets by a hash of the identifier. A batch reads only the
buckets of its identifiers, there finds the partitions that hold them, and reads only those; they are
combined with the batch, reduced to one winner per identifier and written again. A batch becomes
visible when its manifest is renamed into place, so a lost executor or a failed job leaves the store
as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbrel.functions.naming import spared
from timbrel.operators.store import MOST_DIRS, Store, bucket

#: Columns that the store adds; rows that have such a column get it back as <name>_input.
INTERNAL = ["_part", "_held", "_dir", "_new", "_bucket", "w"]
#: Buckets of the index; a batch reads those that its identifiers fall into.
BUCKETS = 32


class MessageStore:
    """Winners of at-least-once messages.

    key: the columns that identify a message; order: the column whose smallest value wins; part: the
    column that says in which partition a new message is kept (few values: their list is held by the
    driver). Rows with a null in any key column belong to no message and aren't kept. Equal rows and
    equal orders leave one copy. An empty batch changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: str, part: str, buckets: int = BUCKETS) -> None:
        self.spark, self.key, self.order, self.part, self.buckets = spark, key, order, part, buckets
        self.store = Store(spark, path)

    def manifest(self) -> dict:
        return {"parts": {}, "index": {}, "buckets": self.buckets} | self.store.manifest()

    def read(self) -> DataFrame | None:
        """All winners; None before the first batch."""
        held = self.store.read(self.manifest()["parts"])
        return held.drop("_new") if held is not None else None

    def upsert(self, incoming: DataFrame) -> dict:
        """Merge a batch; returns how many partitions there were, were looked up and were written, and how many index buckets were read."""
        now = self.manifest()
        version, buckets = now["version"] + 1, now["buckets"]
        incoming = spared(incoming.dropna(subset=self.key), INTERNAL).withColumn("_part", F.coalesce(F.col(self.part).cast("string"), F.lit("unknown")))
        history, asked, touched = None, [], set()
        if now["index"]:
            keys = incoming.select(*self.key, bucket(self.key, buckets).alias("_bucket"))
            asked = [b for (b,) in keys.select("_bucket").distinct().collect() if b in now["index"]]
            known = self.store.read(now["index"], asked)
            if known is not None:
                touched = {p for (p,) in known.join(keys.drop("_bucket"), self.key, "left_semi").select("_part").distinct().collect()}
            touched |= {p for p, dirs in now["parts"].items() if len(dirs) > MOST_DIRS}
            history = self.store.read(now["parts"], touched)
        both = incoming.withColumn("_held", F.lit(None).cast("string"))
        if history is not None:
            both = both.unionByName(history.drop("_new").withColumn("_held", F.col("_part")))
        rest = [c for c in incoming.columns if c not in [*self.key, "_part"]]
        # a known message stays in the partition that holds it, whichever copy wins: the index stays true
        winners = both.groupBy(*self.key).agg(F.min_by(F.struct(*rest, "_part"), F.struct(self.order, "_part")).alias("w"), F.max("_held").alias("_held"))
        winners = winners.select(*self.key, *[F.col(f"w.{c}").alias(c) for c in rest], F.coalesce("_held", "w._part").alias("_part"), F.col("_held").isNull().alias("_new"))
        written = self.store.write(winners, "_part", "data", version)
        # a partition that was looked up is replaced; one that only gains messages keeps its files
        parts = now["parts"] | {p: ([] if p in touched else now["parts"].get(p, [])) + [d] for p, d in written.items()}
        index = dict(now["index"])
        fresh = self.store.read({p: [d] for p, d in written.items()})
        if fresh is not None:
            new = fresh.where("_new").select(*self.key, "_part", bucket(self.key, buckets).alias("_bucket"))
            for b, d in self.store.write(new, "_bucket", "index", version).items():
                index[b] = [*index.get(b, []), d]
        full = {b: dirs for b, dirs in index.items() if len(dirs) > MOST_DIRS}
        if full:
            index |= {b: [d] for b, d in self.store.write(self.store.read(full), "_bucket", "index", version).items()}
        self.store.publish({"version": version, "parts": parts, "index": index, "buckets": buckets})
        return {"before": len(now["parts"]), "looked_up": len(touched), "written": len(written), "buckets_read": len(asked)}

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove what versions before the last `keep` alone have used."""
        return self.store.vacuum(keep)
