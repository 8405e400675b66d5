"""Problem 8: documents packed into windows of fixed token capacity, with a controlled mixture.

Every window is filled by deficit round-robin over one queue per source: a source earns its share of
each window, spends it on the items taken, and carries what is left into the next window. Items are
spread over bounded shards by a hash, so that each shard has every source and no source makes a shard
large; what the shards before it have given of each source is known from their totals, so the
deficits carried into a shard come from a prefix sum and all shards are packed at once. Windows that
end badly filled are opened again and their items packed together in a later round of half the shards
or fewer, which starts with the deficits that the closed windows leave. If the items still need more
shards than that (they don't combine well), the windows stay as they are: a shard is never made larger.
Only ids, sources and sizes are shuffled.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timbrel.llm.tokenizers import DEFAULT, FOLDER, with_token_count
from timbrel.session import cut, ship, table

CAPACITY = 4096
#: Tokens and items that one shard packs on average; a shard is held by one task. 125 windows suffice for a mixture.
SHARD_TOKENS, SHARD_ITEMS = 125 * CAPACITY, 5_000
#: A window at least so full is closed.
FULL = 0.98


class Queues:
    """One queue per source, its items ordered by size; an item is taken once."""

    def __init__(self, sources: list[str], shares: dict[str, float], carried: dict[str, float]) -> None:
        self.items: dict[str, list[tuple[int, int]]] = {s: [] for s in sources}
        self.share, self.deficit = shares, dict(carried)

    def fill(self, sources: list[str], sizes: list[int], items: list[int]) -> None:
        for s, n, i in zip(sources, sizes, items):
            self.items[s].append((n, i))
        for q in self.items.values():
            q.sort()

    def take(self, source: str, room: int) -> tuple[int, int] | None:
        """The largest item that fits."""
        q = self.items[source]
        i = bisect_right(q, (room, float("inf")))
        return q.pop(i - 1) if i else None

    def window(self, capacity: int) -> list[tuple[str, int, int]]:
        """Fill one window; the source furthest behind its share goes first."""
        for s, part in self.share.items():
            self.deficit[s] += part * capacity
        room, taken, shut = capacity, [], set()
        while True:
            open_ = [s for s, q in self.items.items() if q and s not in shut]
            if not open_:
                return taken
            s = max(open_, key=lambda x: (self.deficit[x], x))
            got = self.take(s, room)
            if got is None:
                shut.add(s)
                continue
            taken.append((s, *got))
            room -= got[0]
            self.deficit[s] -= got[0]


_OUT = "shard bigint, slot int, item bigint, fill bigint"


def _pack(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shares = dict(zip(pdf["source"], pdf["share"]))
        q = Queues(sorted(shares), shares, dict(zip(pdf["source"], pdf["carried"])))
        q.fill(pdf["source"].tolist(), pdf["tokens"].tolist(), pdf["item"].tolist())
        out, slot, shard = [], 0, int(pdf["shard"].iloc[0])
        while any(q.items.values()):
            got = q.window(capacity)
            fill = sum(n for _, n, _ in got)
            out += [(shard, slot, i, fill) for _, _, i in got]
            slot += 1
        return pd.DataFrame(out, columns=["shard", "slot", "item", "fill"])

    return run


def _round(items: DataFrame, shares: dict[str, float], shards: int, capacity: int, number: int, carry: dict[str, float]) -> DataFrame:
    """(item, source, tokens) to (window, item, source, tokens, fill). carry: the deficits of the rounds before."""
    placed = items.withColumn("shard", F.pmod(F.xxhash64("item", F.lit(number)), F.lit(shards)))
    given = placed.groupBy("shard", "source").agg(F.sum("tokens").alias("n"))
    # every source in every shard, so that a source that is missing in one still earns its share there
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("source"), F.lit(float(x)).alias("share"), F.lit(float(carry[s])).alias("carry")) for s, x in sorted(shares.items()))))
    grid = placed.select("shard").distinct().select("shard", each.alias("e")).select("shard", "e.source", "e.share", "e.carry")
    total = grid.join(given, ["shard", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = total.withColumn("all", F.sum("n").over(W.partitionBy("shard")))
    before = W.partitionBy("source").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    carried = total.select("shard", "source", "share", (F.col("carry") + F.coalesce(F.sum(F.col("share") * F.col("all") - F.col("n")).over(before), F.lit(0.0))).alias("carried"))
    ready = placed.join(carried, ["shard", "source"])
    packed = ready.groupBy("shard").applyInPandas(_pack(capacity), _OUT)
    window = F.concat_ws("-", F.lit(number), "shard", "slot")
    return packed.select(window.alias("window"), "item", "fill").join(items, "item")


def tempered(sums: dict[str, int], power: float) -> dict[str, float]:
    """Target proportions of sources from their tokens: power 1 is their own part of all tokens, 0 the same for each."""
    total = sum(n**power for n in sums.values()) or 1.0
    return {s: n**power / total for s, n in sums.items()}


def pack(documents: DataFrame, capacity: int = CAPACITY, shares: dict[str, float] | None = None, shard_tokens: int = SHARD_TOKENS, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(doc_id, source, tokens) to (window, doc_id, piece, source, tokens, fill).

    A document above the capacity is divided into full pieces, each a window of its own, and a rest;
    no other is. shares: target proportion of each source, by default its part of all tokens.
    Documents without tokens (null, empty) need no room and are in no window. A null source is a
    queue of its own. Equal documents are separate items. The list of sources (not their documents)
    is held by the driver.
    """
    ship(documents.sparkSession)
    docs = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "tokens").where("tokens > 0")
    rest = F.col("tokens") % capacity
    size = F.when(F.col("tokens") <= capacity, F.col("tokens")).otherwise(rest).cast("bigint")
    last = F.when(F.col("tokens") <= capacity, 0).otherwise((F.col("tokens") / capacity).cast("int"))
    # monotonically_increasing_id is fixed by the checkpoint below
    items = cut(docs.select("doc_id", "source", F.col("tokens").alias("whole"), size.alias("tokens"), last.alias("piece")).withColumn("item", F.monotonically_increasing_id()))
    full = items.where(F.col("whole") > capacity).select("item", "doc_id", "source", F.explode(F.sequence(F.lit(0), (F.col("whole") / capacity).cast("int") - 1)).alias("piece"))
    full = full.select(F.concat_ws("-", F.lit("f"), "item", "piece").alias("window"), "doc_id", "piece", "source", F.lit(capacity).cast("bigint").alias("tokens"), F.lit(capacity).cast("bigint").alias("fill"))
    left = items.where("tokens > 0")
    sums = left.groupBy("source").agg(F.sum("tokens").alias("n"), F.count("*").alias("k")).collect()
    total, count = sum(r["n"] for r in sums), sum(r["k"] for r in sums)
    if not total:
        return full
    want = {r["source"]: (r["n"] / total if shares is None else shares.get(r["source"], 0.0)) for r in sums}
    scale = sum(want.values()) or 1.0
    share = {s: v / scale for s, v in want.items()}

    def needed(n: int, k: int) -> int:
        return max(1, -(-n // shard_tokens), -(-k // shard_items))

    shards, number, done, carry = needed(total, count), 1, [], dict.fromkeys(share, 0.0)
    todo = left.select("item", "source", "tokens")
    while True:
        got = cut(_round(todo, share, shards, capacity, number, carry))
        closed = F.col("fill") >= FULL * capacity
        sums = got.groupBy("source").agg(F.sum(F.when(closed, F.col("tokens")).otherwise(0)).alias("closed"), F.sum(F.when(closed, 0).otherwise(F.col("tokens"))).alias("n"), F.count_if(~closed).alias("k")).collect()
        more = needed(sum(r["n"] for r in sums), sum(r["k"] for r in sums))
        # half the shards each round, so that the rounds end; where the open windows need more, another round would close little
        if more > shards // 2 or not any(r["k"] for r in sums):
            done.append(got)
            break
        done.append(got.where(closed))
        todo = got.where(~closed).select("item", "source", "tokens")
        gone, spent = sum(r["closed"] for r in sums), {r["source"]: r["closed"] for r in sums}
        carry = {s: carry[s] + share[s] * gone - spent.get(s, 0) for s in share}
        shards, number = more, number + 1
    packed = done[0]
    for d in done[1:]:
        packed = packed.unionByName(d)
    packed = packed.select("window", "item", "fill").join(items, "item").select("window", "doc_id", "piece", "source", "tokens", "fill")
    return packed.unionByName(full)


def sized(spark: SparkSession, sf: str, name: str = DEFAULT, folder: str = FOLDER) -> DataFrame:
    """(doc_id, source, tokens) of the documents under a public tokenizer."""
    return with_token_count(table(spark, sf, "documents").select("doc_id", "source", "text"), "text", name, folder)


def p8_windows(spark: SparkSession, sf: str) -> DataFrame:
    return pack(sized(spark, sf))


def mixture(rows: DataFrame, targets: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(source, target) and the packed windows to each source's tokens, windows, share of all, and distance from the target.

    mean_distance is the mean over all windows of |source's part of the window - target|, windows
    without the source included; filled and all_windows hold for all windows together.
    """
    windows = rows.groupBy("window").agg(F.sum("tokens").alias("size"))
    per = rows.groupBy("window", "source").agg(F.sum("tokens").alias("n")).join(windows, "window").join(targets, "source")
    off = F.sum(F.abs(F.col("n") / F.col("size") - F.col("target")) - F.col("target"))
    part = per.groupBy("source", "target").agg(F.sum("n").alias("tokens"), F.count("*").alias("windows"), off.alias("off"))
    all_ = windows.agg(F.sum("size").alias("t"), F.count("*").alias("w"))
    # a window without the source is as far from the target as the target is from nothing
    distance = (F.col("off") + F.col("target") * F.col("w")) / F.col("w")
    out = part.join(F.broadcast(all_))  # one row
    return out.select("source", F.round("target", 6).alias("target"), "tokens", "windows", F.round(F.col("tokens") / F.col("t"), 6).alias("share"), F.round(distance, 6).alias("mean_distance"), F.round(F.col("t") / (F.col("w") * capacity), 6).alias("filled"), F.col("w").alias("all_windows"))


def _mixed(spark: SparkSession, sf: str, power: float) -> DataFrame:
    docs = cut(sized(spark, sf))
    sums = {r["source"]: r["n"] for r in docs.where("tokens > 0").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum("tokens").alias("n")).collect()}
    shares = tempered(sums, power)
    targets = spark.createDataFrame(sorted(shares.items()), "source string, target double")
    return mixture(pack(docs, shares=shares), targets)


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the windows are, and how far each source's part of a window is from its part of all tokens on average."""
    return _mixed(spark, sf, 1.0)


def p8_tempered(spark: SparkSession, sf: str) -> DataFrame:
    """The same where small sources are to have more than their part: targets are the roots of the sources' tokens.

    Every document is packed, so a source that is wanted more than it has runs dry and the windows after that hold the others.
    """
    return _mixed(spark, sf, 0.5)


QUERIES = {f.__name__: f for f in (p8_windows, p8_fill, p8_tempered)}
SQL: dict[str, str] = {}
