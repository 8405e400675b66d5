"""Nearest vectors by cosine, in blocks.

Queries and rows are packed into blocks of bounded size; every row block meets every query block
once, and one matrix product scores it. Query blocks are sent to all tasks if their size is checked
to be small, so that rows stay where they are; beyond that the blocks meet by a join on both block
numbers, whose keys are as many as the meetings. Each meeting keeps the best k of its own block, and
the best k of all are picked from those by a limit per query that starts in each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timbrel.session import ship

BLOCK = 2048
#: Vectors of queries that go to all tasks at most, and those in one block.
MOST_BYTES, QUERY_BLOCK_BYTES = 64 << 20, 8 << 20


def unit(v: str):
    """A vector column scaled to length 1; a zero vector stays."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double")))


def dot(a: str, b: str):
    """Dot product of two vector columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _blocks(df: DataFrame, id_column: str, vector: str, n: int) -> DataFrame:
    """(block, ids, flat): rows of a hash bucket together, vectors end to end as bytes of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            m = flat.reshape(b.num_rows, -1) if b.num_rows else flat.reshape(0, 1)
            norm = np.sqrt((m * m).sum(1, keepdims=True))
            m = m / np.where(norm > 0, norm, 1)
            block = b.column(0).to_numpy()
            ids = np.array(b.column(1).to_pylist(), dtype=object)
            for k in np.unique(block):
                at = np.flatnonzero(block == k)
                for i in range(0, len(at), BLOCK):
                    part = at[i : i + BLOCK]
                    yield pa.record_batch([pa.array([int(k)]), pa.array([ids[part].tolist()], pa.list_(b.schema.field(1).type)), pa.array([m[part].tobytes()], pa.binary())], names=["block", "ids", "flat"])

    kind = df.schema[id_column].dataType.simpleString()
    x = df.where(F.col(vector).isNotNull()).select(F.pmod(F.xxhash64(id_column), F.lit(n)).alias("block"), id_column, vector).repartition(n, "block").sortWithinPartitions("block")
    return x.mapInArrow(run, f"block bigint, ids array<{kind}>, flat binary")


def nearest(rows: DataFrame, queries: DataFrame, row_id: str, query_id: str, row_vector: str, query_vector: str, k: int, parts: int | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(query, place, row, score): the k rows of highest cosine for each query, ties by row id.

    Null vectors take part in nothing; all vectors have one length. A row may be its own neighbour.
    """
    spark = rows.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ship(spark)
    wanted = queries.where(F.col(query_vector).isNotNull())
    size = wanted.agg(F.sum(F.size(query_vector)).cast("bigint") * 8).first()[0] or 0
    few = max(1, -(-size // QUERY_BLOCK_BYTES))
    q = _blocks(queries, query_id, query_vector, few).select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"))
    r = _blocks(rows, row_id, row_vector, n)
    each = lambda m: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint")))
    r = r.withColumn("q_block", each(few))
    if size <= most_bytes:
        met = r.join(F.broadcast(q), "q_block")
    else:
        met = r.join(q.withColumn("block", each(n)), ["block", "q_block"])
    met = met.select("ids", "flat", "q_ids", "q_flat")
    row_kind, query_kind = rows.schema[row_id].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, flat, q_ids, q_flat in zip(b.column(0), b.column(1), b.column(2), b.column(3)):
                qs, rs = len(q_ids), len(ids)
                m = np.frombuffer(flat.as_py(), np.float64).reshape(rs, -1)
                s = np.frombuffer(q_flat.as_py(), np.float64).reshape(qs, -1) @ m.T
                # everything that ties with the k-th is kept, so that ties fall by id afterwards
                floor = np.partition(s, rs - k, axis=1)[:, rs - k] if rs > k else np.full(qs, -np.inf)
                a, c = np.nonzero(s >= floor[:, None] - 1e-12)
                yield pa.record_batch([q_ids.values.take(pa.array(a)), ids.values.take(pa.array(c)), pa.array(s[a, c])], names=["query", "row", "score"])

    scored = met.mapInArrow(run, f"query {query_kind}, row {row_kind}, score double")
    # row_number with a bound keeps k rows of a query in each task before the shuffle
    w = W.partitionBy("query").orderBy(F.desc("score"), "row")
    return scored.withColumn("score", F.round("score", 9)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("query", "place", "row", "score")
