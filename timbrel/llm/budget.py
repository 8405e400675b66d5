"""Problem 2: usable tokens by source, language and topic domain, kept up to date by signed deltas.

A ledger in the shared folder holds the tokens and language of every content it has met under a
tokenizer, the units of the last load in buckets, and the cube of totals. A load compares the units
with those held by (tbl, id), encodes only contents the ledger hasn't met, and adds what has changed
to the cube: minus what a changed or removed unit gave, plus what it gives now. Only the buckets that
a change falls into are written again; `change` reads only those. Texts are read for unseen contents
only; everything else is ids and digests.

Usable is what is told once: of a video's transcripts that look the same the first counts, of a
chunk only the text that the chunk before it hasn't told already. The token_count and language
columns of a row are not used for that row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timbrel.functions.text import collapse, strip
from timbrel.llm.languages import Languages, fitted
from timbrel.llm.lookalike import consistent_text
from timbrel.llm.tokenizers import DEFAULT, FOLDER, _strings, encoder, fingerprint
from timbrel.operators.store import MOST_DIRS, Store, bucket
from timbrel.session import cut, kept, shared_path, ship, table

#: A shared stretch of fewer characters between two chunks is chance.
LEAST_OVERLAP = 12
#: Buckets of a ledger's units.
BUCKETS = 16


def encoded(contents: DataFrame, name: str, folder: str, languages: Languages) -> DataFrame:
    """(content, text) to (content, tokens, language, sure)."""
    path = f"{folder}/{name}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path)
        for b in batches:
            n = pa.array([count(t or "") for t in _strings(b.column(1))], pa.int64())
            language, sure = languages.of(b.column(1))
            yield pa.record_batch([b.column(0), n, pa.array(language, pa.string()), pa.array(sure, pa.bool_())], names=["content", "tokens", "language", "sure"])

    ship(contents.sparkSession)
    return contents.mapInArrow(run, "content binary, tokens bigint, language string, sure boolean")


CUBE = ["tbl", "source", "language", "domain"]
ID, WHAT, HELD = ["tbl", "id"], ["source", "domain", "content", "whole"], ["tbl", "id", "source", "domain", "content", "whole", "language", "tokens"]


class TokenLedger:
    """Counts, units and cube of one tokenizer. A load becomes visible when its manifest is renamed into place."""

    def __init__(self, spark: SparkSession, path: str, languages: Languages, name: str = DEFAULT, folder: str = FOLDER, buckets: int = BUCKETS) -> None:
        self.spark, self.languages, self.name, self.folder, self.buckets = spark, languages, name, folder, buckets
        self.tokenizer = fingerprint(name, folder)
        self.store = Store(spark, path)

    def manifest(self) -> dict:
        return {"counts": [], "units": {}, "cube": [], "deltas": []} | self.store.manifest()

    def load(self, units: DataFrame, texts: DataFrame) -> DataFrame:
        """units: (tbl, id, source, domain, content, whole), the whole present state; texts: (content, text). Returns the signed deltas.

        (tbl, id) is unique; content is a digest of the text, whole that of the text it was taken
        from, whose language counts where its own words don't tell one. Every content and whole of a
        unit has a text.
        """
        held = self.store.read(self.manifest()["units"])
        if held is None:
            return self._apply(None, units.select(*ID, *WHAT, F.lit(1).alias("sign")), texts)
        a, b = held.select(*ID, F.struct(*WHAT).alias("old")), units.select(*ID, F.struct(*WHAT).alias("new"))
        # both sides are ids and digests; a unit that is the same in both goes no further
        diff = cut(a.join(b, ID, "full").where("not old <=> new"))
        gone = diff.where("old is not null").select(*ID, *[F.col(f"old.{c}").alias(c) for c in WHAT], F.lit(-1).alias("sign"))
        come = diff.where("new is not null").select(*ID, *[F.col(f"new.{c}").alias(c) for c in WHAT], F.lit(1).alias("sign"))
        return self._apply(held, gone.unionByName(come), texts)

    def change(self, changed: DataFrame, removed: DataFrame, texts: DataFrame) -> DataFrame:
        """The same for a feed of changes: new and changed units, and (tbl, id) of removed ones; only their buckets are read."""
        ids = cut(changed.select(*ID).unionByName(removed.select(*ID)).distinct())
        asked = [b for (b,) in ids.select(bucket(ID, self.buckets)).distinct().collect()]
        held = self.store.read(self.manifest()["units"], asked)
        come = changed.select(*ID, *WHAT, F.lit(1).alias("sign"))
        if held is None:
            return self._apply(None, come, texts)
        gone = held.join(ids, ID, "left_semi").select(*ID, *WHAT, F.lit(-1).alias("sign"))
        return self._apply(held, gone.unionByName(come), texts)

    def _apply(self, held: DataFrame | None, moved: DataFrame, texts: DataFrame) -> DataFrame:
        now = self.manifest()
        version, root = now["version"] + 1, self.store.root
        moved = cut(moved.withColumn("_bucket", bucket(ID, self.buckets)))
        come = moved.where("sign > 0")
        counts = [f"{root}/{d}" for d in now["counts"]]
        wanted = come.select("content").unionByName(come.select(F.col("whole").alias("content"))).where("content is not null").distinct()
        if counts:
            wanted = wanted.join(self._counts(counts), "content", "left_anti")
        fresh = texts.join(wanted, "content", "left_semi").groupBy("content").agg(F.any_value("text").alias("text"))
        at = f"counts/{version:09d}"
        encoded(fresh, self.name, self.folder, self.languages).withColumn("tokenizer", F.lit(self.tokenizer)).write.mode("overwrite").parquet(f"{root}/{at}")
        dirs = [*now["counts"], at]
        met = self._counts([*counts, f"{root}/{at}"])
        if len(dirs) > MOST_DIRS:
            dirs = [f"counts/{version:09d}-all"]
            self.spark.read.parquet(*counts, f"{root}/{at}").write.mode("overwrite").parquet(f"{root}/{dirs[0]}")
        of_whole = met.select(F.col("content").alias("whole"), F.when(F.col("language") != "und", F.col("language")).alias("whole_language"))
        told = come.join(met, "content").join(of_whole, "whole", "left")
        language = F.coalesce(F.when(F.col("sure"), F.col("language")), "whole_language", "language", F.lit("und"))
        plus = told.select(*ID, *WHAT, language.alias("language"), "tokens", "_bucket", F.lit(1).alias("sign"))
        if held is not None:
            gone = moved.where("sign < 0").select(*ID)
            minus = held.join(gone, ID, "left_semi").withColumn("sign", F.lit(-1))
            plus = plus.unionByName(minus.select(*plus.columns))
        signed = kept(plus, "signed")
        touched = [b for (b,) in signed.select("_bucket").distinct().collect()]
        # the buckets of the changes: what they held without what has gone, and what has come
        old = self.store.read(now["units"], touched)
        rest = signed.where("sign > 0").select(*HELD, "_bucket")
        if old is not None:
            rest = old.join(signed.where("sign < 0").select(*ID), ID, "left_anti").select(*HELD, "_bucket").unionByName(rest)
        written = self.store.write(rest, "_bucket", "units", version)
        units = {b: d for b, d in now["units"].items() if b not in touched} | {b: [d] for b, d in written.items()}
        cube, deltas = f"cube/{version:09d}", f"deltas/{version:09d}"
        signed.groupBy(*CUBE).agg(F.sum("sign").alias("units"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens")).where("units <> 0 or tokens <> 0").write.mode("overwrite").parquet(f"{root}/{deltas}")
        delta = self.spark.read.parquet(f"{root}/{deltas}")
        total = delta if not now["cube"] else self.cube().unionByName(delta)
        total.groupBy(*CUBE).agg(F.sum("units").alias("units"), F.sum("tokens").alias("tokens")).where("units <> 0").write.mode("overwrite").parquet(f"{root}/{cube}")
        self.store.publish({"version": version, "counts": dirs, "units": units, "cube": [cube], "deltas": [deltas]})
        return delta

    def _counts(self, dirs: list[str]) -> DataFrame:
        """Contents met under this tokenizer."""
        return self.spark.read.parquet(*dirs).where(F.col("tokenizer") == self.tokenizer).drop("tokenizer")

    def cube(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.store.root}/{self.manifest()['cube'][0]}")


def video_dimensions(videos: DataFrame, sources: DataFrame, documents: DataFrame) -> DataFrame:
    """(video, source, domain): the channel's name, and the subject that title and description name.

    The subjects are the domains that documents carry, of any number of words. If the text names none
    or several, the one domain that the video's documents agree on is taken, else 'unresolved'. A
    video without a known source is 'unknown'.
    """
    told = documents.where("topic_domain is not null and topic_domain <> 'unresolved'").select(strip("video_id").alias("video"), "topic_domain")
    subjects = told.select("topic_domain").distinct().select("topic_domain", _phrase("topic_domain").alias("phrase")).where("phrase <> ''")
    agreed = told.groupBy("video").agg(F.min("topic_domain").alias("lo"), F.max("topic_domain").alias("hi")).select("video", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("agreed"))
    v = videos.select(strip("video_id").alias("video"), "source_id", F.split(_phrase(F.concat_ws(" ", "title", "description")), " ").alias("words")).dropDuplicates(["video"])
    longest = subjects.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 1
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform("words", lambda w, i: F.array_join(F.slice("words", i + 1, n), " "))))
    words = v.select("video", F.explode(F.array_distinct(grams)).alias("phrase")).join(subjects, "phrase")
    named = words.groupBy("video").agg(F.min("topic_domain").alias("named"), F.max("topic_domain").alias("hi")).where("named = hi").drop("hi")
    out = v.drop("words").join(sources.select("source_id", "source_name"), "source_id", "left").join(named, "video", "left").join(agreed, "video", "left")
    return out.select("video", F.coalesce("source_name", F.lit("unknown")).alias("source"), F.coalesce("named", "agreed", F.lit("unresolved")).alias("domain"))


def _phrase(c):
    """Words in lower case with one blank between."""
    return F.trim(F.regexp_replace(F.lower(collapse(c)), r"(?U)\W+", " "))


def shared(before: str, text: str, least: int = LEAST_OVERLAP) -> int:
    """Length of the longest end of `before` that begins `text`, if it has `least` characters."""
    head = text[:least]
    if len(head) < least:
        return 0
    i = before.find(head, max(0, len(before) - len(text)))
    while i >= 0:
        if text.startswith(before[i:]):
            return len(before) - i
        i = before.find(head, i + 1)
    return 0


def own_texts(chunks: DataFrame, least: int = LEAST_OVERLAP) -> DataFrame:
    """(chunk_id, transcript_id, chunk_index, text) to (chunk_id, transcript_id, text) without what the chunk before it, in whatever place, ends with.

    Chunks are range-partitioned by transcript and place, so one with many chunks is spread over
    tasks and each text moves once; a task's first chunk meets the last one of the task before it in
    a second step, over two rows a task. Null texts are left out and end no neighbourhood.
    """
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["transcript_id", "chunk_index", "chunk_id"]
    spread = chunks.where("text is not null").select("chunk_id", "transcript_id", "chunk_index", "text").repartitionByRange(n, *order).sortWithinPartitions(*order)
    kinds = {c: chunks.schema[c].dataType.simpleString() for c in ("chunk_id", "transcript_id")}
    schema = f"chunk_id {kinds['chunk_id']}, transcript_id {kinds['transcript_id']}, text string, part int, edge string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last = None  # (chunk, transcript, text)
        for b in batches:
            ids, owners, out, edge = b.column(0).to_pylist(), b.column(1).to_pylist(), [], []
            for i, o, t in zip(ids, owners, _strings(b.column(3))):
                out.append(t[shared(last[2], t, least) :] if last is not None and last[1] == o else t)
                edge.append("first" if last is None else None)
                last = (i, o, t)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([part] * len(out), pa.int32()), pa.array(edge, pa.string())], names=["chunk_id", "transcript_id", "text", "part", "edge"])
        if last is not None:
            yield pa.record_batch([pa.array([last[0]], b.schema.field(0).type), pa.array([last[1]], b.schema.field(1).type), pa.array([last[2]], pa.string()), pa.array([part], pa.int32()), pa.array(["last"])], names=["chunk_id", "transcript_id", "text", "part", "edge"])

    ship(chunks.sparkSession)
    got = kept(spread.mapInArrow(run, schema), "own")
    w = W.partitionBy().orderBy("part", "edge")  # two rows a task
    edges = got.where("edge is not null").withColumn("before", F.lag(F.struct("transcript_id", "text")).over(w)).where("edge = 'first'")
    # a first chunk of another transcript keeps its text
    pairs = edges.select("chunk_id", "transcript_id", F.when(F.col("before.transcript_id") == F.col("transcript_id"), F.col("before.text")).alias("before"), "text")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [t if p is None else t[shared(p, t, least) :] for p, t in zip(_strings(b.column(2)), _strings(b.column(3)))]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.string())], names=["chunk_id", "transcript_id", "text"])

    fixed = pairs.mapInArrow(meet, ", ".join(schema.split(", ")[:3]))
    return got.where("edge is null").select("chunk_id", "transcript_id", "text").unionByName(fixed)


class Corpus:
    """The tables of a data folder, texts read once, and the units they make at any time."""

    def __init__(self, spark: SparkSession, sf: str) -> None:
        t = table(spark, sf, "transcripts").select("transcript_id", strip("video_id").alias("video"), "raw_text", "language", "retrieved_at")
        self.tables = {n: table(spark, sf, n) for n in ("videos", "sources", "documents")}
        self.languages = fitted(t.select(F.col("raw_text").alias("text"), F.col("language").alias("label")))
        looks = consistent_text(t.select("transcript_id", "video", "retrieved_at", F.col("raw_text").alias("whole"), "raw_text"), "raw_text")
        digest = lambda c: F.unhex(F.md5(c))
        #: a transcript without text has a look of its own: it owns its chunks
        self.transcripts = cut(looks.select("transcript_id", "video", "retrieved_at", F.coalesce(digest("raw_text"), F.col("transcript_id").cast("string").cast("binary")).alias("look"), digest("whole").alias("whole")))
        whole = t.where("raw_text is not null").select(F.lit("transcripts").alias("tbl"), F.col("transcript_id").cast("bigint").alias("id"), "transcript_id", F.col("raw_text").alias("text"))
        own = own_texts(table(spark, sf, "chunks").select("chunk_id", "transcript_id", "chunk_index", F.col("chunk_text").alias("text")))
        parts = own.select(F.lit("chunks").alias("tbl"), F.col("chunk_id").cast("bigint").alias("id"), "transcript_id", "text")
        self.pieces = kept(whole.unionByName(parts).withColumn("content", digest("text")), "pieces")
        self.texts = self.pieces.select("content", "text")

    def middle(self):
        """The middle of the time in which transcripts were retrieved; None if there is no time."""
        lo, hi = self.transcripts.agg(F.min("retrieved_at"), F.max("retrieved_at")).first()
        return lo + (hi - lo) / 2 if lo is not None and lo < hi else None

    def units(self, at=None) -> DataFrame:
        """(tbl, id, source, domain, content, whole) of the usable texts, as known at a time: later transcripts, videos and documents aren't there yet."""
        until = lambda df, c: df if at is None else df.where(F.col(c) <= F.lit(at))
        t = until(self.transcripts, "retrieved_at")
        first = t.groupBy("video", "look").agg(F.min("transcript_id").alias("transcript_id"))
        dims = video_dimensions(until(self.tables["videos"], "ingested_at"), self.tables["sources"], until(self.tables["documents"], "ingested_at"))
        where = first.join(dims, "video", "left").join(t.select("transcript_id", "whole"), "transcript_id")
        where = where.select("transcript_id", F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("domain", F.lit("unresolved")).alias("domain"), "whole")
        return self.pieces.select("tbl", "id", "transcript_id", "content").join(where, "transcript_id").select(*ID, *WHAT)


def _loaded(spark: SparkSession, sf: str) -> tuple[TokenLedger, DataFrame]:
    """A ledger after two loads: the state in the middle of the time, then everything.

    Between them transcripts come, and those change or go whose video, domain or first copy became known later.
    """
    corpus = Corpus(spark, sf)
    ledger = TokenLedger(spark, shared_path(spark, "tokens"), corpus.languages)
    middle = corpus.middle()
    if middle is not None:
        ledger.load(corpus.units(middle), corpus.texts)
    return ledger, ledger.load(corpus.units(), corpus.texts)


def p2_token_budget(spark: SparkSession, sf: str) -> DataFrame:
    return _loaded(spark, sf)[0].cube()


def p2_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """What the second load changed, with its sign: new, changed and removed units."""
    return _loaded(spark, sf)[1]


QUERIES = {f.__name__: f for f in (p2_token_budget, p2_deltas)}
SQL: dict[str, str] = {}
