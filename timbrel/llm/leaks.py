"""Problem 9: passages of held-out items inside corpus documents, by greedy string tiling.

Documents and passages become sequences of word hashes: consistent form, folded case, without
punctuation, stamps, sound cues and fillers. Karp-Rabin hashes of every window of `seed` words are
joined with those of the passages; which documents share a seed with which passages is settled on ids
and hashes alone, and only those documents' words meet those passages. There the longest common
stretches are marked again and again, longest first and without overlap (tiles), and the share of the
passage that tiles cover is reported, so that reordered passages count too.

The passages' seeds are sent to all tasks only if their number is checked to be small (MOST_SEEDS);
beyond it a bitmap of fixed size sieves the windows, and those left are joined with the seeds by a
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timbrel.llm import codepoints as C
from timbrel.session import cut, kept, ship, table

SEED = 12
#: 8 bytes each: 16 MB at most go to a task.
MOST_SEEDS = 2_000_000
#: A bracketed remark of at most so many characters that has one of the cue words is a sound cue; in round brackets and tags only if it has no more than so many words.
CUE_WORDS_IN, CUE_CHARS = 4, 160
#: Bits of the bitmap that sieves windows; its set bits, at most so many, pass through the driver.
SIEVE_BITS = 24
# Words of sound cues, and fillers.
CUES = ["laughter", "laughs", "laughing", "laugh", "applause", "applauding", "clapping", "music", "inaudible", "unintelligible", "crosstalk", "conversation", "chatter", "silence", "noise", "cough", "coughs", "coughing", "sighs", "cheering", "cheers", "background", "pause", "whispering"]
FILLERS = ["um", "uh", "er"]


@cache
def _sets() -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array(sorted(map(C.word_hash, x)), np.uint64) for x in (CUES, FILLERS))


def _in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    i = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[i] == values


def spoken_words(cps: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points to (row, word hash) of the words that count."""
    row, start, end, h = C.words(cps, rows)
    if not len(h):
        return row, h
    cue_words, fillers = _sets()
    gone = _in(h, fillers)
    # stamps: digits, a colon, two digits, perhaps again, perhaps a fraction
    n_digits = np.zeros(len(cps) + 1, np.int64)
    np.cumsum((C.classes()[cps] & C.DIGIT) > 0, out=n_digits[1:])
    number = (n_digits[end] - n_digits[start] == end - start) & (end - start <= 3)
    close = (start[1:] - end[:-1] == 1) & (row[1:] == row[:-1]) & number[1:] & number[:-1]
    between = cps[np.minimum(end[:-1], len(cps) - 1)]
    colon = close & (between == ord(":")) & (end[1:] - start[1:] == 2)
    stamp = np.zeros(len(h), bool)
    stamp[1:] |= colon
    fraction = close & ((between == ord(".")) | (between == ord(","))) & stamp[:-1]
    stamp[:-1] |= colon
    stamp[1:] |= fraction
    gone |= stamp
    # sound cues in brackets, and cue words between tags
    cue = _in(h, cue_words)
    n_cue = np.concatenate([[0], np.cumsum(cue)])
    for opening, closing, tag in (("[", "]", False), ("(", ")", False), ("<", ">", True)):
        o, c = np.flatnonzero(cps == ord(opening)), np.flatnonzero(cps == ord(closing))
        if not len(o) or not len(c):
            continue
        k = np.searchsorted(c, o)
        o, k = o[k < len(c)], k[k < len(c)]
        c = c[k]
        same = (c - o <= CUE_CHARS) & (np.searchsorted(rows, o, "right") == np.searchsorted(rows, c, "right"))
        o, c = o[same], c[same]
        a, b = np.searchsorted(start, o), np.searchsorted(start, c)
        few = (b > a) & ((b - a <= CUE_WORDS_IN) | (opening == "["))
        if not tag:
            few &= n_cue[b] > n_cue[a]
        for i, j in zip(a[few], b[few]):
            gone[i:j] = True
        if tag and len(o):  # <i>music</i>
            after, before = cps[np.maximum(start - 1, 0)] == ord(">"), cps[np.minimum(end, len(cps) - 1)] == ord("<")
            gone |= cue & after & before
    return row[~gone], h[~gone]


def windows(row: np.ndarray, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every window of `width` words that lies in one row."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(row[:n] == row[width - 1 :])
    return at, C.span_hashes(h, at, at + width)


def passages(items: DataFrame, id_column: str, text_columns: list[str], list_columns: list[str]) -> DataFrame:
    """(item, passage, text): each text and each element of the lists is a passage of its item; nulls are none."""

    def listed(c: str):
        return F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(c).alias("k"), i.cast("int").alias("i"), x.alias("t")))

    parts = [F.array(F.struct(F.lit(c).alias("k"), F.lit(0).alias("i"), F.col(c).alias("t"))) for c in text_columns]
    parts += [listed(c) for c in list_columns]
    x = items.select(F.col(id_column).alias("item"), F.explode(F.concat(*parts)).alias("p"))
    return x.select("item", F.concat_ws("#", "p.k", "p.i").alias("passage"), F.col("p.t").alias("text")).where("text is not null")


def word_sequences(texts: DataFrame, text: str = "text") -> DataFrame:
    """The table with `words`, an array of word hashes, in place of the text."""
    at = texts.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = []
            for _, _, cps, rows in C.slices(b.column(at)):
                cps, rows = C.form(True).apply(cps, rows)
                row, h = spoken_words(cps, rows)
                lists.append(_lists(row, h, len(rows) - 1))
            yield b.remove_column(at).append_column("words", pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int64())))

    return texts.mapInArrow(run, T.StructType([*(f for f in texts.schema if f.name != text), T.StructField("words", T.ArrayType(T.LongType()))]))


def _lists(row: np.ndarray, h: np.ndarray, n: int) -> pa.Array:
    at = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))


def seeds_of(sequences: DataFrame, seed: int) -> DataFrame:
    """(item, passage, seed): the window hashes of the passages; they are few and short beside the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(2)
            n = np.diff(words.offsets.to_numpy())
            row = np.repeat(np.arange(len(n)), n)
            at, h = windows(row, words.flatten().to_numpy().view(np.uint64), seed)
            take = pa.array(row[at])
            yield pa.record_batch([b.column(0).take(take), b.column(1).take(take), pa.array(h.view(np.int64))], names=["item", "passage", "seed"])

    kind = sequences.schema["item"].dataType.simpleString()
    return sequences.mapInArrow(run, f"item {kind}, passage string, seed bigint").distinct()


def seeded_documents(documents: DataFrame, seed: int, sieve: np.ndarray, wanted: np.ndarray | None, words: bool) -> DataFrame:
    """(doc_id, seeds), and words if asked for: documents with the window hashes they have among `wanted`, or that pass the sieve if None."""
    packed, shift = np.packbits(sieve), np.uint64(64 - (len(sieve).bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quick = np.unpackbits(packed).view(bool)
        for b in batches:
            for i, j, cps, rows in C.slices(b.column(1)):
                cps, rows = C.form(True).apply(cps, rows)
                row, h = spoken_words(cps, rows)
                at, win = windows(row, h, seed)
                maybe = quick[win >> shift]
                at, win = at[maybe], win[maybe]
                if wanted is not None:
                    sure = _in(win, wanted)
                    at, win = at[sure], win[sure]
                if not len(at):
                    continue
                take, n = pa.array(np.unique(row[at])), len(rows) - 1
                cols = [b.column(0).slice(i, j - i).take(take), _lists(row[at], win, n).take(take)]
                yield pa.record_batch([*cols, _lists(row, h, n).take(take)] if words else cols, names=["doc_id", "seeds", "words"][: 2 + words])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.mapInArrow(run, f"doc_id {kind}, seeds array<bigint>" + (", words array<bigint>" if words else ""))


def tile(text: np.ndarray, pattern: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (text place, pattern place, length) of the longest common stretches.

    Longest first, ties by place, none overlapping another on either side, none shorter than `least`.
    The greatest length at which unmarked stretches of both share a Karp-Rabin hash is found by
    halving (what shares a stretch shares its parts), all tiles of that length are marked, and the
    search goes on from there with what is left. So repetitive texts cost no more than others.
    """
    free_t, free_p = np.ones(len(text), bool), np.ones(len(pattern), bool)
    longest, tiles = min(len(text), len(pattern)), []

    def unmarked(values: np.ndarray, free: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        blocked = np.concatenate([[0], np.cumsum(~free)])
        at = np.flatnonzero(blocked[width:] == blocked[:-width])
        return at, C.span_hashes(values, at, at + width)

    while longest >= least:
        lo, hi, found = least, longest, None
        while lo <= hi:
            width = hi if found is None and hi == longest else (lo + hi + 1) // 2
            (ta, th), (pa_, ph) = unmarked(text, free_t, width), unmarked(pattern, free_p, width)
            common = np.isin(th, ph)
            if common.any():
                found, lo = (width, ta[common], th[common], pa_, ph), width + 1
            else:
                hi = width - 1
        if found is None:
            return tiles
        longest, ta, th, pa_, ph = found
        order = np.argsort(ph, kind="stable")
        ph, pa_ = ph[order], pa_[order]
        next_of: dict[int, int] = {}
        done = -1
        marked = False
        for a, h, first, stop in zip(ta.tolist(), th.tolist(), np.searchsorted(ph, th, "left").tolist(), np.searchsorted(ph, th, "right").tolist()):
            if a < done:
                continue
            k = next_of.get(h, first)
            # places of one hash ascend, and one that is taken stays so
            while k < stop and not (free_p[pa_[k]] and free_p[pa_[k] : pa_[k] + longest].all()):
                k += 1
            next_of[h] = k
            if k < stop:
                p = int(pa_[k])
                if not np.array_equal(text[a : a + longest], pattern[p : p + longest]):
                    continue
                tiles.append((a, p, longest))
                free_t[a : a + longest] = free_p[p : p + longest] = False
                done, marked = a + longest, True
        # what is left of this length may lie between the tiles of it
        longest -= not marked
    return tiles


_TILED = "doc_id {d}, item {i}, passage string, tiles int, longest int, covered int, passage_words int"


def tiled(pairs: DataFrame, least: int) -> DataFrame:
    """(doc_id, words, passages of item, passage and pattern) to the tiling of each pair."""
    item = pairs.schema["passages"].dataType.elementType["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, out = [], []
            inner = b.column(2).flatten()
            at = np.concatenate([[0], np.cumsum(b.column(2).value_lengths().to_numpy(zero_copy_only=False))])
            patterns = inner.field("pattern")
            for k in range(b.num_rows):
                words = b.column(1)[k].values.to_numpy().view(np.uint64)
                for i in range(at[k], at[k + 1]):
                    p = patterns[i].values.to_numpy().view(np.uint64)
                    t = tile(words, p, least)
                    owner.append(k)
                    out.append((len(t), max([0, *(n for _, _, n in t)]), sum(n for _, _, n in t), len(p)))
            cols = [pa.array(x, pa.int32()) for x in zip(*out)] if out else [pa.array([], pa.int32())] * 4
            yield pa.record_batch([b.column(0).take(pa.array(owner, pa.int64())), inner.field("item"), inner.field("passage"), *cols], names=["doc_id", "item", "passage", "tiles", "longest", "covered", "passage_words"])

    rows = pairs.select("doc_id", "words", "passages")
    return rows.mapInArrow(run, _TILED.format(d=pairs.schema["doc_id"].dataType.simpleString(), i=item)).where("tiles > 0")


def leaks(documents: DataFrame, passages: DataFrame, seed: int = SEED, most_seeds: int = MOST_SEEDS) -> DataFrame:
    """(doc_id, item, passage, tiles, longest, covered, passage_words) of each document and passage with a common seed.

    documents: (doc_id, text), passages: (item, passage, text). Null and empty texts, and passages
    of fewer than `seed` words, match nothing. Equal documents and passages each have their own rows,
    and so have documents of one doc_id.
    """
    ship(documents.sparkSession)
    sequences = cut(word_sequences(passages.select("item", "passage", "text")))
    seeds = cut(seeds_of(sequences, seed))
    docs = documents.select("doc_id", "text").where("text is not null")
    wanted, sieve = None, np.zeros(1 << SIEVE_BITS, bool)
    if seeds.count() <= most_seeds:
        wanted = np.unique(seeds.select("seed").toArrow().column(0).to_numpy().view(np.uint64))
        sieve[wanted >> np.uint64(64 - SIEVE_BITS)] = True
        hits = kept(seeded_documents(docs, seed, sieve, wanted, True), "hits")
    else:
        bits = seeds.select(F.shiftrightunsigned("seed", 64 - SIEVE_BITS).alias("bit")).distinct()
        sieve[bits.toArrow().column(0).to_numpy()] = True
        hits = kept(seeded_documents(docs, seed, sieve, None, False), "hits")
    met = hits.select("doc_id", F.explode(F.array_distinct("seeds")).alias("seed")).join(seeds, "seed").select("doc_id", "item", "passage").distinct()
    patterns = met.join(sequences.withColumnRenamed("words", "pattern"), ["item", "passage"])
    of_doc = patterns.groupBy("doc_id").agg(F.collect_list(F.struct("item", "passage", "pattern")).alias("passages"))
    if wanted is None:
        # the words of the few documents that share a seed are read again
        of_doc = kept(of_doc, "met")
        hits = word_sequences(docs.join(of_doc.select("doc_id"), "doc_id", "left_semi"))
    return tiled(hits.select("doc_id", "words").join(of_doc, "doc_id"), seed)


def eval_passages(spark: SparkSession, sf: str) -> DataFrame:
    return passages(table(spark, sf, "eval_questions"), "question_id", ["question"], ["expected_answer_points"])


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    found = leaks(table(spark, sf, "documents"), eval_passages(spark, sf))
    return found.where(F.col("longest") >= SEED).select("doc_id", F.col("item").alias("question_id")).distinct()


def p9_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Affected documents with the items they reveal and the best share of a passage that tiles of six words and more cover."""
    found = leaks(table(spark, sf, "documents"), eval_passages(spark, sf), seed=6)
    share = F.col("covered") / F.col("passage_words")
    kept = found.withColumn("share", share).where("longest >= 12 or share >= 0.6")
    return kept.groupBy("doc_id").agg(F.array_sort(F.collect_set("item")).alias("question_ids"), F.max("longest").alias("longest"), F.round(F.max("share"), 6).alias("share"))


QUERIES = {f.__name__: f for f in (p9_found, p9_leaks)}
SQL: dict[str, str] = {}
