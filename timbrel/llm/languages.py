"""Language of texts by character profiles that are fitted on the given texts and their labels.

Labels are unreliable, but mostly right: what is counted is how often each language's texts use each
word, word beginning and word ending (three letters), hashed into BUCKETS counters, over all texts
with a plain two-letter label. A label each of whose words is about as likely in some more frequent
one (a wrong label, whatever it mixes) is dropped. A text's language is the profile under which its words are likeliest; a
text much of whose words, beginnings and endings are new to that profile is `und`. So the languages
are those of the labels, no closed set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbrel.llm import codepoints as C
from timbrel.session import ship

#: Counters of a profile. A label has two letters, so there are at most 676 profiles; a model is at most 676 * BUCKETS numbers.
BUCKETS = 1 << 15
#: A label's words are this much likelier (nats a word) than in the best of the others; labels with fewer words than LEAST in all texts give no profile.
APART, LEAST = 3.0, 400
#: A text is of the likeliest language only if at most this share of its words, beginnings and endings is new to it.
UNSEEN = 0.5


def plain_label(label: Column | str) -> Column:
    """'en' of ' EN', 'en-US', 'en_GB'; null for what isn't a two-letter code with or without a region."""
    c = F.lower(F.trim(label))
    return F.nullif(F.regexp_extract(c, r"^([a-z]{2})(?:[-_][a-z0-9]+)*$", 1), F.lit(""))


def spoken(cps: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, end, hash) of the words of folded texts that aren't numbers; a Han or kana character is a word."""
    row, start, end, h = C.words(cps, rows, (cps >= 0x3040) & (cps <= 0x30FF) | (cps >= 0x3400) & (cps <= 0x9FFF))
    digits = np.zeros(len(cps) + 1, np.int64)
    np.cumsum((C.classes()[cps] & C.DIGIT) > 0, out=digits[1:])
    word = digits[end] - digits[start] < end - start
    return row[word], start[word], end[word], h[word]


def _features(cps: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Three buckets for each word: of itself, its first and its last three letters."""
    # three letters lie in a number of 64 bits; a blank stands for those that a short word lacks
    code = cps.astype(np.uint64)
    at = lambda i, inside: np.where(inside, code[np.minimum(i, len(code) - 1)], np.uint64(32))
    two, three = end - start > 1, end - start > 2
    begin = code[start] << np.uint64(42) | at(start + 1, two) << np.uint64(21) | at(start + 2, three)
    last = code[end - 1] << np.uint64(42) | at(end - 2, two) << np.uint64(21) | at(end - 3, three)
    mask = np.uint64(BUCKETS - 1)
    return np.stack([h & mask, C.mix(begin) & mask, C.mix(last + np.uint64(1 << 63)) & mask], 1).astype(np.int32)


@dataclass(frozen=True)
class Languages:
    """names, log-likelihoods (BUCKETS, names), and which buckets each language has."""

    names: list[str]
    weight: np.ndarray
    known: np.ndarray

    def of(self, column: pa.Array, least: float = 10.0) -> tuple[list[str | None], list[bool]]:
        """(language, sure) of each text. Sure: ahead of every other language by `least` nats; null for null."""
        out: list[str | None] = []
        sure: list[bool] = []
        for _, _, cps, rows in C.slices(column):
            cps, rows = C.form(True).apply(cps, rows)
            language, ahead = self.of_words(cps, *spoken(cps, rows), len(rows) - 1)
            out += [self.names[k] if k >= 0 else "und" for k in language.tolist()]
            sure += (ahead >= least).tolist()
        if column.null_count:
            out = [x if v else None for x, v in zip(out, column.is_valid().to_pylist())]
        return out, sure

    def of_words(self, cps: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in names or -1, nats ahead of the next) of each of n texts, from their words as `spoken` gives them."""
        language, ahead = np.full(n, -1), np.zeros(n)
        if not len(h) or not self.names:
            return language, ahead
        bucket = _features(cps, start, end, h)
        full, first = np.unique(row, return_index=True)
        score = np.zeros((len(full), len(self.names)))
        for k in range(0, 3):
            score += np.add.reduceat(self.weight[bucket[:, k]], first, axis=0, dtype=np.float64)
        best = score.argmax(1)
        size = np.diff(np.append(first, len(h)))
        seen = np.add.reduceat(self.known[bucket, np.repeat(best, size)[:, None]].sum(1), first)
        fits = seen >= (1 - UNSEEN) * 3 * size
        language[full[fits]] = best[fits]
        if len(self.names) > 1:
            ranked = np.partition(score, -2, axis=1)
            ahead[full[fits]] = (ranked[:, -1] - ranked[:, -2])[fits]
        else:
            ahead[full[fits]] = np.inf
        return language, ahead


def fitted(texts: DataFrame) -> Languages:
    """(text, label) to the profiles of the labels; counts are over all texts, added up in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, cps, rows in C.slices(b.column(0)):
                cps, rows = C.form(True).apply(cps, rows)
                row, start, end, h = spoken(cps, rows)
                label = np.array(b.column(1).slice(i, j - i).to_pylist(), object)
                names, code = np.unique(label.astype(str), return_inverse=True)
                cell = code.astype(np.int64)[row][:, None] * BUCKETS + _features(cps, start, end, h)
                count = np.bincount(cell.ravel(), minlength=len(names) * BUCKETS)
                which = np.flatnonzero(count)
                n = count[which]
                yield pa.record_batch([pa.array(names[which // BUCKETS].tolist(), pa.string()), pa.array((which % BUCKETS).astype(np.int32)), pa.array(n.astype(np.int64))], names=["label", "bucket", "n"])

    ship(texts.sparkSession)
    labelled = texts.select("text", plain_label("label").alias("label")).where("text is not null and label is not null")
    counts = labelled.mapInArrow(run, "label string, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    label, names = np.array(counts.column(0).to_pylist(), object), sorted(set(counts.column(0).to_pylist()))
    table = np.zeros((len(names), BUCKETS))
    where = {x: k for k, x in enumerate(names)}
    table[[where[x] for x in label], counts.column(1).to_numpy()] = counts.column(2).to_numpy()
    return profiles(names, table)


def profiles(names: list[str], counts: np.ndarray) -> Languages:
    """Counts (names, BUCKETS) to the model; labels of one language are told by how likely each finds the other's letters."""
    total = counts.sum(1)
    logp = np.log((counts + 0.1) / (total[:, None] + 0.1 * BUCKETS)) if len(names) else counts
    held: list[int] = []
    for k in np.argsort(-total, kind="stable").tolist():
        if total[k] < 3 * LEAST:
            continue
        own = counts[k] / total[k]
        if not held or 3 * (own @ (logp[k] - logp[held].max(0))) >= APART:
            held.append(k)
    held.sort()
    return Languages([names[k] for k in held], np.ascontiguousarray(logp[held].T, np.float32), np.ascontiguousarray((counts[held] > 0).T))
