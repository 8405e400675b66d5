"""Problem 10: school years a reader needs for each document.

A document's coverage rank is the size of the smallest frequency-ranked vocabulary that covers SHARE
of its words. How often a language uses a word is counted over the whole corpus, but simple texts
count more: a first formula from sentence length alone tells how simple a text is, and its words
count half as much for every grade above the first. Ranks by mere frequency would follow the mixture
of the corpus, in which words of middle difficulty are commonest. Coverage rank and sentence length
are then calibrated together against graded documents: the sums of a least-squares fit are taken in
SQL over all grades, and the formula is applied in SQL to all documents.

Vocabularies and sentences of different languages aren't comparable, so both measures count from
their mean in the document's language: grades of a language in which none was given assume that its
documents are as hard on average as those of the others.

Texts are read once; what follows works on each document's own word counts. The commonest HEAD words
and their ranks, bounded by that number, go to every task; a document whose coverage is decided among
rarer words gets their ranks by a join instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timbrel.functions.naming import spared
from timbrel.llm import codepoints as C
from timbrel.llm.languages import Languages, fitted, spoken
from timbrel.session import kept, ship, table

SHARE, HEAD = 0.6, 200_000
#: Beyond so many words a sentence is a text without full stops: its length says nothing.
MOST_WORDS = 40
_ENDS = np.array([ord(c) for c in ".!?…。？！"])


def _lists(values: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    at = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values))


_COUNTED = "language string, words bigint, sentences bigint, vocabulary array<bigint>, uses array<bigint>"
ADDED = ["language", "words", "sentences", "vocabulary", "uses", "log_sentence", "no_stops", "log_rank", "weight", "rank", "need", "tail", "coverage_rank", "far_rank", "grade"]


def counted(documents: DataFrame, languages: Languages) -> DataFrame:
    """The other columns and each text's language, words, sentences, distinct words and their uses.

    A word is told by a hash of its letters and language.
    """
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*languages.names, "und"], object)  # place -1 is und
        salts = C.mix(np.arange(len(names), dtype=np.uint64))
        for b in batches:
            for i, j, cps, rows in C.slices(b.column(at)):
                n = j - i
                cps, rows = C.form(True).apply(cps, rows)
                row, start, end, h = spoken(cps, rows)
                language, _ = languages.of_words(cps, row, start, end, h, n)
                words = np.bincount(row, minlength=n)
                sentences = np.where(words > 0, 1, 0)
                if len(h) > 1:
                    blank = np.concatenate([C.classes()[cps[1:]] == 0, [True]])
                    stop = np.isin(cps, _ENDS) & (blank | (cps > 0x2FFF))
                    stop[:-1] |= (cps[:-1] == 10) & (cps[1:] == 10)
                    stops = np.concatenate([[0], np.cumsum(stop)])
                    between = (row[1:] == row[:-1]) & (stops[start[1:]] > stops[end[:-1]])
                    sentences = sentences + np.bincount(row[1:][between], minlength=n)
                h = C.mix(h ^ salts[language][row])
                # sorted by row and the first half of the hash: a word that shares it with another of its text may come twice, which adds up the same
                order = np.argsort(row.astype(np.uint64) << np.uint64(32) | h >> np.uint64(32))
                h, row = h[order].view(np.int64), row[order]
                fresh = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
                uses = np.diff(np.append(fresh, len(h)))
                rest = b.remove_column(at).slice(i, n)
                cols = [pa.array(names[language], pa.string()), pa.array(words.astype(np.int64)), pa.array(sentences.astype(np.int64)), _lists(h[fresh], row[fresh], n), _lists(uses.astype(np.int64), row[fresh], n)]
                yield pa.record_batch([*rest.columns, *cols], names=[*rest.schema.names, *(c.split()[0] for c in _COUNTED.split(", "))])

    ship(documents.sparkSession)
    return documents.mapInArrow(run, T.StructType([*(f for f in documents.schema if f.name != "text"), *T._parse_datatype_string(_COUNTED).fields]))


def word_weights(counts: DataFrame) -> DataFrame:
    """(language, vocabulary, uses, weight) to (language, word, n): weighted uses in all texts, added up in each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            word, first, back = np.unique(b.column(1).flatten().to_numpy(), return_index=True, return_inverse=True)
            n = np.zeros(len(word), np.int64)
            np.add.at(n, back, b.column(2).flatten().to_numpy() * np.repeat(b.column(3).to_numpy(), size))
            owner = np.repeat(np.arange(b.num_rows), size)[first]
            yield pa.record_batch([b.column(0).take(pa.array(owner)), pa.array(word), pa.array(n)], names=["language", "word", "n"])

    rows = counts.select("language", "vocabulary", "uses", "weight")
    return rows.mapInArrow(run, "language string, word bigint, n bigint").groupBy("language", "word").agg(F.sum("n").alias("n"))


def ranks(counts: DataFrame) -> DataFrame:
    """(language, word, rank, through): one more than the number of the language's words used more often; equal counts share a rank.

    Counts are compared by their first twelve binary digits, so there are at most some 100,000
    different ones however large the corpus, and nothing that grows is sorted in one task.
    """
    coarse = counts.withColumn("n", F.expr("shiftleft(shiftright(n, greatest(length(bin(n)) - 12, 0)), greatest(length(bin(n)) - 12, 0))"))
    classes = coarse.groupBy("language", "n").agg(F.count("*").alias("k"))
    above = W.partitionBy("language").orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1)
    ranked = classes.withColumn("rank", F.coalesce(F.sum("k").over(above), F.lit(0)) + 1).withColumn("through", F.col("rank") - 1 + F.col("k"))
    return coarse.join(ranked, ["language", "n"]).select("language", "word", "rank", "through")


#: Above every rank in the head.
_FAR = np.int64(1 << 39)


def covered(counts: DataFrame, head: tuple[np.ndarray, np.ndarray], share: float) -> DataFrame:
    """vocabulary and uses to rank, the rank at which `share` of the words is covered; null where that isn't reached within the head: then `need` more words are to be covered by those of `tail`."""
    known, rank_of = head
    others = [c for c in counts.columns if c not in ("vocabulary", "uses")]
    rows = counts.select(*others, "vocabulary", "uses")
    tail_type = pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            lists, uses = b.column(len(others)), b.column(len(others) + 1).flatten().to_numpy()
            word, size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(n), size)
            if len(known):
                i = np.minimum(np.searchsorted(known, word), len(known) - 1)
                rank = np.where(known[i] == word, rank_of[i], _FAR)
            else:
                rank = np.full(len(word), _FAR)
            order = np.argsort(row << 40 | np.minimum(rank, (1 << 40) - 1))
            rank, word, used = rank[order], word[order], uses[order]
            total = np.bincount(row, used, n).astype(np.int64)
            need = np.maximum(1, np.ceil(total * share - 1e-9).astype(np.int64))
            through = np.concatenate([[0], np.cumsum(used)])
            begin = np.concatenate([[0], np.cumsum(size)])
            # the first word of the row at which as many uses as needed are covered
            place = np.minimum(np.searchsorted(through[1:], through[begin[:-1]] + need, "left"), max(len(rank) - 1, 0))
            got = rank[place] if len(rank) else np.zeros(n, np.int64)
            far = (total > 0) & (got == _FAR)
            tails, missing = [None] * n, np.zeros(n, np.int64)
            for k in np.flatnonzero(far).tolist():
                mine = np.arange(begin[k], begin[k + 1])
                mine = mine[rank[mine] == _FAR]
                tails[k] = [{"word": w, "n": c} for w, c in zip(word[mine].tolist(), used[mine].tolist())]
                missing[k] = need[k] - (total[k] - int(used[mine].sum()))
            cols = [pa.array(got, mask=far | (total == 0)), pa.array(missing), pa.array(tails, tail_type)]
            yield pa.record_batch([*b.columns[: len(others)], *cols], names=[*others, "rank", "need", "tail"])

    schema = T.StructType([*rows.schema.fields[:-2], *T._parse_datatype_string("rank bigint, need bigint, tail array<struct<word:bigint,n:bigint>>").fields])
    return rows.mapInArrow(run, schema)


def ranked(counts: DataFrame, weights: DataFrame, languages: int, share: float = SHARE, head: int = HEAD) -> DataFrame:
    """counts (doc_id, language, vocabulary, uses, ...) with coverage_rank in place of the word lists; null for texts without words."""
    table_ = kept(ranks(weights), "ranks")
    near = F.col("through") <= head // languages
    top = table_.where(near).select("word", "rank").toArrow()
    word, rank = top.column(0).to_numpy(), top.column(1).to_numpy()
    order = np.argsort(word)
    found = kept(covered(counts, (word[order], rank[order]), share), "ranked")
    far = found.where("tail is not null").select("doc_id", "need", F.explode("tail").alias("t")).select("doc_id", "need", "t.word", "t.n").join(table_.where(~near).select("word", "rank"), "word")
    so_far = W.partitionBy("doc_id").orderBy("rank")
    reached = far.withColumn("sum", F.sum("n").over(so_far)).where("sum >= need").groupBy("doc_id").agg(F.min("rank").alias("far_rank"))
    return found.join(reached, "doc_id", "left").withColumn("coverage_rank", F.coalesce("rank", "far_rank")).drop("rank", "far_rank", "need", "tail")


def centred(df: DataFrame, column: str) -> DataFrame:
    """A measure less its mean in the row's language; there are at most 677 languages."""
    means = df.groupBy("language").agg(F.avg(column).alias("_mean"))
    return df.join(F.broadcast(means), "language", "left").withColumn(column, F.col(column) - F.col("_mean")).drop("_mean")


#: Inputs of the formulas in SQL. A text without full stops has a formula of its own in which sentence length doesn't count.
SENTENCE_TERMS = {"one": "1.0", "log_sentence": "if(no_stops, 0, log_sentence)", "no_stops": "if(no_stops, 1.0, 0.0)"}
TERMS = SENTENCE_TERMS | {"log_rank": "log_rank", "no_stops_rank": "if(no_stops, log_rank, 0)"}


def calibrate(measured: DataFrame, labels: DataFrame, terms: Mapping[str, str] = TERMS) -> list[float]:
    """Coefficients of the terms by least squares over all graded documents; raters of one document are averaged.

    The sums of products are one SQL aggregate; only they (at most 20 numbers) come to the driver.
    With fewer grades than twice the terms the formula is the mean grade (8.5, the middle of the scale, if there is none).
    """
    # merged by shuffle: the grades grow with the corpus
    graded = labels.where("grade is not null").groupBy("doc_id").agg(F.avg("grade").alias("grade")).hint("merge")
    rows = measured.where("words > 0").select("doc_id", *(F.expr(e).cast("double").alias(k) for k, e in terms.items())).join(graded, "doc_id")
    names = list(terms)
    sums = rows.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for i, a in enumerate(names) for b in [*names[i:], "grade"])).first().asDict()
    n = sums["one|one"] or 0
    if n < 2 * len(names):
        return [sums["one|grade"] / n if n else 8.5, *[0.0] * (len(names) - 1)]
    gram = np.array([[sums.get(f"{a}|{b}", sums.get(f"{b}|{a}")) for b in names] for a in names])
    return np.linalg.lstsq(gram, np.array([sums[f"{a}|grade"] for a in names]), rcond=None)[0].tolist()


def formula(coefficients: list[float], terms: Mapping[str, str] = TERMS):
    """The formula as a column: a grade between 1 and 16, null for texts without words."""
    total = " + ".join(f"({c!r}D) * ({e})" for c, e in zip(coefficients, terms.values()))
    return F.expr(f"if(words > 0, least(greatest({total}, 1), 16), null)")


def measured(documents: DataFrame, labels: DataFrame, languages: Languages, share: float = SHARE, head: int = HEAD) -> DataFrame:
    """(doc_id, text, ...) to language, words, sentences, coverage_rank, and the formula's log_sentence, no_stops and log_rank; the text is dropped.

    Texts without words (null, empty, numbers only) have nulls in the rank and zeros in the counts. Other
    columns are kept; one named like a measure comes out as <name>_input. doc_id is unique.
    """
    counts = kept(counted(spared(documents, ADDED), languages), "counts")
    length = F.try_divide("words", "sentences")
    counts = counts.withColumn("no_stops", F.coalesce(length > MOST_WORDS, F.lit(False))).withColumn("log_sentence", F.when((F.col("words") > 0) & ~F.col("no_stops"), F.log(F.greatest(length, F.lit(2.0)))))
    counts = centred(counts, "log_sentence")
    simple = formula(calibrate(counts, labels, SENTENCE_TERMS), SENTENCE_TERMS)
    # whole numbers, so that sums don't depend on their order
    weight = F.round(F.pow(F.lit(2.0), 16 - simple)).cast("bigint")
    weights = word_weights(counts.where("words > 0").withColumn("weight", weight))
    out = ranked(counts, weights, len(languages.names) + 1, share, head)
    return kept(centred(out.withColumn("log_rank", F.log("coverage_rank")), "log_rank"), "measured")


def graded(measured: DataFrame, coefficients: list[float]) -> DataFrame:
    """The formula over all rows: `grade` with two places."""
    return measured.withColumn("grade", F.round(formula(coefficients), 2))


def levels(documents: DataFrame, labels: DataFrame, languages: Languages) -> DataFrame:
    """documents (doc_id, text, ...) to their measures and grade; labels (doc_id, grade)."""
    m = measured(documents, labels, languages)
    return graded(m, calibrate(m, labels)).drop("log_sentence", "no_stops", "log_rank")


def p10_levels(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    languages = fitted(docs.select("text", F.col("lang").alias("label")))
    return levels(docs.select("doc_id", "source", "doc_kind", "text"), table(spark, sf, "reading_labels"), languages)


def p10_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Reading level of each source and kind."""
    g = p10_levels(spark, sf)
    return g.groupBy("source", "doc_kind").agg(F.count("grade").alias("documents"), F.round(F.avg("grade"), 2).alias("mean_grade"), F.round(F.percentile_approx("grade", 0.5, 10_000), 2).alias("median_grade"), F.sum("words").alias("words"))


QUERIES = {f.__name__: f for f in (p10_levels, p10_profile)}
SQL: dict[str, str] = {}
