"""Problem 1: oversized texts cut into pieces under a token limit where the talk pauses.

A batch's tokens and possible cuts come from code-point arrays. Lexical cohesion is measured at every
possible cut: the cosine of the word counts in the blocks of tokens before and after it, words that
are common in the text counting less; a valley of that curve marks a change of topic. Each piece
ends at the deepest valley within its window, where a cut at a pause counts as deeper by a bounded
amount (the end of a sentence most, then of a line, then of a clause); a cut inside a run of letters
is taken only if the window has no other. The next piece begins `overlap` tokens before the cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timbrel.functions.naming import spared
from timbrel.llm import codepoints as C
from timbrel.session import ship, table

LIMIT, OVERLAP, BLOCK = 240, 48, 60
#: How many tokens away the heights beside a valley are looked for.
REACH = 120
#: Tokens whose cohesion is measured at a time; bounds the memory of very long texts.
STRIP = 1024
#: How much deeper a valley counts at a word, clause, line and sentence end; depths lie between 0 and 2.
PAUSE = (0.0, 0.4, 0.75, 1.0)
# What ends a sentence, a clause, and what may close after an end.
ENDS, CLAUSES, CLOSERS = ".!?…。？！", ",;:、，；：—–", "\"'”’)]»」』"


@cache
def _kinds() -> np.ndarray:
    """0 white space, 1 part of a run, 2 alone."""
    import unicodedata

    out = np.full(C.TOP, 2, np.uint8)
    for cp in range(0x323B0):
        ch = chr(cp)
        k = unicodedata.category(ch)
        if ch.isspace() or k[0] == "Z":
            out[cp] = 0
        elif (k[0] == "L" or k == "Nd" or ch == "_") and not (0x3040 <= cp <= 0x30FF or 0x3400 <= cp <= 0x9FFF):
            out[cp] = 1
    return out


def tokens(cps: np.ndarray, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the tokens: one character of the kana and Han blocks, a run of other letters, digits and underscores, or any other character that isn't white space; none crosses a row offset."""
    kind = _kinds()[cps]
    edge = np.zeros(len(cps) + 1, bool)
    edge[[0, -1] if rows is None else rows] = True
    before, after = np.concatenate([[0], kind[:-1]]), np.concatenate([kind[1:], [0]])
    start = np.flatnonzero((kind == 2) | (kind == 1) & ((before != 1) | edge[:-1]))
    end = np.flatnonzero((kind == 2) | (kind == 1) & ((after != 1) | edge[1:])) + 1
    return start, end


def pauses(cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How natural a cut before each token is: 4 a sentence has ended, 3 a line, 2 a clause, 1 a word, 0 inside a word's run."""
    out = np.zeros(len(start), np.uint8)
    if len(start) < 2:
        return out
    gap = start[1:] > end[:-1]
    lines = np.concatenate([[0], np.cumsum(cps == 10)])
    newline = lines[start[1:]] > lines[end[:-1]]
    last = cps[end[:-1] - 1]
    end_mark = np.isin(last, [ord(c) for c in ENDS])
    closer = np.isin(last, [ord(c) for c in CLOSERS])
    ended = end_mark.copy()
    ended[1:] |= closer[1:] & end_mark[:-1]
    wide = np.isin(last, [ord(c) for c in "。？！"])
    mark_next = np.isin(cps[start[1:]], [ord(c) for c in ENDS + CLOSERS])
    sentence = ended & (gap | wide) & ~(mark_next & ~gap)
    clause = np.isin(last, [ord(c) for c in CLAUSES]) & (gap | (last > 0x2FFF))
    out[1:] = np.select([sentence, newline, clause, gap], [4, 3, 2, 1], 0)
    return out


def depths(cps: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Depth of the cohesion valley before each token: how far the greatest heights within REACH on both sides are above it.

    Words are counted exactly, STRIP places at a time.
    """
    n = len(start)
    folded, rows = C.form(True).apply(cps, np.concatenate([np.stack([start, end], 1).ravel(), [len(cps)]]))
    h = C.span_hashes(C.mix(folded), rows[0:-1:2], rows[1::2])
    _, word, uses = np.unique(h, return_inverse=True, return_counts=True)
    letter = (C.classes()[cps[start]] & C.WORD) > 0
    # words that fill the text say little about its topics, signs nothing
    square = np.where(letter, np.log(n / uses[word]) ** 2, 0.0)
    out = np.zeros(n, np.float32)
    margin = REACH + block
    for a in range(0, n, STRIP):
        lo, hi = max(0, a - margin), min(n, a + STRIP + margin)
        score = _cosines(word[lo:hi], square[lo:hi], block)
        deep = _peak(score) + _peak(score[::-1])[::-1] - 2 * score
        out[a : a + STRIP] = deep[a - lo : min(n, a + STRIP) - lo]
    return out


def _cosines(word: np.ndarray, square: np.ndarray, block: int) -> np.ndarray:
    """Cosine of the words in the blocks before and from each place; only words that come again need counters of their own."""
    n = len(word)
    _, column, uses = np.unique(word, return_inverse=True, return_counts=True)
    again = uses > 1
    column = (np.cumsum(again) - 1)[column] + np.where(again[column], 0, -n - 1)
    shared = np.flatnonzero(column >= 0)
    counts = np.zeros((n + 1, int(again.sum())), np.float32)
    counts[shared + 1, column[shared]] = 1
    np.cumsum(counts, axis=0, out=counts)
    weight = np.zeros(counts.shape[1])
    weight[column[shared]] = square[shared]
    alone = np.concatenate([[0.0], np.cumsum(np.where(column >= 0, 0.0, square))])
    place = np.arange(n)
    lo, hi = np.maximum(place - block, 0), np.minimum(place + block, n)
    before, after = counts[place] - counts[lo], counts[hi] - counts[place]
    size = [(x * x) @ weight + alone[b] - alone[a] for x, a, b in ((before, lo, place), (after, place, hi))]
    return (before * after) @ weight / np.sqrt(np.maximum(size[0] * size[1], 1e-12))


def _peak(score: np.ndarray) -> np.ndarray:
    """For each place, the greatest height within REACH places to its left, itself included."""
    padded = np.concatenate([np.full(REACH, -np.inf), score])
    return np.lib.stride_tricks.sliding_window_view(padded, REACH + 1).max(1)


def cut_places(cps: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP, pause: tuple[float, ...] = PAUSE) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Token spans of a text and its pieces (first token, first own token, end token)."""
    start, end = tokens(cps)
    n = len(start)
    if n <= limit:
        return start, end, [(0, 0, n)]
    kind = pauses(cps, start, end)
    worth = depths(cps, start, end) + np.array([-10.0, *pause])[kind]
    pieces, own = [], 0
    while True:
        first = max(0, own - overlap)
        if n - first <= limit:
            pieces.append((first, own, n))
            return start, end, pieces
        lo, hi = max(own + 1, first + limit // 2), first + limit
        # of equals the last, so that pieces are no shorter than they must be
        window = worth[lo : hi + 1]
        cut = hi - int(np.argmax(window[::-1]))
        pieces.append((first, own, cut))
        own = cut


_FIELDS = [T.StructField(n, t) for n, t in (("piece_index", T.IntegerType()), ("piece_text", T.StringType()), ("token_count", T.IntegerType()), ("char_start", T.IntegerType()), ("char_end", T.IntegerType()), ("overlap_tokens", T.IntegerType()), ("share_from", T.DoubleType()), ("share_to", T.DoubleType()))]
ADDED = [*(f.name for f in _FIELDS), "piece_start", "piece_end"]
_SCHEMA = pa.struct([("piece_index", pa.int32()), ("piece_text", pa.string()), ("token_count", pa.int32()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("overlap_tokens", pa.int32()), ("share_from", pa.float64()), ("share_to", pa.float64())])


def _split(batches: Iterator[pa.RecordBatch], at: int, limit: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, cps, rows in C.slices(b.column(at)):
            starts, _ = tokens(cps, rows)
            count = np.diff(np.searchsorted(starts, rows))
            large = np.flatnonzero(count > limit)
            owner, out = [], []
            for k in large.tolist():
                text = cps[rows[k] : rows[k + 1]]
                start, end, pieces = cut_places(text, limit, overlap)
                total = len(start)
                for p, (first, own, stop) in enumerate(pieces):
                    a = int(start[first]) if first else 0
                    z = int(start[stop]) if stop < total else len(text)
                    owner.append(i + k)
                    out.append({"piece_index": p, "piece_text": text[a:z].tobytes().decode("utf-32-le"), "token_count": stop - first, "char_start": a, "char_end": z, "overlap_tokens": own - first, "share_from": first / total, "share_to": stop / total})
            rest, names = b.remove_column(at), [*(x for k, x in enumerate(b.schema.names) if k != at), *(f.name for f in _SCHEMA)]
            # texts within the limit stay as they are
            keep = np.flatnonzero(count <= limit)
            if len(keep):
                m, take = len(keep), pa.array(keep + i)
                same = {"piece_index": np.zeros(m, np.int32), "piece_text": b.column(at).take(take).cast(pa.string()), "token_count": count[keep].astype(np.int32), "char_start": np.zeros(m, np.int32), "char_end": np.diff(rows)[keep].astype(np.int32), "overlap_tokens": np.zeros(m, np.int32), "share_from": np.zeros(m), "share_to": np.ones(m)}
                yield pa.record_batch([*rest.take(take).columns, *(c if isinstance(c, pa.Array) else pa.array(c) for c in same.values())], names=names)
            if out:
                yield pa.record_batch([*rest.take(pa.array(owner, pa.int64())).columns, *pa.array(out, _SCHEMA).flatten()], names=names)


def split_oversized(df: DataFrame, text: str, limit: int = LIMIT, overlap: int = OVERLAP, start: str | None = None, end: str | None = None) -> DataFrame:
    """Each row to its pieces: the other columns, piece_index, piece_text, token_count, char_start, char_end, overlap_tokens, piece_start, piece_end.

    piece_text is the text from char_start to char_end (code points); consecutive pieces share
    exactly `overlap` tokens, each piece has at most `limit`, and without the shared tokens the
    pieces join to the text. A piece's times divide the row's interval by its place among the
    tokens; reversed bounds are read in order, a null bound gives null times. A null text is one
    piece with null text and no tokens, an empty or blank one is one piece; equal rows are split
    alike. limit must exceed twice the overlap. A column of `df` that is named like one of a piece's
    comes out as <name>_input.
    """
    if limit <= 2 * overlap or overlap < 0:
        raise ValueError("limit must exceed twice the overlap")
    df = spared(df, set(ADDED) - {text, start, end})
    others = [c for c in df.columns if c != text]
    at = len(others)
    schema = T.StructType([*(f for f in df.schema if f.name != text), *_FIELDS])
    ship(df.sparkSession)
    out = df.select(*others, text).mapInArrow(lambda it: _split(it, at, limit, overlap), schema)
    if start and end:
        lo, hi = F.least(start, end), F.greatest(start, end)
        known = F.col(start).isNotNull() & F.col(end).isNotNull()
        for name, share in (("piece_start", "share_from"), ("piece_end", "share_to")):
            out = out.withColumn(name, F.when(known, F.round(lo + (hi - lo) * F.col(share), 3)))
    return out.drop("share_from", "share_to")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    pieces = split_oversized(table(spark, sf, "chunks").select("chunk_id", "chunk_text"), "chunk_text")
    return pieces.where("piece_index = 1").select("chunk_id")


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """All chunks as pieces with their seconds."""
    chunks = table(spark, sf, "chunks").select("chunk_id", "transcript_id", "chunk_index", "chunk_text", "start_second", "end_second")
    return split_oversized(chunks, "chunk_text", start="start_second", end="end_second").drop("start_second", "end_second")


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces)}

_HAN = r"\x{3040}-\x{30ff}\x{3400}-\x{9fff}"
SQL = {
    "p1_found": f"""select chunk_id from (
      select chunk_id, len(regexp_extract_all(chunk_text, '[{_HAN}]')) as han, regexp_replace(chunk_text, '[{_HAN}]', ' ', 'g') as rest from chunks)
      where han + len(regexp_extract_all(rest, '[\\p{{L}}\\p{{Nd}}_]+|[^\\s\\p{{Z}}\\p{{L}}\\p{{Nd}}_]')) > 240""",
}
