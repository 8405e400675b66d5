"""Problem 7: captions to clean speaker turns.

A finite-state line parser walks each caption and hands out pieces: what may be a label, and the
words spoken after it. Which of the possible labels name a speaker is settled by joins of the
distinct label spellings with the table of speakers, so neither table has to fit anywhere. Captions
of a payload lie in one row: they are parsed once, and the pieces are walked in that row, where those
of one speaker that follow each other are merged; no text is shuffled. The labels found to name
someone go to all tasks if there are at most MOST_LABELS; beyond that each payload gets its own by a
join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbrel.llm import codepoints
from timbrel.llm.leaks import CUE_WORDS_IN, CUES
from timbrel.session import kept, ship, table

#: Spellings that name a speaker, of at most 80 characters, that go to every task.
MOST_LABELS = 100_000

# Titles and roles that stand beside a name, and what follows the word of a group.
TITLES = ["professor", "prof", "dr", "doctor", "ta", "mr", "mrs", "ms", "miss", "mx", "sir", "lecturer", "instructor", "teacher", "guest", "assistant", "host", "speaker"]
COMPANY = ["member", "members"]
FILLERS = ["um", "uh", "er"]
_CUES = frozenset(CUES)

_TOKEN = re.compile(
    r"""(?P<stamp>[\[(]?(?<!\d)\d{1,3}:\d\d(?::\d\d)?(?:[.,]\d{1,3})?(?!\d)[\])]?(?:\s*-->\s*[\d:.,]+)?)
      | <v(?:\.[\w.]+)?\s+(?P<voice>[^<>]{1,80})>
      | (?P<tag></?[A-Za-z][^<>\n]{0,80}>)
      | \[(?P<square>[^\[\]]{1,80})\]\s*(?::(?!\d))?
      | \((?P<round>[^()]{1,80})\)(?P<colon>\s*:(?!\d))?
      | (?P<arrow>>>+)
      | (?P<line>\n)
      | (?P<note>[♪♫]+)
      | (?P<dash>[-–—](?=\s))
      | (?P<end>[.!?…。？！]+(?=\s|$))
      | (?P<blank>[^\S\n]+)
      | (?P<word>[^\s\[\](<>♪♫]+?(?=[.!?…。？！]+(?:\s|$)|[\s\[\](<>♪♫]|$)|[\[\](<>])""",
    re.X,
)
#: Up to six words, a full stop only after a short one (a title or an initial), perhaps a number, then a colon.
_LABEL = re.compile(r"(?P<name>(?:[^\W\d_]{1,4}\.\s*|[^\W\d_][\w'’-]*,?\s+){0,5}[^\W\d_][\w'’-]*\.?(?:\s+#?\d{1,2})?)\s*:(?!\d)")
_FILLER = re.compile(r"(?<![\w'-])(?:um|uh|er)(?![\w'-]),?\s*", re.I)
_PART = re.compile(r"[^\W_]+")
_BARE_STAMP = r"^[\[(]\s*\d{1,3}:\d\d(?::\d\d)?(?:[.,]\d{1,3})?\s*[\])]$"
#: What the parser reacts to, a dash apart; a caption without any of it is words only. Without the first four it holds no label.
_SPECIAL = np.array([ord(c) for c in ":[<(>♪♫-–—"])
_LABELLED = _SPECIAL[:4]

#: States of the parser: at the head of a line, after a speaker mark, after the end of a sentence, in running words.
HEAD, MARKED, ENDED, WORDS = range(4)
#: Token kind to the state it leads to from each state; the rest is words.
_NEXT = {
    "stamp": (HEAD, MARKED, ENDED, WORDS),
    "tag": (HEAD, MARKED, ENDED, WORDS),
    "square": (HEAD, MARKED, ENDED, WORDS),
    "round": (HEAD, MARKED, ENDED, WORDS),
    "note": (HEAD, MARKED, ENDED, WORDS),
    "blank": (HEAD, MARKED, ENDED, WORDS),
    "line": (HEAD, MARKED, HEAD, HEAD),
    "arrow": (MARKED, MARKED, MARKED, MARKED),
    "dash": (MARKED, MARKED, ENDED, WORDS),
    "end": (ENDED, ENDED, ENDED, ENDED),
}


def parse(text: str) -> list[tuple[str | None, str]]:
    """Pieces (possible label or None, words spoken) of one caption in its consistent form.

    Stamps, tags, notes, speaker dashes and, in running words, sound cues in round brackets are dropped. Whether a label
    names anyone isn't known here: the words of a piece whose label turns out to name nobody get it back in `speaker_turns`,
    unless it is a sound cue.
    """
    pieces: list[tuple[str | None, list[str]]] = [(None, [])]
    state, i, n = HEAD, 0, len(text)
    while i < n:
        if state != WORDS and (m := _LABEL.match(text, i)):
            pieces.append((m["name"], []))
            state, i = WORDS, m.end()
            continue
        m = _TOKEN.match(text, i)
        kind = m.lastgroup if m else "word"
        if kind == "colon":
            kind = "round"
        piece = m.group(0) if m else text[i]
        i = m.end() if m else i + 1
        if kind == "voice":
            pieces.append((m["voice"], []))
            state = WORDS
        elif kind == "square":
            pieces.append((f"[{m['square']}]", []))
        elif kind == "round" and (m["colon"] or state in (HEAD, MARKED)):
            pieces.append((f"({m['round']})", []))
        elif kind == "dash" and (state in (HEAD, MARKED) or state == ENDED and _LABEL.match(text, i + len(text[i:]) - len(text[i:].lstrip()))):
            pass
        elif kind == "round" and not _cue(f"({m['round']})") or kind in ("word", "end", "dash", "blank", "line"):
            pieces[-1][1].append(" " if kind in ("blank", "line") else piece)
        state = _NEXT[kind][state] if kind in _NEXT else WORDS
    return [(a, _spoken("".join(b))) for a, b in pieces if a is not None or b]


def _cue(remark: str) -> bool:
    """Whether a remark, with its brackets, is a stamp or sound cue.

    Square brackets hold no spoken words as a rule, so there a cue word is enough; round ones are a cue only if short.
    """
    words = _PART.findall(remark.lower())
    return not words or bool(re.match(_BARE_STAMP, remark)) or (remark[0] == "[" or len(words) <= CUE_WORDS_IN) and not _CUES.isdisjoint(words)


def _spoken(words: str) -> str:
    return " ".join(_FILLER.sub("", words).split())


PIECES = "pieces array<struct<idx:int,start_ms:bigint,label:string,words:string>>"
_PIECES = pa.list_(pa.struct([("idx", pa.int32()), ("start_ms", pa.int64()), ("label", pa.string()), ("words", pa.string())]))


def pieces(payloads: DataFrame, labels_only: bool = False) -> DataFrame:
    """(raw_id, segments with text and start) to (raw_id, pieces in segment order); with labels_only pieces without a label are left out."""
    rows = payloads.select("raw_id", F.transform("segments", lambda s: s["text"]).alias("texts"), F.transform("segments", lambda s: s["start"].cast("double")).alias("starts"))
    kind = payloads.schema["raw_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # few payloads at a time: what is held doesn't grow with the batch
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                yield pa.record_batch([part.column(0), _parsed(part.column(1), part.column(2), labels_only)], names=["raw_id", "pieces"])

    ship(payloads.sparkSession)
    return rows.mapInArrow(run, f"raw_id {kind}, {PIECES}")


def _parsed(texts: pa.Array, starts: pa.Array, labels_only: bool) -> pa.Array:
    flat, when = codepoints.consistent(texts.flatten()), starts.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    asks = np.zeros(len(flat), bool)
    for i, j, cps, rows in codepoints.slices(flat):
        hit = np.concatenate([[0], np.cumsum(np.isin(cps, _LABELLED if labels_only else _SPECIAL))])
        asks[i:j] = hit[rows[1:]] > hit[rows[:-1]]
    said: list[list[tuple]] = [[] for _ in range(len(flat))]
    for k in range(len(flat)) if not labels_only else np.flatnonzero(asks).tolist():
        t = flat[k].as_py()
        if t is not None:
            found = parse(t) if asks[k] else [(None, _spoken(t))]
            said[k] = [(a, None) for a, _ in found if a is not None] if labels_only else found
    out, at = [], 0
    sizes = texts.value_lengths().to_pylist()
    for n in sizes:
        mine = []
        # null and NaN starts come last, as in a sort
        for k in np.argsort(when[at : at + (n or 0)], kind="stable").tolist():
            ms = None if not abs(when[at + k]) < 1e12 else int(np.floor(when[at + k] * 1000 + 0.5))
            mine += [{"idx": k, "start_ms": ms, "label": a, "words": w} for a, w in said[at + k]]
        out.append(mine)
        at += n or 0
    return pa.array(out, _PIECES)


def _parts(name):
    """The words of a name in lower case."""
    return F.filter(F.split(F.lower(name), r"(?U)[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)


def _shorter(word):
    """A word and all it becomes by dropping one letter: two words share one if they differ by one letter or a swap."""
    return F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))))


def _one_less(word: str) -> set[str]:
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def named(labels: DataFrame, speakers: DataFrame) -> DataFrame:
    """(label, speaker_id) of the distinct labels that name exactly one speaker.

    A label is read without titles, roles, fillers and brackets, each title with a letter wrong at most. Each of its words must be an
    initial, a part of the name or a part with one letter changed, dropped, added or swapped (parts
    of four letters or more), and at least one must be a part. The word of an unnamed speaker may be followed by 'member' or a number.
    """
    drop = F.array(*map(F.lit, [*TITLES, *FILLERS]))
    titles, company = (F.array(*map(F.lit, sorted({v for t in ts if len(t) > 4 for v in _one_less(t)}))) for ts in (TITLES, COMPANY))
    said = labels.select("label", F.filter(_parts(F.col("label")), lambda w: ~F.array_contains(drop, w)).alias("all"))
    # a title may be misspelt too, unless nothing else is left to be a name
    others = F.filter("all", lambda w: ~F.arrays_overlap(_shorter(w), titles))
    said = said.withColumn("all", F.when(F.size(others) > 0, others).otherwise(F.col("all"))).where("size(all) between 1 and 4")
    in_company = lambda w: w.rlike(r"^\d+$") | F.arrays_overlap(_shorter(w), company)
    words = said.select("label", F.posexplode(F.filter("all", lambda w: ~in_company(w))).alias("i", "w"), F.exists("all", in_company).alias("group"))
    parts = speakers.select("speaker_id", (F.col("speaker_role") == "unnamed").alias("unnamed"), F.posexplode(_parts(F.col("full_name"))).alias("k", "part"))
    full = words.where("length(w) > 1").select("label", "i", "w", "group", F.explode(_shorter(F.col("w"))).alias("v"))
    known = parts.select("speaker_id", "unnamed", "k", "part", F.explode(_shorter(F.col("part"))).alias("v"))
    near = full.join(known, "v").where("w = part or (length(part) > 3 and length(w) > 3)")
    near = near.where("not group or unnamed").select("label", "i", "speaker_id", "k", F.expr("w <> part").alias("misspelt"), F.lit(True).alias("whole")).distinct()
    first = words.where("length(w) = 1").withColumnRenamed("w", "v")
    initial = first.join(parts.withColumn("v", F.substring("part", 1, 1)), "v").select("label", "i", "speaker_id", "k", F.lit(False).alias("misspelt"), F.lit(False).alias("whole"))
    hits = near.unionByName(initial).groupBy("label", "speaker_id").agg(F.count_distinct("i").alias("n"), F.count_distinct("k").alias("nk"), F.max("whole").alias("whole"), F.sum(F.expr("int(misspelt)")).alias("wrong"))
    size = words.groupBy("label").agg(F.max("i").alias("last"))
    fits = hits.join(size, "label").where("whole and n = last + 1 and nk >= n")
    one = fits.groupBy("label").agg(F.min(F.struct("wrong", "speaker_id")).alias("best"), F.collect_set(F.struct("wrong", "speaker_id")).alias("all"))
    alone = F.size(F.filter("all", lambda x: x["wrong"] == F.col("best.wrong"))) == 1
    return one.where(alone).select("label", F.col("best.speaker_id").alias("speaker_id"))


def speakers_of(said: DataFrame, speakers: DataFrame, most: int = MOST_LABELS) -> tuple[DataFrame, dict[str, int] | None]:
    """Pieces with the speakers that their labels name: in a table for all tasks, or, beyond `most`, in a map in each row."""
    labels = said.select(F.explode(F.transform(F.filter("pieces", lambda p: p["label"].isNotNull()), lambda p: p["label"])).alias("label"))
    who = kept(named(labels.distinct(), speakers), "labels")
    if who.count() <= most:
        return said, {r["label"]: r["speaker_id"] for r in who.collect()}
    used = said.select("raw_id", F.explode(F.array_distinct(F.transform("pieces", lambda p: p["label"]))).alias("label")).join(who, "label")
    maps = used.distinct().groupBy("raw_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "speaker_id"))).alias("who"))
    return said.join(maps, "raw_id", "left"), None


def _walked(said: DataFrame, who: dict[str, int] | None, schema: str, walk) -> DataFrame:
    """Each row's pieces through `walk(pieces, who)`, a generator of the values beside raw_id."""
    kind = said.schema["raw_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                keep, out = [], []
                maps = part.column(2).to_pylist() if who is None else None
                for k, mine in enumerate(part.column(1).to_pylist()):
                    for row in walk(mine or [], who if maps is None else dict(maps[k] or ())):
                        keep.append(k)
                        out.append(row)
                cols = zip(*out) if out else [[] for _ in names]
                yield pa.record_batch([part.column(0).take(pa.array(keep, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types))], names=["raw_id", *names])

    names = [f.split()[0] for f in schema.split(", ")]
    types = [{"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[f.split()[1]] for f in schema.split(", ")]
    return said.mapInArrow(run, f"raw_id {kind}, {schema}")


def _starts(mine: list[dict], who: dict[str, int]) -> Iterator[tuple]:
    last, told = None, set()
    for p in mine:
        speaker = who.get(p["label"])
        if speaker is not None and speaker != last:
            last = speaker
            if (p["idx"], speaker) not in told:
                told.add((p["idx"], speaker))
                yield p["idx"], speaker


def _turns(mine: list[dict], who: dict[str, int]) -> Iterator[tuple]:
    speaker, turn, number = None, None, 0
    for p in mine:
        label, words = p["label"], p["words"]
        named_ = who.get(label) if label is not None else None
        if label is not None and named_ is None and not (label[0] in "[(" and _cue(label)):
            words = (f"{label} {words}" if words else label) if label[0] in "[(" else f"{label}: {words}"
        changed = named_ is not None and named_ != speaker
        speaker = named_ if changed else speaker
        if not words and speaker is None:
            continue
        if changed or turn is None:
            if turn is not None:
                yield (*turn[:4], " ".join(turn[4]))
            number += 1
            turn = (number, speaker, p["idx"], p["start_ms"], [])
        if words:
            turn[4].append(words)
    if turn is not None:
        yield (*turn[:4], " ".join(turn[4]))


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "transcripts_raw").select("raw_id", "segments")


def turn_starts(payloads: DataFrame, speakers: DataFrame, most_labels: int = MOST_LABELS) -> DataFrame:
    """(raw_id, segment_index, speaker_id) where a label names another speaker than the one before it, or is the first.

    payloads: (raw_id, segments of text and start); segments are walked by start (null last), equal
    starts by index. Null segments and null texts have no labels; a row is a payload of its own.
    """
    said, who = speakers_of(kept(pieces(payloads, labels_only=True).where("size(pieces) > 0"), "pieces"), speakers, most_labels)
    return _walked(said, who, "segment_index int, speaker_id int", _starts).distinct()


def speaker_turns(payloads: DataFrame, speakers: DataFrame, most_labels: int = MOST_LABELS) -> DataFrame:
    """(raw_id, turn, speaker_id, first_index, start_ms, words): ordered turns with their spoken words.

    Words before the first label form a turn of a null speaker. A label that names nobody is spoken
    text, with its brackets if it stood in some, unless it is a stamp or sound cue. Turns without words are kept if they
    have a speaker. Order, nulls and repeated rows as in `turn_starts`.
    """
    said, who = speakers_of(kept(pieces(payloads), "pieces"), speakers, most_labels)
    return _walked(said, who, "turn int, speaker_id int, first_index int, start_ms bigint, words string", _turns)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return turn_starts(payloads(spark, sf), table(spark, sf, "speakers"))


def p7_turns(spark: SparkSession, sf: str) -> DataFrame:
    return speaker_turns(payloads(spark, sf), table(spark, sf, "speakers"))


QUERIES = {f.__name__: f for f in (p7_found, p7_turns)}
SQL: dict[str, str] = {}
