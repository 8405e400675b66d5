"""Text as numpy code-point arrays: one consistent form, word spans and rolling hashes.

A whole Arrow string column is decoded at once into one array of code points with row offsets. All
work after that is table gathers, prefix sums and sorts over the array; no row is touched by a
string call. The functions run inside Spark's Arrow tasks, on slices of bounded size.

Two forms are offered. ``LOOK`` brings texts that look the same to one form: widths, ligatures,
one-column spaces and look-alike letters are mapped, invisible characters go, accents are ordered
and composed. ``KEY`` also folds case.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

TOP = 0x110000
#: Code points worked on at a time; bounds the memory of a task whatever the batch holds.
SLICE = 1 << 20

# Letters of other alphabets and the Latin letter of the same shape.
LOOKALIKE = {
    # Cyrillic
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ӏ": "I",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    # Armenian
    "Օ": "O", "Ս": "U", "օ": "o", "ս": "u", "հ": "h", "ո": "n",
}

# Spaces one column wide.
SPACES = {0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F}
#: Format characters that a reader does see.
VISIBLE_FORMAT = {0x600, 0x601, 0x602, 0x603, 0x604, 0x605, 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
#: Characters that show nothing though their category doesn't say so.
HIDDEN = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
#: Typographic ligatures and the letter pairs written as one.
LIGATURES = {*range(0xFB00, 0xFB07), *range(0xFB13, 0xFB18), 0x132, 0x133}
#: Control characters that are white space stay.
BLANK_CONTROLS = {9, 10, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 0x85}

WORD, DIGIT, ACCENT = 1, 2, 4


def _expansion(cp: int) -> tuple[int, ...]:
    """What one code point becomes before marks are composed; () if it shows nothing."""
    ch = chr(cp)
    if cp in SPACES:
        return (0x20,)
    if ch in LOOKALIKE:
        return (ord(LOOKALIKE[ch]),)
    kind = unicodedata.category(ch)
    if cp in HIDDEN or kind == "Cf" and cp not in VISIBLE_FORMAT or kind == "Cc" and cp not in BLANK_CONTROLS:
        return ()
    parts = unicodedata.decomposition(ch).split()
    if not parts or 0xAC00 <= cp < 0xD7A4:
        return (cp,)
    if parts[0][0] == "<":
        if parts[0] not in ("<wide>", "<narrow>") and cp not in LIGATURES or cp == 0x3000:  # two columns wide: another space
            return (cp,)
        parts = parts[1:]
    return tuple(x for p in parts for x in _expansion(int(p, 16)))


def _folded(cp: int) -> tuple[int, ...]:
    """One look first, then one case: a small letter follows its own shape, not that of its capital."""
    return tuple(z for x in _expansion(cp) for y in chr(x).casefold() for z in _expansion(ord(y)))


class Form:
    """Lookup tables of one consistent form; about 25 MB, built once in a worker."""

    def __init__(self, fold_case: bool) -> None:
        rule = _folded if fold_case else _expansion
        slot = np.zeros(TOP, np.int32)
        seqs: list[tuple[int, ...]] = [(), ()]  # slot 0: stays; slot 1: goes
        known: dict[tuple[int, ...], int] = {(): 1}
        for cp in range(TOP):
            if 0xD800 <= cp < 0xE000 or 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7A4 or 0x20000 <= cp < 0xE0000 and not 0x2F800 <= cp < 0x2FA20 or cp > 0xE1000:
                continue
            seq = rule(cp)
            if seq != (cp,):
                k = known.setdefault(seq, len(seqs))
                if k == len(seqs):
                    seqs.append(seq)
                slot[cp] = k
        self.slot = slot
        self.length = np.array([1, *map(len, seqs[1:])], np.int32)
        self.start = np.concatenate([[0], np.cumsum([len(s) for s in seqs])[:-1]]).astype(np.int32)
        self.data = np.array([x for s in seqs for x in s], np.uint32)
        _, self.rank, _ = marks()
        self.busy = (slot > 0) | (self.rank > 0)
        self.busy[0x1161:0x11C3] = True  # Hangul vowels and finals

    def apply(self, cps: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points and row offsets (one more than rows) to the same in this form."""
        if not len(cps) or not self.busy[cps].any():
            return cps, rows
        slot = self.slot[cps]
        length = self.length[slot]
        at = np.zeros(len(cps) + 1, np.int64)
        np.cumsum(length, out=at[1:])
        out, rows = np.repeat(cps, length), at[rows]
        grown = np.flatnonzero(slot > 1)
        if len(grown):
            n = length[grown]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(at[grown], n) + inside] = self.data[np.repeat(self.start[slot[grown]], n) + inside]
        return compose(self._ordered(out, rows), rows)

    def _ordered(self, cps: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Marks on one letter in canonical order."""
        rank = self.rank[cps]
        m = np.flatnonzero(rank)
        if len(m) < 2 or not ((np.diff(m) == 1) & (rank[m[1:]] < rank[m[:-1]])).any():
            return cps
        first = np.concatenate([[True], np.diff(m) > 1])
        inner = rows[1:-1]
        first |= np.isin(m, inner)  # marks of another row belong to no letter of this one
        order = np.lexsort((rank[m], np.cumsum(first)))
        cps = cps.copy()
        cps[m] = cps[m][order]
        return cps


@cache
def marks() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (letter, mark) keys with their composites, and each code point's combining class."""
    rank = np.zeros(TOP, np.uint8)
    pairs = {}
    for cp in range(0x2FA20):
        if 0xD800 <= cp < 0xE000 or 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7A4:
            continue
        ch = chr(cp)
        rank[cp] = unicodedata.combining(ch)
        d = unicodedata.decomposition(ch).split()
        if len(d) == 2 and d[0][0] != "<" and unicodedata.normalize("NFC", ch) == ch:
            pairs[int(d[0], 16) << 21 | int(d[1], 16)] = cp
    keys = np.array(sorted(pairs), np.int64)
    return np.stack([keys, np.array([pairs[int(k)] for k in keys], np.int64)]), rank, keys


def compose(cps: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join letters and their marks where a composed letter exists, a mark of every letter at a time."""
    table, rank_of, keys = marks()
    cps, keep = cps.copy(), np.ones(len(cps), bool)
    rank = rank_of[cps]
    m = np.flatnonzero(rank)
    if len(m):
        starter = np.where(rank == 0, np.arange(len(cps)), -1)
        np.maximum.accumulate(starter, out=starter)
        s = starter[m]
        row_first = rows[np.searchsorted(rows, m, "right") - 1]
        ok = s >= row_first
        m, s = m[ok], s[ok]
        if len(m):
            first = np.concatenate([[True], s[1:] != s[:-1]])
            group = np.flatnonzero(first)
            turn = np.arange(len(m)) - np.repeat(group, np.diff(np.append(group, len(m))))
            blocked = np.zeros(len(cps), np.uint8)  # by starter: class of the last mark that stayed
            order = np.argsort(turn, kind="stable")
            ends = np.searchsorted(turn[order], np.arange(turn.max() + 2))
            for k in range(turn.max() + 1):
                now = order[ends[k] : ends[k + 1]]
                p, q = s[now], m[now]
                key = cps[p].astype(np.int64) << 21 | cps[q]
                i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = (keys[i] == key) & (blocked[p] < rank[q])
                cps[p[hit]] = table[1][i[hit]]
                keep[q[hit]] = False
                blocked[p[~hit]] = rank[q[~hit]]
    # Hangul: consonant and vowel, then a final
    vowels = np.flatnonzero((cps >= 0x1161) & (cps < 0x1176) & keep)
    if len(vowels):
        fresh = np.zeros(len(cps), bool)
        fresh[rows[:-1][rows[:-1] < len(cps)]] = True
        v = vowels[(vowels > 0) & ~fresh[vowels]]
        v = v[(cps[v - 1] >= 0x1100) & (cps[v - 1] < 0x1113)]
        cps[v - 1] = 0xAC00 + ((cps[v - 1] - 0x1100) * 21 + (cps[v] - 0x1161)) * 28
        keep[v] = False
        f = v[v + 1 < len(cps)] + 1
        f = f[(cps[f] > 0x11A7) & (cps[f] < 0x11C3) & ~fresh[f]]
        cps[f - 2] += cps[f] - 0x11A7
        keep[f] = False
    if keep.all():
        return cps, rows
    at = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return cps[keep], at[rows]


@cache
def form(fold_case: bool = False) -> Form:
    return Form(fold_case)


@cache
def classes() -> np.ndarray:
    """WORD for letters, digits and marks, with DIGIT or ACCENT beside it where it is one."""
    out = np.zeros(TOP, np.uint8)
    bits = {"L": WORD, "N": WORD | DIGIT, "M": WORD | ACCENT}
    for cp in range(0x323B0):
        out[cp] = bits.get(unicodedata.category(chr(cp))[0], 0)
    return out


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, code points, row offsets), whole rows, null as empty; about `most` bytes each."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = memoryview(b"") if data is None else memoryview(data)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        raw = bytes(data[offsets[i] : offsets[j]])
        cps = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        at = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(lead, out=at[1:])
        yield i, j, cps, at[offsets[i : j + 1] - offsets[i]]
        i = j


def encoded(cps: np.ndarray, rows: np.ndarray) -> pa.Array:
    """Code points and row offsets as an Arrow string column."""
    width = 1 + (cps > 0x7F).astype(np.int64) + (cps > 0x7FF) + (cps > 0xFFFF)
    at = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(width, out=at[1:])
    data = np.ascontiguousarray(cps, np.uint32).tobytes().decode("utf-32-le").encode("utf-8")
    return pa.Array.from_buffers(pa.large_string(), len(rows) - 1, [None, pa.py_buffer(np.ascontiguousarray(at[rows])), pa.py_buffer(data)])


def consistent(column: pa.Array, fold_case: bool = False) -> pa.Array:
    """A string column in its consistent form; null stays null."""
    parts = [encoded(*form(fold_case).apply(cps, rows)) for _, _, cps, rows in slices(column)]
    out = pa.concat_arrays(parts) if parts else pa.array([], pa.large_string())
    if column.null_count:
        import pyarrow.compute as pc

        out = pc.if_else(pc.is_valid(column), out, pa.scalar(None, pa.large_string()))
    return out.cast(pa.string())


# --- words and rolling hashes -------------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + _ODD
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@cache
def _mixed_classes() -> np.ndarray:
    return mix(np.arange(TOP, dtype=np.uint64))


@cache
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n."""
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


_BASE = 0xD1342543DE82EF95


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Karp-Rabin hash of values[start:end] for each span, from one prefix sum of values * base**i."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = 1 << max(10, int(len(values) + 1).bit_length())
    up, down = _powers(_BASE, n)
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts])


def words(cps: np.ndarray, rows: np.ndarray, alone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of letters, digits and marks within a row: (row, start, end, 64-bit hash). Characters marked as `alone` are words of their own."""
    inside = (classes()[cps] & WORD) > 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    cutting = np.zeros(len(cps) + 1, bool)
    cutting[rows] = True
    begins, stops = edge > 0, edge < 0
    both = np.zeros(len(cps) + 1, bool)  # a row ends and the next begins within letters
    both[1:-1] = inside[1:] & inside[:-1] & (cutting[1:-1] if alone is None else cutting[1:-1] | alone[1:] | alone[:-1])
    starts, ends = np.flatnonzero(begins | both), np.flatnonzero(stops | both)
    row = np.searchsorted(rows, starts, "right") - 1
    return row, starts, ends, span_hashes(_mixed_classes()[cps], starts, ends)


def word_hash(word: str) -> int:
    """The hash that words() gives this word (after case folding)."""
    cps = np.frombuffer(word.encode("utf-32-le"), np.uint32)
    cps, _ = form(True).apply(cps, np.array([0, len(cps)]))
    return int(span_hashes(_mixed_classes()[cps], np.array([0]), np.array([len(cps)]))[0])
