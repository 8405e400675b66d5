"""Answers computed one row at a time in plain Python, to hold the Spark results against."""

import itertools
import re
import unicodedata
from collections import defaultdict

#: Its own tables, not those of the library: letters of one shape, and words beside a name.
SHAPES = dict(zip("АВСЕНІЈКМОРЅТХУасеіјорѕхуӏԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲν", "ABCEHIJKMOPSTXYaceijopsxyldqwhABEZHIKMNOPTYXocv"))
TITLES = {"professor", "prof", "dr", "doctor", "ta", "mr", "mrs", "ms", "miss", "mx", "sir", "lecturer", "instructor", "teacher", "guest", "assistant", "host", "speaker"}


def look(text: str, fold: bool = False) -> str:
    """One look by the standard library: a character at a time, then composed; case afterwards."""
    out = []
    for ch in text:
        kind, wide = unicodedata.category(ch), unicodedata.decomposition(ch)[:6]
        if kind == "Cf" or kind == "Cc" and not ch.isspace():
            continue
        if kind == "Zs" and ch != "\u3000":
            ch = " "
        elif wide in ("<wide>", "<narro") and ch != "\u3000" or "\ufb00" <= ch <= "\ufb06":
            ch = unicodedata.normalize("NFKC", ch)
            ch = "\u3099" if ch == "\u309b" else ch
        out.append(ch)
    text = "".join(SHAPES.get(ch, ch) for ch in unicodedata.normalize("NFD", "".join(out)))
    text = unicodedata.normalize("NFC", text)
    return unicodedata.normalize("NFC", text.casefold()) if fold else text


def ordered(segments):
    inf = float("inf")
    return sorted(enumerate(segments or []), key=lambda p: (inf if p[1]["start"] is None else p[1]["start"], p[0]))


def p4(transcripts, raws):
    """Rows (tbl, id_a, id_b)."""
    groups = defaultdict(list)
    for i, v, t in transcripts:
        if v is not None and t is not None:
            groups["transcripts", v.strip(), look(t)].append((i, t))
    for i, v, segs in raws:
        if v is not None and segs is not None:
            t = "\n".join(s["text"] for s in segs if s["text"] is not None)
            groups["transcripts_raw", v.strip(), look(t)].append((i, t))
    return {(k[0], min(a, b), max(a, b)) for k, g in groups.items() for a, x in g for b, y in g if a != b and x != y}


def p6(raws):
    """Rows (raw_id, first_index, last_index)."""
    out = set()
    for rid, segs in raws:
        run = None
        for i, s in ordered(segs):
            key = "".join(ch for ch in look(s["text"] or "", True) if unicodedata.category(ch)[0] in "LNM")
            if not any(unicodedata.category(ch)[0] in "LN" for ch in key):
                continue
            if run and run[0] == key:
                run[2], run[3] = i, run[3] + 1
            else:
                if run and run[3] > 1:
                    out.add((rid, run[1], run[2]))
                run = [key, i, i, 1]
        if run and run[3] > 1:
            out.add((rid, run[1], run[2]))
    return out


def _one_off(a: str, b: str) -> bool:
    """Equal, or one letter changed, dropped, added or swapped with its neighbour."""
    if a == b:
        return True
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y or x == y[1:] or x[1:] == y[1:] or len(x) > 1 and len(y) > 1 and x[:2] == y[1::-1] and x[2:] == y[2:]


def speaker_of(label: str, speakers) -> int | None:
    """The one speaker that a label names."""
    words = [w for w in re.split(r"[^\w]+", label.lower()) if w and w not in TITLES and w not in ("um", "uh", "er")]
    words = [w for w in words if not any(_one_off(w, t) for t in TITLES if len(t) > 4)] or words
    group = [w for w in words if _one_off(w, "member") or _one_off(w, "members") or w.isdigit()]
    words = [w for w in words if w not in group]
    found = {}
    for sid, name, role in speakers:
        parts = name.lower().split()
        if not words or len(words) > len(parts) or group and role != "unnamed":
            continue
        for order in itertools.permutations(range(len(parts)), len(words)):
            pairs = [(w, parts[k]) for w, k in zip(words, order)]
            if all(_one_off(w, p) if len(w) > 1 else p[0] == w for w, p in pairs) and any(len(w) > 1 for w, _ in pairs):
                found[sid] = min(found.get(sid, 9), sum(len(w) > 1 and w != p for w, p in pairs))
    best = [s for s, k in found.items() if k == min(found.values())]
    return best[0] if len(best) == 1 else None


def p7(raws, speakers):
    """Rows (raw_id, segment_index, speaker_id): every place that could be a label, by one regular expression."""
    lead = r"(?:(?<=^)|(?<=\n)|(?<=>>)|(?<=[.!?] )|(?<=\d\d )|(?<=\d\d\] )|(?<=\d\d\) )|(?<=[\])>♪] ))\s*"
    rx = re.compile(rf"<v\s+([^<>]+)>|\[([^\[\]]+)\]|\(([^()]+)\)\s*:|{lead}((?:[^\W\d_][\w'-]*[.,]?\s*){{1,4}}\d?)\s*:(?!\d)")
    out, cache = set(), {}
    for rid, segs in raws:
        last = None
        for i, s in ordered(segs):
            for m in rx.finditer(look(s["text"] or "")):
                label = next(g for g in m.groups() if g is not None)
                if label not in cache:
                    cache[label] = speaker_of(label, speakers)
                who = cache[label]
                if who is not None and who != last:
                    out.add((rid, i, who))
                    last = who
    return out

STAMP = re.compile(r"(?<!\w)\d{1,3}:\d\d(:\d\d)?([.,]\d{1,3})?(?!\w)")
CUE = re.compile(r"\[(?=[^\]]*(laugh|applau|music|inaudible|conversation))[^\]\d]{1,40}\]|\((?=[^)]*(laugh|applau|music|conversation))[^)\d]{1,40}\)|<i>music</i>", re.I)


def spoken(text: str) -> list[str]:
    t = STAMP.sub(" ", CUE.sub(" ", look(text, True)))
    words = re.findall(r"(?:[^\W_]|[̀-ͯ])+", t)
    return [w for w in words if w not in ("um", "uh", "er")]


def p9(documents, items, n=12):
    """Rows (doc_id, question_id)."""
    seeds = defaultdict(set)
    for q, question, points in items:
        for p in [question, *(points or [])]:
            w = spoken(p or "")
            for i in range(len(w) - n + 1):
                seeds[tuple(w[i : i + n])].add(q)
    out = set()
    for d, t in documents:
        w = spoken(t or "")
        for i in range(len(w) - n + 1):
            out |= {(d, q) for q in seeds.get(tuple(w[i : i + n]), ())}
    return out


def p1(chunks, limit=240):
    """Rows (chunk_id,)."""
    rx = re.compile(r"[぀-ヿ㐀-鿿]|(?:(?![぀-ヿ㐀-鿿])[^\W])+|\S")
    return {(i,) for i, t in chunks if t is not None and len(rx.findall(t)) > limit}
