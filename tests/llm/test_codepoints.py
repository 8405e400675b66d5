"""The vectorised consistent form against one string at a time."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from timbrel.llm import codepoints as C


def plain(text: str, fold: bool) -> str:
    """The same form by string calls."""
    rule = C._folded if fold else C._expansion
    out = "".join(chr(y) for ch in text for y in rule(ord(ch)))
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", out))


POOL = "aeoAEOnuçéïAbcxyz 12.,:[]()<>\n\tабвгдеорсухіѕјАВЕКМНОРСТУХйЙёΑΒΕΖΗΙΚΜΝΟΡΤΥΧοｆｕｌＬ１２：ﬁﬃﬀßẞ   　​‌‍⁠﻿­‎̧̛̣́̈̃̂̆̉ơưếộỗカタｶﾞﾊﾟｯｰ゙゚한국ㄱ한𝒜😀²½"


@pytest.mark.parametrize("fold", [False, True])
def test_random_strings(fold):
    rnd = random.Random(5)
    texts = ["", None, "plain ascii", "á", "́a", "ﬁ", "ệ", "ệ", "й", "ё", "ớ", "́́á́̈"]
    texts += ["".join(rnd.choice(POOL) for _ in range(rnd.randrange(0, 40))) for _ in range(4000)]
    got = C.consistent(pa.array(texts), fold).to_pylist()
    for t, g in zip(texts, got):
        assert g == (None if t is None else plain(t, fold)), (t, g)


def test_sliced_column_and_small_slices():
    texts = pa.array(["x" * 50, "ёté", None, "", "ｆ" * 70] * 30)
    whole = C.consistent(texts).to_pylist()
    assert C.consistent(texts.slice(7, 60)).to_pylist() == whole[7:67]
    seen = [(i, j) for i, j, _, _ in C.slices(texts, 64)]
    assert seen[0][0] == 0 and seen[-1][1] == len(texts) and all(a[1] == b[0] for a, b in zip(seen, seen[1:]))


def test_same_look_and_visible_differences():
    def c(x):
        return C.consistent(pa.array([x])).to_pylist()[0]

    assert c("Сафе́") == c("Caфé") and c("ｆｉｎｅ") == c("ﬁne") == "fine"
    assert c("a b") == c("a b") == c("a​ b")
    for a, b in (("Cafe", "Café"), ("a b", "ab"), ("a", "A"), ("a　b", "a b"), ("x²", "x2"), ("a.", "a"), ("a\nb", "a b")):
        assert c(a) != c(b)


def test_keys_fold_case_across_look_alikes():
    def k(x):
        return C.consistent(pa.array([x]), True).to_pylist()[0]

    assert k("ВОДА") == k("BОДA") and k("М") == k("m") != k("м") and k("Straße") == k("STRASSE")


def test_words_and_hashes():
    text = ["Ab cd", "cd́ x_1", "", "end", "joined"]
    _, _, cps, rows = next(C.slices(pa.array(text)))
    row, s, e, h = C.words(cps, rows)
    spans = [(int(r), "".join(map(chr, cps[a:b]))) for r, a, b in zip(row, s, e)]
    assert spans == [(0, "Ab"), (0, "cd"), (1, "cd́"), (1, "x"), (1, "1"), (3, "end"), (4, "joined")]
    assert h[5] == C.word_hash("end") and len(set(h.tolist())) == 7
    vals = C.mix(np.arange(100, dtype=np.uint64) % np.uint64(7))
    a = C.span_hashes(vals, np.array([0, 7, 50]), np.array([20, 27, 64]))
    assert a[0] == a[1] != a[2]
