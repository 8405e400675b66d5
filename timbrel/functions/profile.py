"""Counters of what a caption text holds, as Spark columns; Python only where Unicode tables are needed."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timbrel.functions.text import strip

# Signals of program code (code_signals counts them), remarks that fill a whole caption, markup, characters that show nothing.
CODE_SIGNAL = r"(?i)\b(?:def|return|for|while|if|else|elif|class|import|lambda|print)\b|==|!=|<=|>=|\+=|-=|\*=|/="
BRACKET_ONLY = r"\A(?U)\s*\[[^\]]+\]\s*\z"
ROUND_ONLY = r"\A(?U)\s*\([^\)]+\)\s*\z"
TAG = r"<[^>]+>"
ZERO_WIDTH = "[\u200b\u200c\u200d\ufeff]"


@F.pandas_udf(T.BooleanType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.is_normalized("NFC", t))


def is_nfc(c: Column | str) -> Column:
    """Whether the text is in composed form; null for null. Texts of letters below the first mark are, and don't leave the JVM."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.coalesce(_composed(F.when(c.rlike("[^\\x00-\\u02ff]"), c)), F.lit(True)))


@F.pandas_udf(T.BooleanType())
def _unescapes(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else html.unescape(t) != t)


def has_entity(c: Column | str) -> Column:
    """Whether unescaping HTML entities would change the text; null for null. Only texts with an ampersand leave the JVM."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.coalesce(_unescapes(F.when(F.contains(c, F.lit("&")), c)), F.lit(False)))


def edge_blanks(c: Column | str) -> Column:
    """Whether any line of the text begins or ends with white space."""
    lines = F.split(c, r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]")
    return F.exists(lines, lambda x: x != strip(x))


def text_flags(c: Column | str) -> dict[str, Column]:
    """Named counters of one text that isn't blank; each is summed over the texts of a payload."""
    c = F.col(c) if isinstance(c, str) else c
    flag = {
        "edge_whitespace": c != strip(c),
        "multiline": c.rlike(r"[\n\r]"),
        "carriage_return": F.contains(c, F.lit("\r")),
        "tab": F.contains(c, F.lit("\t")),
        "no_break_space": F.contains(c, F.lit("\u00a0")),
        "zero_width": c.rlike(ZERO_WIDTH),
        "replacement_character": F.contains(c, F.lit("\ufffd")),
        "double_space": F.contains(c, F.lit("  ")),
        "line_edge_whitespace": edge_blanks(c),
        "bracket_only": c.rlike(BRACKET_ONLY),
        "round_only": c.rlike(ROUND_ONLY),
        "html_tag": c.rlike(TAG),
    }
    return {k: v.cast("int") for k, v in flag.items()} | {"code_signals": F.regexp_count(c, F.lit(CODE_SIGNAL))}
