"""Keeping the names an operator adds apart from those its input happens to have."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def spared(df: DataFrame, taken: Iterable[str]) -> DataFrame:
    """The table with every column named like one of `taken` (in any case) renamed to <name>_input."""
    taken = {t.lower() for t in taken}
    names = list(df.columns)
    for i, c in enumerate(names):
        while names[i].lower() in taken or names[i] != c and names[i].lower() in {x.lower() for k, x in enumerate(names) if k != i}:
            names[i] += "_input"
    return df if names == df.columns else df.toDF(*names)


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that the table doesn't have yet."""
    have = {c.lower() for c in df.columns}
    while wish.lower() in have:
        wish += "_"
    return wish
