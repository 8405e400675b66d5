"""Public tokenizers inside Spark tasks. Their files' folder is a parameter and never copied."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from timbrel.functions.naming import spared
from timbrel.session import ship

#: Folder with the vocabulary files, the same on every machine.
FOLDER = "/opt/tokenizers"
DEFAULT = "byte_bpe_50k.tiktoken"
#: How the byte-level files split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoder(path: str):
    """A function from text to its number of tokens."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda text: len(encode(text))
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def fingerprint(name: str = DEFAULT, folder: str = FOLDER) -> str:
    """Hash of a tokenizer's file: counts made with another vocabulary are other counts."""
    with open(os.path.join(folder, name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:16]


def with_token_count(df: DataFrame, text: str, name: str = DEFAULT, folder: str = FOLDER, keep_text: bool = False) -> DataFrame:
    """The table with `tokens` (bigint) in place of the text column; null for a null text, 0 for an empty one.

    A column already named tokens comes out as tokens_input.
    """
    df = spared(df, {"tokens"} - {text})
    at, path = df.columns.index(text), os.path.join(folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path)
        for b in batches:
            n = pa.array([None if t is None else count(t) for t in _strings(b.column(at))], pa.int64())
            rest = b if keep_text else b.remove_column(at)
            yield rest.append_column("tokens", n)

    ship(df.sparkSession)
    return df.mapInArrow(run, T.StructType([*(f for f in df.schema if keep_text or f.name != text), T.StructField("tokens", T.LongType())]))


def _strings(column: pa.Array) -> Iterator[str | None]:
    """A column's strings, few at a time."""
    for i in range(0, len(column), 64):
        yield from pc.cast(column.slice(i, 64), pa.string()).to_pylist()
