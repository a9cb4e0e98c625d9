"""The offline tokenizer: pieces that tile a text, countable in the JVM."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: A piece is a run of non-blanks with the blanks before it; blanks at the end are one piece.
PIECE = "[ \t\r\n\f]*[^ \t\r\n\f]+|[ \t\r\n\f]+"
_PIECE = re.compile(PIECE)


def token_pieces(text: Column) -> Column:
    """The pieces of ``text``; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(PIECE), 0)


def count_tokens(text: Column) -> Column:
    """Number of pieces."""
    return F.regexp_count(text, F.lit(PIECE))


def py_token_starts(text: str) -> list[int]:
    """Start of every piece, and the length of the text at the end."""
    return [m.start() for m in _PIECE.finditer(text)] + [len(text)]


def count_pieces(text: str) -> int:
    """Number of pieces."""
    return len(_PIECE.findall(text))


@F.pandas_udf(ArrayType(IntegerType()))
def token_starts(texts: pd.Series) -> pd.Series:
    """Start of every piece, and the length of the text at the end. Linear, unlike a fold over arrays."""
    return texts.map(lambda t: None if t is None else py_token_starts(t))


def resolve_overlap(overlap: int | str, size: int) -> int:
    """An overlap in tokens from a number or a percentage of ``size``."""
    if isinstance(overlap, str) and overlap.endswith("%"):
        value = int(size * float(overlap[:-1]) / 100)
    else:
        value = int(overlap)
    if not 0 <= value < size:
        raise ValueError(f"overlap {overlap!r} must be at least 0 and below the size {size}")
    return value
