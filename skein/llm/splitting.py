"""Cutting oversized texts into overlapping pieces at natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cluster import arrow_map

# Characters that may end a sentence before white space, and without it.
SENTENCE_BEFORE_SPACE = ".?!"
SENTENCE_ALONE = "。！？।؟"
BLANKS = " \t\r\n"


def _codes(chars: str) -> np.ndarray:
    return np.array([ord(c) for c in chars], dtype=np.uint32)


def piece_spans(text: str, limit: int = 1200, least: int = 600, overlap: int = 150, section: str | None = None) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces of ``text``, in code points.

    Boundaries form a hierarchy: section (before a match of the pattern ``section``, if
    there is one), paragraph (after two line feeds), sentence, word, character. A piece takes as much as fits in ``limit`` and ends at the last
    boundary of the highest kind that leaves it longer than ``least``. The next
    piece begins at the first word start among the last ``overlap`` characters of
    the one before, or ``overlap`` characters back where no word starts there.
    A text within the limit is one piece, an empty one none.
    """
    if not 0 <= overlap <= least < limit:
        raise ValueError("0 <= overlap <= least < limit must hold")
    size = len(text)
    if size <= limit:
        return [(0, size)] if size else []
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    blank = np.isin(code, _codes(BLANKS))
    feed = code == 10
    # Each array holds ascending positions e such that a piece may end before e.
    levels = [np.array([m.start() for m in regex.finditer(section, text)], dtype=np.int64)] if section else []
    levels.append(np.flatnonzero(feed[:-1] & feed[1:]) + 2)
    after_mark = np.isin(code[:-1], _codes(SENTENCE_BEFORE_SPACE)) & blank[1:]
    sentence = np.isin(code, _codes(SENTENCE_ALONE))
    sentence[1:] |= after_mark
    levels.append(np.flatnonzero(sentence) + 1)
    levels.append(np.flatnonzero(blank) + 1)
    word_starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1

    spans, start = [], 0
    while size - start > limit:
        end = start + limit
        for ends in levels:
            last = int(np.searchsorted(ends, start + limit, side="right")) - 1
            if last >= 0 and ends[last] > start + least:
                end = int(ends[last])
                break
        spans.append((start, end))
        first = int(np.searchsorted(word_starts, end - overlap))
        start = int(word_starts[first]) if first < len(word_starts) and word_starts[first] < end else end - overlap
    spans.append((start, size))
    return spans


def split_oversized(
    df: DataFrame,
    id_col: str = "document_id",
    text_col: str = "content",
    limit: int = 1200,
    least: int = 600,
    overlap: int = 150,
    only_oversized: bool = True,
    section: str | None = None,
) -> DataFrame:
    """Pieces ``(id_col, start_char, end_char)`` of every text longer than ``limit``.

    ``section`` is a pattern of headings, before which a piece ends first of all; without
    it paragraphs are the highest level. With ``only_oversized=False`` shorter texts come out as one piece. Null and
    empty texts give no piece; a null id is kept as an id. Repeated rows count
    once. Other columns of ``df`` are ignored, whatever their names.
    """
    if overlap >= limit:
        raise ValueError("overlap must be below limit")

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, starts, ends = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a, b in piece_spans(text, limit, least, overlap, section):
                    ids.append(key)
                    starts.append(a)
                    ends.append(b)
            return pa.record_batch([pa.array(ids, batch.schema.field(0).type), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[id_col, "start_char", "end_char"])

        return one

    kind = df.schema[id_col].dataType.simpleString()
    size = F.length(text_col)
    rows = df.select(id_col, text_col).filter(size > (limit if only_oversized else 0))
    return arrow_map(rows, make, f"`{id_col}` {kind}, start_char int, end_char int").distinct()


def pieces(text: str, spans: list[tuple[int, int]]) -> Iterator[str]:
    """The texts of ``spans``."""
    for a, b in spans:
        yield text[a:b]
