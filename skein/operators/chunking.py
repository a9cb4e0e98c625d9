"""Chunkers: documents to spans to chunks.

A chunker is a column of spans ``ARRAY<STRUCT<start, end, num_tokens, num_sentences>>``
over ``content``, made document by document in Arrow batches: token offsets are a
running sum, which arrays of the JVM could only copy at every step.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import count_pieces, count_tokens, py_token_starts, resolve_overlap
from ..functions.vectors import dot, unit
from ..schema import SPANS, chunk_key
from .pages import page_of

# Sizes that turn a number of sentences into tokens.
WORDS_PER_SENTENCE, LEAST_WORDS, TOKENS_PER_WORD, MARGIN = 35, 15, 1.3, 1.2
SEPARATORS = ("\n\n", "\n", ". ", " ")
SENTENCE = "[^.!?\n]*[.!?\n]+[\"'’”)\\]]*[ \t\r\n\f]*|[^.!?\n]+"
_SENTENCE = re.compile(SENTENCE)


def sentence_cap(sentences: int) -> int:
    """Most tokens of a chunk of so many sentences."""
    return int(sentences * WORDS_PER_SENTENCE * TOKENS_PER_WORD * MARGIN)


def sentence_floor(sentences: int) -> int:
    """Least tokens of such a chunk where a floor is asked for."""
    return int(sentences * LEAST_WORDS * TOKENS_PER_WORD)


# --- fixed windows -------------------------------------------------------------------


def _span_udf(make: Callable[[str], list[tuple]]) -> Callable[[Column], Column]:
    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        names = ("start", "end", "num_tokens", "num_sentences")
        return texts.map(lambda t: None if t is None else [dict(zip(names, s)) for s in make(t)])

    return spans


def window_spans(text: str, size: int, step: int) -> list[tuple]:
    """Windows of ``size`` tokens every ``step`` tokens; the last one ends with the text."""
    starts = py_token_starts(text)
    n = len(starts) - 1
    count = -(-max(n - size, 0) // step) + 1 if n else 0
    return [(starts[i * step], starts[min(i * step + size, n)], min(i * step + size, n) - i * step, None) for i in range(count)]


def fixed_size(content: Column, chunk_size: int = 512, overlap: int | str = 128) -> Column:
    """Windows of ``chunk_size`` tokens, each ``overlap`` tokens into the one before."""
    step = chunk_size - resolve_overlap(overlap, chunk_size)
    return _span_udf(lambda t: window_spans(t, chunk_size, step))(content)


def sliding_window(content: Column, window_size: int = 512, overlap_ratio: float = 0.5) -> Column:
    """``fixed_size`` with its overlap as a share of the window."""
    if not 0 <= overlap_ratio < 1:
        raise ValueError("overlap_ratio must be at least 0 and below 1")
    return fixed_size(content, window_size, int(window_size * overlap_ratio))


# --- sentences -----------------------------------------------------------------------


def sentence_pieces(text: Column) -> Column:
    """Sentences that tile ``text``: they end at ``.!?`` or a line end, closing quotes and blanks included."""
    return F.regexp_extract_all(text, F.lit(SENTENCE), 0)


def sentence_list(text: str, cap: int | None = None) -> list[tuple[int, int, int]]:
    """``(start, end, tokens)`` of the sentences that aren't blank, cut where longer than ``cap`` tokens."""
    out = []
    for m in _SENTENCE.finditer(text):
        if not m.group().strip():
            continue
        starts = py_token_starts(m.group())
        n = len(starts) - 1
        step = cap or max(n, 1)
        for i in range(0, n, step):
            j = min(i + step, n)
            if starts[j] > starts[i]:
                out.append((m.start() + starts[i], m.start() + starts[j], j - i))
    return out


def _upto(sizes: list[int]) -> np.ndarray:
    """Tokens before each position, and all of them at the end."""
    return np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))])


def _follow(last: np.ndarray, following: np.ndarray) -> list[tuple[int, int]]:
    """The runs ``[first, last)`` met from position 0 on, by tables of where each ends and what comes next."""
    runs, at, n = [], 0, len(last)
    while at < n:
        runs.append((at, int(last[at])))
        at = n if last[at] == n else int(following[at])
    return runs


def group_sentences(sentences: list[tuple[int, int, int]], count: int, overlap: int, cap: int, floor: int | None) -> list[tuple]:
    """Groups of ``count`` sentences, or as many as reach ``floor`` tokens, that stay within ``cap`` tokens.

    A sentence over the cap is a group of its own. ``overlap`` sentences are repeated
    where the group has more. Where a group would end is found for every sentence at
    once from the running sum of tokens.
    """
    n = len(sentences)
    upto, first = _upto([size for _, _, size in sentences]), np.arange(n)
    full = np.maximum(np.searchsorted(upto, upto[:-1] + cap, side="right") - 1, first + 1)
    enough = first + count
    if floor is not None:
        enough = np.maximum(enough, np.searchsorted(upto, upto[:-1] + floor, side="left"))
    last = np.minimum(np.minimum(full, enough), n)
    runs = _follow(last, np.maximum(last - overlap, first + 1))
    return [(sentences[a][0], sentences[b - 1][1], int(upto[b] - upto[a]), b - a) for a, b in runs]


def sentence(content: Column, sentences_per_chunk: int = 5, overlap: int = 1, dynamic_min: bool = False) -> Column:
    """Whole sentences, ``sentences_per_chunk`` at a time, under a cap of tokens."""
    if sentences_per_chunk < 1 or not 0 <= overlap < sentences_per_chunk:
        raise ValueError("overlap must be at least 0 and below sentences_per_chunk, which must be at least 1")
    cap = sentence_cap(sentences_per_chunk)
    floor = sentence_floor(sentences_per_chunk) if dynamic_min else None
    return _span_udf(lambda t: group_sentences(sentence_list(t, cap), sentences_per_chunk, overlap, cap, floor))(content)


# --- recursive -----------------------------------------------------------------------


def _tokens_between(text: str, cuts: np.ndarray) -> np.ndarray:
    return np.array([count_pieces(text[a:b]) for a, b in zip(cuts, cuts[1:])], dtype=np.int64)


def atom_cuts(text: str, size: int, separators: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Positions that cut ``text`` into atoms of ``size`` tokens at most, and the tokens of each.

    One separator after the other cuts the parts that are still too large behind each
    of its occurrences; what no separator makes small enough is cut by tokens.
    """
    cuts = np.array([0, len(text)] if text else [0])
    tokens = _tokens_between(text, cuts)
    for separator in separators:
        if not (tokens > size).any():
            return cuts, tokens
        ends = np.array([m.end() for m in re.finditer(re.escape(separator), text)], dtype=np.int64)
        part = np.searchsorted(cuts, ends - len(separator), side="right") - 1
        ends = ends[(tokens[part] > size) & (ends <= cuts[part + 1])]
        fresh = np.union1d(cuts, ends)
        if len(fresh) > len(cuts):
            cuts, tokens = fresh, _tokens_between(text, fresh)
    more = [cuts]
    for i in np.flatnonzero(tokens > size):
        more.append(cuts[i] + np.array(py_token_starts(text[cuts[i] : cuts[i + 1]])[size:-1:size]))
    if len(more) > 1:
        cuts = np.union1d(cuts, np.concatenate(more[1:])).astype(np.int64)
        tokens = _tokens_between(text, cuts)
    return cuts, tokens


def recursive_spans(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[tuple]:
    """As many atoms at a time as ``size`` tokens hold; whole atoms of ``overlap`` tokens at most are repeated."""
    cuts, tokens = atom_cuts(text, size, separators)
    upto, first = _upto(tokens), np.arange(len(tokens))
    last = np.maximum(np.searchsorted(upto, upto[:-1] + size, side="right") - 1, first + 1)
    back = np.searchsorted(upto, upto[last] - overlap, side="left")
    return [(int(cuts[a]), int(cuts[b]), int(upto[b] - upto[a]), None) for a, b in _follow(last, np.maximum(back, first + 1))]


def recursive(content: Column, chunk_size: int = 512, overlap: int | str = 64, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """Splits at paragraphs, lines, sentences, words, then tokens, and packs the pieces."""
    budget = resolve_overlap(overlap, chunk_size)
    return _span_udf(lambda t: recursive_spans(t, chunk_size, budget, tuple(separators)))(content)


# --- semantic ------------------------------------------------------------------------


def seam_groups(sentences: list[tuple[int, int, int]], distances: list[float], threshold: float | None, cap: int) -> list[tuple]:
    """Sentences between seams, which are distances of ``threshold`` or more, in runs of ``cap`` tokens at most."""
    n = len(sentences)
    upto, first = _upto([size for _, _, size in sentences]), np.arange(n)
    seams = np.flatnonzero(np.asarray(distances[: max(n - 1, 0)]) >= threshold) + 1 if threshold is not None else np.empty(0, np.int64)
    stops = np.append(seams, n)
    last = np.minimum(stops[np.searchsorted(stops, first, side="right")], np.maximum(np.searchsorted(upto, upto[:-1] + cap, side="right") - 1, first + 1)) if n else first
    return [(sentences[a][0], sentences[b - 1][1], int(upto[b] - upto[a]), b - a) for a, b in _follow(last, last)]


def seam_threshold(distances: list[float], percentile: float) -> float | None:
    """The linear percentile; None without spread."""
    if not len(distances) or max(distances) == min(distances):
        return None
    return float(np.percentile(distances, percentile))


def semantic(content: Column, max_tokens: int = 512, breakpoint_percentile: float = 90.0, *, embedder: Callable[[list[str]], np.ndarray]) -> Column:
    """Closes a chunk where the vectors of adjacent sentences are farthest apart in the document.

    Distances are rounded to 9 decimals, so that equal ones are equal on any machine.
    """
    if not 0 < breakpoint_percentile < 100:
        raise ValueError("breakpoint_percentile must be above 0 and below 100")

    def spans(text: str) -> list[tuple]:
        parts = sentence_list(text, max_tokens)
        if not parts:
            return []
        v = np.asarray(embedder([text[a:b] for a, b, _ in parts]), dtype=np.float64)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
        gaps = list(np.round(1.0 - np.clip((v[:-1] * v[1:]).sum(axis=1), -1.0, 1.0), 9))
        return seam_groups(parts, gaps, seam_threshold(gaps, breakpoint_percentile), max_tokens)

    return _span_udf(spans)(content)


def adjacent_distances(rows: DataFrame, doc: str, pos: str, vector: str) -> DataFrame:
    """``doc, pos, distance`` of each row to the next of its document, in vector space."""
    ahead = F.lead("__u").over(Window.partitionBy(doc).orderBy(pos))
    pairs = rows.select(doc, pos, unit(F.col(vector)).alias("__u")).withColumn("__n", ahead).filter("__n is not null")
    return pairs.select(doc, pos, (1.0 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("__u"), F.col("__n"))))).alias("distance"))


# --- spans to chunks -----------------------------------------------------------------


def explode_spans(documents: DataFrame, spans: Column, spec: str, embedder: str | None = None) -> DataFrame:
    """Chunks of ``documents``, one row for each span that isn't blank, in the schema ``CHUNKS``."""
    body = lambda s: F.substring(F.col("content"), s["start"] + 1, s["end"] - s["start"])
    kept = documents.withColumn("__spans", spans).withColumn("__spans", F.filter("__spans", lambda s: body(s).rlike(r"(?U)\S")))
    flat = kept.select("*", F.posexplode("__spans").alias("chunk_index", "__s"))
    start, end = F.col("__s.start"), F.col("__s.end")
    return flat.select(
        chunk_key(F.col("document_id"), F.lit(spec), F.col("chunk_index")).alias("chunk_id"),
        "document_id", "paper_id", "source", "chunk_index", start.alias("start_char"), end.alias("end_char"),
        page_of(F.col("page_starts"), start).alias("page_number"),
        page_of(F.col("page_starts"), F.greatest(end - 1, start)).alias("end_page"),
        (end - start).alias("num_chars"), F.col("__s.num_tokens").alias("num_tokens"), F.col("__s.num_sentences").alias("num_sentences"),
        F.array().cast("array<int>").alias("section_indices"),
        body(F.col("__s")).alias("content"), F.lit(spec).alias("chunker"), F.lit(embedder).cast("string").alias("embedder"),
    )


@dataclass(frozen=True)
class ChunkerSpec:
    """A chunker by name, its arguments, and whether vectors enter."""

    function: Callable[..., Column]
    parameters: tuple[tuple[str, Any], ...]
    needs_embedder: bool = False


CHUNKERS: dict[str, ChunkerSpec] = {
    "fixed_size": ChunkerSpec(fixed_size, (("chunk_size", 512), ("overlap", "128"))),
    "sliding_window": ChunkerSpec(sliding_window, (("window_size", 512), ("overlap_ratio", 0.5))),
    "sentence": ChunkerSpec(sentence, (("sentences_per_chunk", 5), ("overlap", 1), ("dynamic_min", False))),
    "recursive": ChunkerSpec(recursive, (("chunk_size", 512), ("overlap", "64"))),
    "semantic": ChunkerSpec(semantic, (("max_tokens", 512), ("breakpoint_percentile", 90.0)), True),
}


# Words that switch an option on.
SWITCHED_ON = {"1", "true", "yes", "on"}


def _coerce(text: str, like: Any) -> Any:
    return text.strip().lower() in SWITCHED_ON if isinstance(like, bool) else type(like)(text)


def parse_chunker(spec: str) -> tuple[ChunkerSpec, dict[str, Any]]:
    """``name:arg:arg`` as a chunker and its arguments; what isn't given has its default."""
    name, *args = spec.split(":")
    if name not in CHUNKERS:
        raise ValueError(f"unknown chunker {name!r}; known: {', '.join(CHUNKERS)}")
    chunker = CHUNKERS[name]
    if len(args) > len(chunker.parameters):
        raise ValueError(f"{spec!r}: {name} takes at most {len(chunker.parameters)} arguments")
    given = {k: _coerce(a, v) for (k, v), a in zip(chunker.parameters, args) if a}
    return chunker, {**dict(chunker.parameters), **given}


def chunk_documents(documents: DataFrame, spec: str = "fixed_size", embedder: Callable | None = None, embedder_name: str | None = None) -> DataFrame:
    """Chunks of ``documents`` by a chunker spec. Null contents give none."""
    chunker, arguments = parse_chunker(spec)
    if chunker.needs_embedder:
        if embedder is None:
            raise ValueError(f"{spec!r} needs an embedder")
        arguments["embedder"] = embedder
    spans = chunker.function(F.col("content"), **arguments)
    return explode_spans(documents.filter("content is not null"), spans, spec, embedder_name if chunker.needs_embedder else None)


# --- checks and summaries ------------------------------------------------------------


def verify_offsets(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: chunks, and those that differ from their document's slice or have no document."""
    docs = documents.select("document_id", F.col("content").alias("whole")).dropDuplicates(["document_id"])
    found = chunks.join(docs, "document_id", "left")
    same = F.substring("whole", F.col("start_char") + 1, F.col("end_char") - F.col("start_char")) == F.col("content")
    return found.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(~F.coalesce(same, F.lit(False))).alias("broken"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """``document_id, chunks, mean_tokens``."""
    return chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.avg("num_tokens").alias("mean_tokens"))


def chunk_summary(chunks: DataFrame, key: str = "chunker") -> DataFrame:
    """Count, least, upper-median, most and mean tokens, and mean characters, for each ``key``.

    The upper median is the element at ``n / 2`` of the sorted tokens; nulls don't count.
    """
    counted = chunks.filter("num_tokens is not null")
    # Distinct token counts are few: the order statistic comes from their frequencies.
    freq = counted.groupBy(key, "num_tokens").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(key).orderBy("num_tokens"))
    whole = F.sum("c").over(Window.partitionBy(key))
    middle = freq.withColumn("upto", upto).withColumn("whole", whole).filter(F.col("upto") > F.floor(F.col("whole") / 2))
    p50 = middle.groupBy(key).agg(F.min("num_tokens").alias("p50_tokens"))
    stats = counted.groupBy(key).agg(F.count(F.lit(1)).alias("chunks"), F.min("num_tokens").alias("min_tokens"), F.max("num_tokens").alias("max_tokens"), F.avg("num_tokens").alias("mean_tokens"), F.avg("num_chars").alias("mean_chars"))
    return stats.join(p50, key)


def token_totals(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, tokens`` by the offline tokenizer."""
    return rows.select(key, F.coalesce(count_tokens(F.col(text)), F.lit(0)).alias("tokens"))
