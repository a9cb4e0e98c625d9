"""Helpers shared by the operators: hot keys, key runs, batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import release, small, stage

__all__ = ["arrow_map", "hot_keys", "key_runs", "parts_for", "release", "same_keys", "small", "span_hashes", "stage"]


def parts_for(spark: SparkSession, rows: int, each: int) -> int:
    """A number of partitions for work that is heavy on each row, ``each`` rows apiece.

    Given as a number it stays: adaptive execution would merge partitions by their
    bytes, which say little about the work.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int, count_col: str) -> DataFrame:
    """Keys of ``df`` held by more than ``hot_rows`` rows, with their exact counts; ``rows / hot_rows`` at most."""
    return stage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col)).filter(F.col(count_col) > hot_rows))


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], right_keys: list[str] | None = None):
    """A null-safe equality condition over ``keys``."""
    cond = None
    for a, b in zip(keys, right_keys or keys):
        one = left[a].eqNullSafe(right[b])
        cond = one if cond is None else cond & one
    return cond


def key_runs(batches: Iterable[pa.RecordBatch], keys: list[str], least: int = 1) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal ``keys``, from batches sorted by them.

    Whole runs are put together until a table has ``least`` rows; one run and the
    current batch are held at a time beside them.
    """
    held: list[pa.RecordBatch] = []
    held_key, rows = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy() for k in keys]
        changed = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in codes:
            changed |= c[1:] != c[:-1]
        starts = np.concatenate([[0], np.flatnonzero(changed) + 1])
        key_at = lambda i: tuple(batch.column(k)[int(i)].as_py() for k in keys)  # noqa: E731, B023
        if held and key_at(0) == held_key:
            starts = starts[1:]
        at = 0
        for start in starts:  # a run begins at each; what is held ends there
            if rows + start - at >= least:
                held.append(batch.slice(at, int(start) - at))
                yield pa.Table.from_batches([h for h in held if h.num_rows])
                held, rows, at = [], 0, int(start)
        held.append(batch.slice(at))
        rows += batch.num_rows - at
        held_key = key_at(batch.num_rows - 1)
    if rows:
        yield pa.Table.from_batches([h for h in held if h.num_rows])


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """``mapInArrow`` with one function per batch, made once per task."""

    def run(batches):
        one = make()
        for batch in batches:
            out = one(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


# --- hashes of spans -------------------------------------------------------------------

#: Characters that operators on texts put together in one array, unless one text has more.
BLOCK_CHARS = 1_000_000
BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base, and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        both = [np.full(max(n, BLOCK_CHARS), x, np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64))]
        for one in both:
            one[0] = 1
            np.cumprod(one, out=one)
        _POWERS[:] = both
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits spread."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def span_hashes(codes: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of starts and ends that gives 64-bit hashes of those spans of ``codes``, equal for equal spans."""
    power, inverse = _powers(len(codes) + 1)
    upto = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[:-1], out=upto[1:])
    return lambda starts, ends: mixed((upto[ends] - upto[starts]) * inverse[starts])
