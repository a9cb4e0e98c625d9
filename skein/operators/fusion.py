"""Combining two rankings, and comparing several."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ALPHA, POOL, LEAST_POOL, RRF_K = 0.5, 4, 20, 60


def pool_depth(k: int, pool: int = POOL) -> int:
    """How deep both rankings are read for ``k`` results."""
    return max(k * pool, LEAST_POOL)


def minmax(rankings: DataFrame, keys: list[str], score: str = "score", out: str = "normalized") -> DataFrame:
    """``rankings`` with each score's place between the least and most of its ``keys``; 1 where all are equal.

    The bounds are aggregated and joined back, so that a large group isn't brought together.
    """
    bounds = rankings.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min(score).alias("__low"), F.max(score).alias("__high"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    placed = F.when(F.col("__high") == F.col("__low"), F.lit(1.0)).otherwise((F.col(score) - F.col("__low")) / F.nullif(F.col("__high") - F.col("__low"), F.lit(0.0)))
    return rankings.join(bounds, on).select(*[c for c in rankings.columns if c != out], placed.alias(out))


def _ranked(scores: DataFrame, k: int, query_id: str, item: str) -> DataFrame:
    best = Window.partitionBy(query_id).orderBy(F.desc("score"), item)
    return scores.withColumn("rank", F.row_number().over(best)).filter((F.col("rank") <= k) & (F.col("score") > 0)).select(query_id, "rank", item, "score")


def weighted(dense: DataFrame, sparse: DataFrame, k: int = 5, alpha: float = ALPHA, query_id: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """``alpha`` of the dense and the rest of the sparse min-max score; a missing side counts 0.

    Takes the ``k`` best, then only scores above 0.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be between 0 and 1")
    d = minmax(dense, [query_id], out="d").select(query_id, item, "d")
    s = minmax(sparse, [query_id], out="s").select(query_id, item, "s")
    both = d.join(s, [query_id, item], "full_outer")
    score = alpha * F.coalesce("d", F.lit(0.0)) + (1.0 - alpha) * F.coalesce("s", F.lit(0.0))
    return _ranked(both.select(query_id, item, F.round(score, 6).alias("score")), k, query_id, item)


def reciprocal_rank(rankings: list[DataFrame], k: int = 5, query_id: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """The sum of ``1 / (60 + rank)`` over the rankings."""
    rows = rankings[0].select(query_id, item, "rank")
    for other in rankings[1:]:
        rows = rows.unionByName(other.select(query_id, item, "rank"))
    scores = rows.groupBy(query_id, item).agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 6).alias("score"))
    return _ranked(scores, k, query_id, item)


def hybrid(dense: DataFrame, sparse: DataFrame, k: int = 5, alpha: float = ALPHA, fusion: str = "weighted", **names: str) -> DataFrame:
    """Fusion by name: ``weighted`` or ``rrf``."""
    if fusion == "weighted":
        return weighted(dense, sparse, k, alpha, **names)
    if fusion == "rrf":
        return reciprocal_rank([dense, sparse], k, **names)
    raise ValueError(f"unknown fusion {fusion!r}; known: weighted, rrf")


def compare(rankings: dict[str, DataFrame], query_id: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """``query_id, rank`` and a column of items for each ranking, side by side."""
    out = None
    for name, r in rankings.items():
        one = r.select(query_id, "rank", F.col(item).alias(name))
        out = one if out is None else out.join(one, [query_id, "rank"], "full_outer")
    return out
