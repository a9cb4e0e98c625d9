"""Second-stage ranking by pairwise scores."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lexical_terms
from ..functions.vectors import sigmoid
from ..registry import Registry

#: Candidates fetched for each result kept.
DEPTH_FACTOR = 4


def rerank_depth(k: int, depth: int | None = None) -> int:
    """First-stage results to fetch for ``k`` reranked ones."""
    return max(k, depth or DEPTH_FACTOR * k)


def lexical_overlap(query: Column, content: Column) -> Column:
    """The offline pair score: distinct query terms found in the content, less half the rest."""
    q = F.array_distinct(lexical_terms(query))
    hit = F.size(F.array_intersect(q, lexical_terms(content)))
    return hit - (F.size(q) - hit) * 0.5


def model_scorer(model: Callable[[list[str], list[str]], list[float]]) -> Callable[[Column, Column], Column]:
    """A pair scorer from a model of ``(queries, contents) -> logits``, in Arrow batches."""

    @F.pandas_udf("double")
    def score(queries: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series(model(queries.tolist(), contents.tolist()), dtype="float64")

    return score


def patient(call: Callable, limited: Callable[[Exception], bool], wait: float = 60.0, tries: int = 5) -> Callable:
    """``call``, tried again ``wait`` seconds after an error that says the rate is ``limited``; other errors pass."""

    def ask(*args):
        import time

        for _ in range(tries - 1):
            try:
                return call(*args)
            except Exception as e:
                if not limited(e):
                    raise
                time.sleep(wait)
        return call(*args)

    return ask


def hosted_scorer(service: Callable[[str, list[str]], list[float]], limited: Callable[[Exception], bool] = lambda e: "429" in str(e), wait: float = 60.0, tries: int = 5) -> Callable[[Column, Column], Column]:
    """A pair scorer from a service of ``(query, contents) -> scores``, asked once for the contents of a query in a batch."""
    ask = patient(service, limited, wait, tries)

    def score(queries: list[str], contents: list[str]) -> list[float]:
        out = [0.0] * len(queries)
        for q in dict.fromkeys(queries):
            at = [i for i, x in enumerate(queries) if x == q]
            for i, s in zip(at, ask(q, [contents[i] for i in at])):
                out[i] = s
        return out

    return model_scorer(score)


SCORERS: Registry = Registry("reranker", {"overlap": lexical_overlap})


def get_scorer(spec: str) -> Callable[[Column, Column], Column]:
    """A scorer by ``name`` or ``name:model``; a model's factory is registered by the user and gets what follows the name."""
    name, colon, model = spec.partition(":")
    scorer = SCORERS.named(name)
    return scorer(model) if colon else scorer


def rerank(rankings: DataFrame, queries: DataFrame, chunks: DataFrame, k: int | None = None, scorer: Callable[[Column, Column], Column] = lexical_overlap) -> DataFrame:
    """``rankings`` scored anew by the sigmoid of a pair score, ordered by it and cut to ``k``.

    ``original_rank`` keeps the first rank an item ever had. Ties keep the order
    before. ``k`` of 0 or None keeps all. A query or chunk without text scores 0.
    """
    base = rankings if "original_rank" in rankings.columns else rankings.withColumn("original_rank", F.lit(None).cast("int"))
    texts = chunks.select("chunk_id", "content").dropDuplicates(["chunk_id"])
    pairs = base.join(queries.select("query_id", "query").dropDuplicates(["query_id"]), "query_id", "left").join(texts, "chunk_id", "left")
    score = F.round(sigmoid(F.coalesce(scorer(F.coalesce("query", F.lit("")), F.coalesce("content", F.lit(""))).cast("double"), F.lit(0.0))), 6)
    best = Window.partitionBy("query_id").orderBy(F.desc("new"), "rank", "chunk_id")
    out = pairs.withColumn("new", score).withColumn("new_rank", F.row_number().over(best))
    out = out.select("query_id", F.col("new_rank").alias("rank"), "chunk_id", F.col("new").alias("score"), F.coalesce("original_rank", "rank").alias("original_rank"))
    return out.filter(F.col("rank") <= k) if k else out
