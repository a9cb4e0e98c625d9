"""Measures of rankings against relevant chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)


def ideal_gain(n: Column, k: int) -> Column:
    """Discounted gain of a perfect ranking of ``n`` relevant items at depth ``k``."""
    total = F.lit(0.0)
    for rank in range(1, k + 1):
        total = total + F.when(n >= rank, 1.0 / F.log2(F.lit(rank + 1.0))).otherwise(0.0)
    return total


def query_metrics(rankings: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = KS, by: list[str] | None = None) -> DataFrame:
    """``query_id``, ``mrr`` and ``hit_rate_at_k, precision_at_k, coverage_at_k, ndcg_at_k`` for each k.

    ``rankings(query_id, chunk_id, rank)``, ``relevant(query_id, chunk_id)``. A query
    without results has zeros; a query without relevant chunks no row. A chunk counts
    once in a ranking, at its best rank. Precision divides by k, not by what came back.
    With ``by``, columns of ``rankings`` without nulls, each of their values is a ranking
    of its own, in which those queries count that have results there.
    """
    keys = [*(by or []), "query_id"]
    rel = relevant.select("query_id", "chunk_id").filter("query_id is not null and chunk_id is not null").distinct()
    once = rankings.filter("rank is not null").groupBy(*keys, "chunk_id").agg(F.min("rank").alias("rank"))
    found = (once.select(*keys).distinct().join(rel, "query_id") if by else rel).join(once, [*keys, "chunk_id"], "left")
    rank = F.col("rank")
    aggs = [F.count(F.lit(1)).alias("__n"), F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("mrr")]
    for k in ks:
        aggs.append(F.count_if(rank <= k).alias(f"__h{k}"))
        aggs.append(F.coalesce(F.sum(F.when(rank <= k, 1.0 / F.log2(rank + 1.0))), F.lit(0.0)).alias(f"__g{k}"))
    rows = found.groupBy(*keys).agg(*aggs)
    out = [*keys, F.round("mrr", 6).alias("mrr")]
    for k in ks:
        hits = F.col(f"__h{k}")
        out += [
            (hits > 0).cast("double").alias(f"hit_rate_at_{k}"),
            F.round(hits / F.lit(float(k)), 6).alias(f"precision_at_{k}"),
            F.round(hits / F.col("__n"), 6).alias(f"coverage_at_{k}"),
            F.round(F.col(f"__g{k}") / ideal_gain(F.col("__n"), k), 6).alias(f"ndcg_at_{k}"),
        ]
    return rows.select(*out)


def long_metrics(metrics: DataFrame) -> DataFrame:
    """``query_id, metric, value``."""
    return metrics.unpivot("query_id", [c for c in metrics.columns if c != "query_id"], "metric", "value")


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """``metric, mean, num_queries``: unweighted over queries."""
    return long_metrics(metrics).groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("num_queries"))


def compact_ranks(rankings: DataFrame, order: list[Column], keys: list[str]) -> DataFrame:
    """``rankings`` with ``rank`` counted anew from 1 in ``order`` within ``keys``."""
    return rankings.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def eligible(*tables: DataFrame, key: str, counted: DataFrame) -> DataFrame:
    """``key, queries``: keys present in every table, with their rows in ``counted``."""
    rows = counted.groupBy(key).agg(F.count(F.lit(1)).alias("queries"))
    for t in tables:
        rows = rows.join(t.select(key).distinct(), key, "left_semi")
    return rows


def sample_keys(keys: DataFrame, key: str, size: int, seed: int = 7) -> DataFrame:
    """``size`` keys in the order of a seeded digest, or all if there are fewer."""
    return keys.select(key).distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}:"), key)), key).limit(size)


def set_changes(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """``key, change``: copied (only wanted), kept (both), removed (only present)."""
    w, p = wanted.select(key).distinct().withColumn("w", F.lit(1)), present.select(key).distinct().withColumn("p", F.lit(1))
    both = w.join(p, key, "full_outer")
    return both.select(key, F.when(F.col("p").isNull(), "copied").when(F.col("w").isNull(), "removed").otherwise("kept").alias("change"))


def evaluation_rows(rankings: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = KS, depth: int | None = None) -> DataFrame:
    """``query_metrics`` with ``ranked``, the ids that came back for each query down to ``depth``, best first."""
    top = rankings.filter((F.col("rank") <= (depth or max(ks))) & F.col("query_id").isNotNull())
    ids = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("r"))  # depth rows a query
    ids = ids.select("query_id", F.transform("r", lambda x: x["chunk_id"]).alias("ranked"))
    return query_metrics(rankings, relevant, ks).join(ids, "query_id", "left").withColumn("ranked", F.coalesce("ranked", F.array().cast("array<string>")))


def summary_line(means: dict[str, float], queries: int, latency_ms: float | None = None) -> str:
    """Measures of a run for people."""
    parts = [f"{k}={v:.3f}" for k, v in means.items()]
    return f"{queries} queries | " + " ".join(parts) + (f" | {latency_ms:.1f} ms a query" if latency_ms is not None else "")


# Names of measures that are no words.
ACRONYMS = ("mrr", "ndcg")


def pretty(metric: Column) -> Column:
    """A measure's name as a heading: ``hit_rate@5`` gives ``Hit Rate@5``."""
    at = F.instr(metric, "@")
    name = F.when(at > 0, F.substring(metric, F.lit(1), at - 1)).otherwise(metric)
    heading = F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
    for word in ACRONYMS:
        heading = F.replace(heading, F.lit(word.title()), F.lit(word.upper()))
    return F.concat(heading, F.when(at > 0, F.substring(metric, at, F.length(metric))).otherwise(""))
