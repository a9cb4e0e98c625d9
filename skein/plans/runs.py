"""Experiment runs from logged rankings and judged chunks, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import config_slug
from ..operators import fusion, metrics
from ..sources.tables import read_table

ALPHAS = ("0.0", "0.3", "0.5", "0.7", "1.0")
MEASURES = ("hit_rate@1", "hit_rate@3", "hit_rate@5", "hit_rate@10", "mrr", "ndcg@5", "precision@5", "coverage@5")
_INDEX = ["chunker", "embedder"]
_CELL = ["experiment", "stamp", *_INDEX, "retriever"]


def logged(spark: SparkSession, d: str) -> DataFrame:
    """Best finite score of every chunk by query, retriever type and month, with its chunker and embedder."""
    c = read_table(spark, d, "chunks").select("chunk_id", *[F.coalesce(x, F.lit("none")).alias(x) for x in _INDEX]).dropDuplicates(["chunk_id"])
    r = read_table(spark, d, "rankings").filter("query_id is not null and score is not null and not isnan(score) and abs(score) < double('infinity')")
    r = r.groupBy("query_id", F.lower(F.trim("retriever_type")).alias("kind"), F.date_trunc("month", F.col("logged_at").cast("timestamp")).alias("month"), "chunk_id").agg(F.max("score").alias("score"))
    return r.join(c, "chunk_id")


def _best(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by, "query_id").orderBy(F.desc("score"), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _stamp(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd_HHmmss")


def monthly(rows: DataFrame, k: int = 10) -> DataFrame:
    """The rankings of every month, chunker, embedder and retriever type, as cells of the experiment ``logged``."""
    name = F.when(F.col("kind") == "hybrid", "hybrid:0.5").otherwise(F.col("kind"))
    best = _best(rows, ["month", *_INDEX, "kind"], k)
    return best.select(F.lit("logged").alias("experiment"), _stamp(F.col("month")).alias("stamp"), *_INDEX, name.alias("retriever"), "query_id", "chunk_id", "rank")


def swept(rows: DataFrame, k: int = 10) -> DataFrame:
    """Dense and lexical scores of all months, fused by each of ``ALPHAS``, as cells of the experiment ``alpha_sweep``."""
    sides = rows.filter(F.col("kind").isin("dense", "bm25")).groupBy(*_INDEX, "kind", "query_id", "chunk_id").agg(F.max("score").alias("score"), F.max("month").alias("month"))
    pool = fusion.minmax(_best(sides, [*_INDEX, "kind"], fusion.pool_depth(5)), [*_INDEX, "kind", "query_id"])
    side = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("normalized"))), F.lit(0.0)).alias(kind)
    both = pool.groupBy(*_INDEX, "query_id", "chunk_id").agg(side("dense"), side("bm25")).withColumn("a", F.explode(F.array(*map(F.lit, ALPHAS))))
    alpha = F.col("a").cast("double")
    fused = both.withColumn("score", F.round(alpha * F.col("dense") + (1.0 - alpha) * F.col("bm25"), 6)).filter("score > 0")
    newest = rows.groupBy(*_INDEX).agg(_stamp(F.max("month")).alias("stamp"))
    best = _best(fused, [*_INDEX, "a"], k).join(newest, _INDEX)
    return best.select(F.lit("alpha_sweep").alias("experiment"), "stamp", *_INDEX, F.concat(F.lit("hybrid:"), "a").alias("retriever"), "query_id", "chunk_id", "rank")


def runs_table(spark: SparkSession, d: str) -> DataFrame:
    """Runs in the schema ``RUNS``: of every month and of every weight, and one without measures for the
    queries of a retriever type that nobody has judged."""
    rows = logged(spark, d)
    relevant = read_table(spark, d, "relevance").select("query_id", "chunk_id")
    measured = metrics.query_metrics(monthly(rows).unionByName(swept(rows)), relevant, by=_CELL)
    names = [m.replace("@", "_at_") for m in MEASURES]
    cells = measured.groupBy(*_CELL).agg(F.count(F.lit(1)).cast("int").alias("num_queries"), *[F.round(F.avg(n), 4).alias(n) for n in names])
    means = F.map_from_arrays(F.array(*map(F.lit, MEASURES)), F.array(*names))
    unjudged = rows.join(relevant.select("query_id").distinct(), "query_id", "left_anti").groupBy(*_INDEX, F.col("kind").alias("retriever"))
    empty = unjudged.agg(F.count_distinct("query_id").cast("int").alias("num_queries"), _stamp(F.max("month")).alias("stamp"))
    empty = empty.select(F.lit("").alias("experiment"), "stamp", *_INDEX, "retriever", "num_queries", F.create_map().cast("map<string,double>").alias("means"))
    both = cells.select(*_CELL, "num_queries", means.alias("means")).unionByName(empty.select(*_CELL, "num_queries", "means"))
    name = F.concat_ws("__", config_slug(F.col("chunker")), config_slug(F.col("embedder")), F.replace("retriever", F.lit(":"), F.lit("_")))
    path = F.concat(F.when(F.col("experiment") == "", "unjudged").otherwise(F.col("experiment")), F.lit("/"), "stamp", F.lit("_"), "config_id", F.lit(".json"))
    return both.withColumn("config_id", name).select(
        path.alias("path"), "experiment", "config_id", *_INDEX, "retriever", "num_queries",
        F.lit(None).cast("double").alias("mean_latency_ms"), "means", F.array().cast("array<double>").alias("latencies"),
    )


def runs_sql() -> str:
    """The same as common table expressions that end in ``runs_`` (without latencies)."""
    slug = lambda c: f"trim(regexp_replace(replace({c}, '%', 'pct'), '[^A-Za-z0-9_.-]+', '_', 'g'), '_')"
    cell = "experiment, stamp, chunker, embedder, retriever"
    hits = lambda k: f"count(*) FILTER (rank <= {k})"
    ideal = "list_sum(list_transform(range(1, least(count(*), 5) + 1), lambda i: 1 / log2(i + 1)))"
    values = {
        **{f"hit_rate@{k}": f"CAST({hits(k)} > 0 AS DOUBLE)" for k in (1, 3, 5, 10)},
        "mrr": "round(coalesce(1.0::DOUBLE / min(rank), 0), 6)",
        "ndcg@5": f"round(coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 5), 0) / {ideal}, 6)",
        "precision@5": f"round({hits(5)} / 5, 6)",
        "coverage@5": f"round({hits(5)} / count(*), 6)",
    }
    return (
        "of_chunk_ AS (SELECT DISTINCT ON (chunk_id) chunk_id, coalesce(chunker, 'none') AS chunker, coalesce(embedder, 'none') AS embedder FROM chunks), "
        "logged_ AS (SELECT r.query_id, lower(trim(retriever_type)) AS kind, date_trunc('month', logged_at) AS month, r.chunk_id, chunker, embedder, max(score) AS score FROM rankings r JOIN of_chunk_ USING (chunk_id) WHERE query_id IS NOT NULL AND isfinite(score) GROUP BY ALL), "
        "monthly_ AS (SELECT 'logged' AS experiment, strftime(month, '%Y%m%d_%H%M%S') AS stamp, chunker, embedder, CASE kind WHEN 'hybrid' THEN 'hybrid:0.5' ELSE kind END AS retriever, query_id, chunk_id, row_number() OVER (PARTITION BY month, chunker, embedder, kind, query_id ORDER BY score DESC, chunk_id) AS rank FROM logged_ QUALIFY rank <= 10), "
        "ever_ AS (SELECT chunker, embedder, kind, query_id, chunk_id, max(score) AS score FROM logged_ WHERE kind IN ('dense', 'bm25') GROUP BY ALL), "
        "side_ AS (SELECT * FROM ever_ QUALIFY row_number() OVER (PARTITION BY chunker, embedder, kind, query_id ORDER BY score DESC, chunk_id) <= 20), "
        "scaled_ AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS x FROM side_ WINDOW w AS (PARTITION BY chunker, embedder, kind, query_id)), "
        f"fused_ AS (SELECT chunker, embedder, query_id, chunk_id, a, round(a::DOUBLE * coalesce(max(x) FILTER (kind = 'dense'), 0) + (1 - a::DOUBLE) * coalesce(max(x) FILTER (kind = 'bm25'), 0), 6) AS score FROM scaled_, (SELECT unnest({list(ALPHAS)}) AS a) GROUP BY chunker, embedder, query_id, chunk_id, a), "
        "swept_ AS (SELECT 'alpha_sweep' AS experiment, stamp, f.chunker, f.embedder, 'hybrid:' || a AS retriever, query_id, chunk_id, row_number() OVER (PARTITION BY f.chunker, f.embedder, a, query_id ORDER BY score DESC, chunk_id) AS rank FROM fused_ f JOIN (SELECT chunker, embedder, strftime(max(month), '%Y%m%d_%H%M%S') AS stamp FROM logged_ GROUP BY ALL) n ON n.chunker = f.chunker AND n.embedder = f.embedder WHERE score > 0 QUALIFY rank <= 10), "
        "cells_ AS (SELECT * FROM monthly_ UNION ALL SELECT * FROM swept_), "
        "judged_chunk_ AS (SELECT DISTINCT query_id, chunk_id FROM relevance WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL), "
        f"met_ AS (SELECT q.*, j.chunk_id, c.rank FROM (SELECT DISTINCT {cell}, query_id FROM cells_) q JOIN judged_chunk_ j ON j.query_id = q.query_id LEFT JOIN cells_ c ON c.experiment = q.experiment AND c.stamp = q.stamp AND c.chunker = q.chunker AND c.embedder = q.embedder AND c.retriever = q.retriever AND c.query_id = q.query_id AND c.chunk_id = j.chunk_id), "
        f"measured_ AS (SELECT {cell}, query_id, " + ", ".join(f'{v} AS "{k}"' for k, v in values.items()) + f" FROM met_ GROUP BY {cell}, query_id), "
        f"means_ AS (SELECT {cell}, CAST(count(*) AS INT) AS num_queries, map({list(MEASURES)}, [" + ", ".join(f'round(avg("{k}"), 4)' for k in MEASURES) + f"]) AS means FROM measured_ GROUP BY {cell}), "
        "unjudged_ AS (SELECT '' AS experiment, strftime(max(month), '%Y%m%d_%H%M%S') AS stamp, chunker, embedder, kind AS retriever, CAST(count(DISTINCT query_id) AS INT) AS num_queries, map([]::VARCHAR[], []::DOUBLE[]) AS means FROM logged_ WHERE query_id NOT IN (SELECT query_id FROM relevance WHERE query_id IS NOT NULL) GROUP BY chunker, embedder, kind), "
        f"named_ AS (SELECT *, {slug('chunker')} || '__' || {slug('embedder')} || '__' || replace(retriever, ':', '_') AS config_id FROM (SELECT * FROM means_ UNION ALL SELECT * FROM unjudged_)), "
        "runs_ AS (SELECT CASE experiment WHEN '' THEN 'unjudged' ELSE experiment END || '/' || stamp || '_' || config_id || '.json' AS path, experiment, config_id, chunker, embedder, retriever, num_queries, means FROM named_)"
    )
