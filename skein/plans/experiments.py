"""Analytics over experiment runs, a table in the schema ``RUNS``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEATMAP = ("hit_rate@1", "hit_rate@3", "hit_rate@5", "hit_rate@10", "mrr", "ndcg@5", "precision@5", "coverage@5")
AXES = ("chunker", "embedder", "retriever")


def expand_axes(axes: dict[str, DataFrame]) -> DataFrame:
    """One row for every combination of the values of the axes (each a table of one column)."""
    out = None
    for table in axes.values():
        out = table if out is None else out.crossJoin(table)  # a grid is the product, by definition
    return out


def derive(runs: DataFrame) -> DataFrame:
    """``runs`` with ``alpha, fusion, label`` from the specs and ``ts`` from the file name."""
    parts = F.split("retriever", ":")
    alpha = F.when(F.get(parts, 0) == "hybrid", F.get(parts, 1).try_cast("double"))
    fusion = F.coalesce(F.get(parts, 2), F.lit("weighted"))
    stem = F.regexp_extract("path", r"(\d{8}_\d{6})[^/]*$", 1)
    return runs.select(
        "*", alpha.alias("alpha"), fusion.alias("fusion"), F.concat_ws(" | ", "chunker", "embedder", "retriever").alias("label"),
        F.try_to_timestamp(F.nullif(stem, F.lit("")), F.lit("yyyyMMdd_HHmmss")).alias("ts"),
    )


def valid(runs: DataFrame) -> DataFrame:
    """Runs with metrics."""
    return runs.filter(F.size("means") > 0)


def latest(runs: DataFrame) -> DataFrame:
    """The newest run of every experiment and configuration."""
    w = Window.partitionBy("experiment", "config_id").orderBy(F.col("ts").desc_nulls_last(), F.desc("path"))
    return runs.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def sweeps(runs: DataFrame) -> DataFrame:
    """``experiment, alphas``: named experiments with several hybrid weights."""
    named = runs.filter("experiment <> '' and alpha is not null")
    return named.groupBy("experiment").agg(F.count_distinct("alpha").alias("alphas")).filter("alphas > 1")


def without_sweeps(runs: DataFrame) -> DataFrame:
    """Runs outside sweeps, or all where nothing else is."""
    rest = runs.join(sweeps(runs).select("experiment"), "experiment", "left_anti")
    any_left = F.broadcast(rest.agg(F.count(F.lit(1)).alias("__n")))  # one row
    swept = runs.join(sweeps(runs).select("experiment"), "experiment", "left_semi").crossJoin(any_left).filter("__n = 0").drop("__n")
    return rest.select(*runs.columns).unionByName(swept.select(*runs.columns))


def metric_rows(runs: DataFrame, *keep: str) -> DataFrame:
    """``metric, value`` and the columns ``keep`` for every metric of every run."""
    return runs.select(*keep, F.explode("means").alias("metric", "value"))


def common_metrics(runs: DataFrame) -> DataFrame:
    """``metric``: those of every run."""
    n = F.broadcast(runs.agg(F.count_distinct("path").alias("n")))
    seen = metric_rows(runs, "path").groupBy("metric").agg(F.count_distinct("path").alias("c"))
    return seen.crossJoin(n).filter("c = n").select("metric")


def axis_rows(runs: DataFrame, *keep: str) -> DataFrame:
    """``axis, axis_value`` and the columns ``keep``, a row for every axis of every run."""
    return runs.unpivot(list(keep), list(AXES), "axis", "axis_value")


def varying_axes(runs: DataFrame) -> DataFrame:
    """``axis, choices``: axes with several values."""
    return axis_rows(runs, "path").groupBy("axis").agg(F.count_distinct("axis_value").alias("choices")).filter("choices > 1")


def heatmap(runs: DataFrame, metrics: tuple[str, ...] = HEATMAP) -> DataFrame:
    """``label, metric, value, shade``: each value's place in the range of its metric, 0.5 where flat."""
    rows = metric_rows(runs, "label").filter(F.col("metric").isin(*metrics))
    w = Window.partitionBy("metric")
    low, high = F.min("value").over(w), F.max("value").over(w)
    shade = F.when(high > low, (F.col("value") - low) / F.nullif(high - low, F.lit(0.0))).otherwise(0.5)
    return rows.select("label", "metric", "value", F.round(shade, 6).alias("shade"))


def heatmap_wide(runs: DataFrame, metrics: tuple[str, ...] = HEATMAP) -> DataFrame:
    """``label`` and one column for each metric, its ``@`` written ``_at_``."""
    rows = metric_rows(runs, "label").filter(F.col("metric").isin(*metrics))
    wide = rows.groupBy("label").pivot("metric", list(metrics)).agg(F.first("value"))
    return wide.select("label", *[F.col(f"`{m}`").alias(m.replace("@", "_at_")) for m in metrics])


def baseline_and_best(runs: DataFrame, metric: str, named: str | None = None) -> DataFrame:
    """``role, label, value``: the named run, else the least by ndcg@5, and the best by ``metric``, the older at ties."""
    rows = runs.select("label", "ts", "path", F.try_element_at("means", F.lit(metric)).alias("value"), F.try_element_at("means", F.lit("ndcg@5")).alias("base"))
    pick = rows.filter(F.col("label") == named) if named else rows
    low = pick.filter("base is not null").orderBy("base", F.col("ts").asc_nulls_last(), "path").limit(1).select(F.lit("baseline").alias("role"), "label", "value")
    high = rows.filter("value is not null").orderBy(F.desc("value"), F.col("ts").asc_nulls_last(), "path").limit(1).select(F.lit("best").alias("role"), "label", "value")
    return low.unionByName(high)


def axis_impact(runs: DataFrame, metric: str = "ndcg@5") -> DataFrame:
    """``axis, axis_value, mean, spread``: the metric's mean for each choice, and its range over the axis."""
    rows = axis_rows(runs.withColumn("__v", F.try_element_at("means", F.lit(metric))), "__v")
    means = rows.groupBy("axis", "axis_value").agg(F.round(F.avg("__v"), 6).alias("mean"))
    w = Window.partitionBy("axis")
    return means.withColumn("spread", F.round(F.max("mean").over(w) - F.min("mean").over(w), 6))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """``metric, before, after, delta`` of two runs' means."""
    a = metric_rows(before).withColumnRenamed("value", "before")
    b = metric_rows(after).withColumnRenamed("value", "after")
    return a.join(b, "metric").withColumn("delta", F.round(F.col("after") - F.col("before"), 6))


def radar(scores: DataFrame, marks: tuple[str, ...]) -> DataFrame:
    """``label`` and the mean of each mark; 0 where there is none."""
    return scores.groupBy("label").agg(*[F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in marks])


def latency_summary(samples: DataFrame, key: str, value: str) -> DataFrame:
    """``key, samples, p5, p25, p50, p75, p95, log10_p50`` with linear percentiles; null samples don't count."""
    q = F.percentile(F.col(value).cast("double"), F.lit([0.05, 0.25, 0.5, 0.75, 0.95]))
    rows = samples.filter(F.col(value).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("samples"), q.alias("q"))
    at = lambda i: F.round(F.element_at("q", i + 1), 6)
    return rows.select(key, "samples", *[at(i).alias(n) for i, n in enumerate(("p5", "p25", "p50", "p75", "p95"))], F.round(F.log10(F.nullif(F.element_at("q", 3), F.lit(0.0))), 6).alias("log10_p50"))


def alpha_sweep(runs: DataFrame, metrics: tuple[str, ...] = ("ndcg@5", "hit_rate@5", "mrr")) -> DataFrame:
    """``fusion, alpha, metric, value, peak`` over the chunker and embedder with the most weights.

    Empty where no pair has two weights.
    """
    rows = runs.filter("alpha is not null")
    pairs = rows.groupBy("chunker", "embedder").agg(F.count_distinct("alpha").alias("n")).filter("n > 1")
    top = F.broadcast(pairs.orderBy(F.desc("n"), "chunker", "embedder").limit(1).select("chunker", "embedder"))
    points = metric_rows(rows.join(top, ["chunker", "embedder"], "left_semi"), "fusion", "alpha").filter(F.col("metric").isin(*metrics))
    best = Window.partitionBy("fusion", "metric").orderBy(F.desc("value"), "alpha")
    return points.withColumn("peak", F.row_number().over(best) == 1)


def round_means(means: Column) -> Column:
    """Means as they are stored: four decimals."""
    return F.transform_values(means, lambda k, v: F.round(v, 4))
