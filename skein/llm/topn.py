"""The N best rows of every group, however uneven the groups are.

Exact counts divide the groups. Groups of ordinary size go through one window.
Rows of hot groups get a salt, are range-partitioned by group and salt and sorted
there; each salted part keeps its N best, and only these meet in a second window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._cluster import same_keys, small, stage


#: Rows of a group beyond which it is hot in any case.
MOST_ROWS = 100_000


def hot_limit(total: int, partitions: int, n: int) -> int:
    """Rows beyond which a group is hot: a quarter of what a partition would hold if all were even.

    Never more than ``MOST_ROWS``, and not so few that splitting saves nothing for ``n``.
    """
    return min(MOST_ROWS, max(50 * n, total // (4 * max(partitions, 1))))


def top_n_per_group(
    df: DataFrame,
    group_cols: list[str],
    score_col: str,
    tie_cols: list[str],
    n: int,
    rank_col: str = "rank",
    hot_rows: int | None = None,
    unique: bool = False,
) -> DataFrame:
    """The ``n`` rows of highest ``score_col`` in each group, with their rank from 1.

    Ties go by ``tie_cols`` ascending, then by a hash of the whole row, so that a
    run gives the same rows as any other; rows equal in every column are
    interchangeable and each counts. A null in a group column is a group of its
    own. NaN and null scores come after all others. ``n`` below 1 and empty tables
    give no rows. All columns of ``df`` are kept; ``rank_col`` must not be one.

    Groups of more than ``hot_rows`` rows are hot; ``hot_limit`` of the counts by
    default. ``df`` is read three times or four, so it should be cheap to read. Equal
    rows of a hot group are counted before they are dealt, as they would all get the
    same salt; that is left out where the rows are known to be ``unique``.
    """
    if rank_col in df.columns:
        raise ValueError(f"column {rank_col!r} exists already")
    if n < 1:
        return df.limit(0).withColumn(rank_col, F.lit(0))
    score = F.col(score_col)
    if dict(df.dtypes)[score_col] in ("double", "float"):
        score = F.when(~F.isnan(score), score)
    order = [score.desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in tie_cols], F.xxhash64(*df.columns)]
    keys = [f"__g{i}" for i in range(len(group_cols))]
    counts = stage(df.groupBy(*[F.col(c).alias(k) for c, k in zip(group_cols, keys)]).agg(F.count(F.lit(1)).alias("__n")))
    if hot_rows is None:
        total = counts.agg(F.sum("__n")).first()[0] or 0
        hot_rows = hot_limit(total, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n)
    hot = small(counts.filter(F.col("__n") > hot_rows))
    on = same_keys(df, hot, group_cols, keys)

    whole = Window.partitionBy(*group_cols).orderBy(*order)
    cold = df.join(hot, on, "left_anti").withColumn(rank_col, F.row_number().over(whole)).filter(F.col(rank_col) <= n)

    salts = F.ceil(F.col("__n") / hot_rows)
    salted = df.join(hot, on).withColumn("__salt", F.pmod(F.xxhash64(*df.columns), salts).cast("int"))
    if unique:
        salted = salted.select(*df.columns, "__salt")
    else:
        salted = salted.groupBy(*df.columns, "__salt").agg(F.least(F.count(F.lit(1)), F.lit(n)).cast("int").alias("__copies"))
    salted = salted.repartitionByRange(*group_cols, "__salt")
    part = Window.partitionBy(*group_cols, "__salt").orderBy(*order)
    best = salted.withColumn("__r", F.row_number().over(part)).filter(F.col("__r") <= n).drop("__r", "__salt")
    if not unique:
        best = best.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__copies", "__copy")
    warm = best.withColumn(rank_col, F.row_number().over(whole)).filter(F.col(rank_col) <= n)
    return cold.unionByName(warm)


def valid_scores(rankings: DataFrame) -> DataFrame:
    """``query_id, retriever_type, chunk_id, score`` of the rows with a finite score.

    ``retriever_type`` in lower case without outer blanks; -0.0 becomes 0.0.
    """
    score = F.col("score")
    finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf"))
    kind = F.lower(F.regexp_replace("retriever_type", r"^\s+|\s+$", ""))
    return rankings.filter(finite).select("query_id", kind.alias("retriever_type"), "chunk_id", (score + F.lit(0.0)).alias("score"))


def best_chunks(rankings: DataFrame, relevance: DataFrame, n: int = 10, hot_rows: int | None = None) -> DataFrame:
    """The ``n`` best chunks per query of ``relevance`` and retriever type.

    A chunk counts once, with its highest finite score. Returns ``query_id,
    retriever_type, chunk_id, score, rank``.
    """
    asked = relevance.select("query_id").filter(F.col("query_id").isNotNull()).distinct()
    rows = valid_scores(rankings).join(asked, "query_id", "left_semi")
    best = stage(rows.groupBy("query_id", "retriever_type", "chunk_id").agg(F.max("score").alias("score")))
    return top_n_per_group(best, ["query_id", "retriever_type"], "score", ["chunk_id"], n, hot_rows=hot_rows, unique=True)
