"""BM25: an inverted index as tables, and search for a table of queries."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stem import stem_terms
from ..functions.text import lexical_terms
from ..shared import BROADCAST_ROWS, stage

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Postings that a task of a search takes.
POSTINGS = 50_000


@dataclass(frozen=True)
class LexicalIndex:
    """``postings(term, id, tf, dl)`` and ``weights(term, df, idf, avgdl)``, both with ``group`` where there is one."""

    postings: DataFrame
    weights: DataFrame
    id_col: str
    k1: float
    b: float
    stem: bool
    group: str | None = None


def term_rows(rows: DataFrame, id_col: str, text: str, stem: bool = True) -> DataFrame:
    """``id_col, term``, a row for every occurrence."""
    flat = rows.select(id_col, F.explode(lexical_terms(F.col(text))).alias("term"))
    return stem_terms(flat) if stem else flat


def fit(rows: DataFrame, id_col: str = "chunk_id", text: str = "content", k1: float = K1, b: float = B, stem: bool = True, epsilon: float = EPSILON, group: str | None = None, staged: bool = True) -> LexicalIndex:
    """Index of the texts of ``rows``, whose ids are unique.

    Inverse document frequency is ``ln(n - df + 0.5) - ln(df + 0.5)``; where that is
    negative, ``epsilon`` times its mean over all terms. A text without terms counts
    as one occurrence of a term that no query has. Everything comes from one table
    of counts, in which a document's length and its first term travel along. Each value
    of the column ``group`` (few values, none null) has an index and statistics of its own.
    That table is ``staged`` in the shared folder, so texts are cut into terms once.
    """
    by = [group] if group else []
    terms = rows.select(id_col, *by, F.coalesce(lexical_terms(F.col(text)), F.array().cast("array<string>")).alias("ts"))
    flat = terms.select(id_col, *by, "ts", F.size("ts").alias("dl")).select(id_col, *by, "dl", F.posexplode_outer("ts").alias("pos", "term"))
    if stem:
        flat = stem_terms(flat.filter("term is not null")).unionByName(flat.filter("term is null"))
    counts = flat.groupBy(id_col, *by, "dl", "term").agg(F.count(F.lit(1)).alias("tf"), F.count_if(F.coalesce(F.col("pos"), F.lit(0)) == 0).alias("heads"))
    counts = stage(counts) if staged else counts
    postings = counts.filter("term is not null").select(*by, "term", id_col, "tf", "dl")
    empty = F.count_if(F.col("term").isNull())
    size = counts.groupBy(*by).agg(F.sum("heads").alias("n"), empty.alias("empty"), (F.sum(F.when(F.col("term").isNotNull(), F.col("tf")).otherwise(1)) / F.sum("heads")).alias("avgdl"))
    df = postings.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"))
    weight = lambda d: F.log(F.col("n") - d + 0.5) - F.log(d + 0.5)
    raw = df.join(F.broadcast(size), by or None).withColumn("raw", weight(F.col("df")))  # size is one row a group, as is mean
    blank = F.when(F.max("empty") > 0, F.max(weight(F.col("empty"))))
    mean = raw.groupBy(*by).agg(((F.sum("raw") + F.coalesce(blank, F.lit(0.0))) / (F.count("raw") + F.when(blank.isNotNull(), 1).otherwise(0))).alias("mean"))
    idf = F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw"))
    weights = raw.join(F.broadcast(mean), by or None).select(*by, "term", "df", idf.alias("idf"), "avgdl")
    return LexicalIndex(postings, weights, id_col, k1, b, stem, group)


def tuned(index: LexicalIndex, k1: float | None = None, b: float | None = None) -> LexicalIndex:
    """``index`` with other parameters of its score; its tables stay."""
    return replace(index, k1=index.k1 if k1 is None else k1, b=index.b if b is None else b)


def write_index(index: LexicalIndex, path: str, mode: str = "errorifexists") -> None:
    """Postings in ranges of terms (a frequent term may span files), weights, and the parameters."""
    spark = index.postings.sparkSession
    keys = [*([index.group] if index.group else []), "term", index.id_col]
    index.postings.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).parquet(f"{path}/postings")
    index.weights.write.mode(mode).parquet(f"{path}/weights")
    meta = (index.id_col, index.k1, index.b, index.stem, index.group, spark.read.parquet(f"{path}/postings").select(index.id_col).distinct().count())
    spark.createDataFrame([meta], "id_col string, k1 double, b double, stem boolean, `group` string, texts bigint").coalesce(1).write.mode(mode).json(f"{path}/meta")


def read_index(spark: SparkSession, path: str) -> LexicalIndex:
    """An index written by ``write_index``; nothing is counted anew."""
    m = spark.read.schema("id_col string, k1 double, b double, stem boolean, `group` string").json(f"{path}/meta").first()
    return LexicalIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/weights"), m.id_col, m.k1, m.b, m.stem, m["group"])


def search(index: LexicalIndex, queries: DataFrame, k: int = 5, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` best chunks of each query, then only scores above 0.

    A repeated word of a query counts as often. Scores are rounded to 6 decimals;
    ties go to the smaller id. An index in groups gives the best of each group, with
    the group before the rank. Null queries and ``k`` below 1 give no rows.
    """
    by = [index.group] if index.group else []
    asked = term_rows(queries.filter(F.col(query).isNotNull()), query_id, query, index.stem)
    asked = stage(asked.groupBy(query_id, "term").agg(F.count(F.lit(1)).alias("qtf")).join(index.weights, "term"))
    hits = index.postings
    if asked.count() <= BROADCAST_ROWS:
        # Postings of asked terms meet at their text, once each; there they meet the queries,
        # so that scores are summed and cut to the best before a shuffle. The work is heavy on
        # each posting, so partitions are by their number, not by bytes.
        parts = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-hits.count() // POSTINGS))
        hits = hits.join(F.broadcast(asked.select(*by, "term").distinct()), [*by, "term"], "left_semi").repartition(parts, index.id_col)
        asked = F.broadcast(asked)
    hits = hits.join(asked, [*by, "term"])
    damp = index.k1 * (1.0 - index.b + index.b * F.col("dl") / F.col("avgdl"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (index.k1 + 1.0) / (F.col("tf") + damp)
    scores = hits.groupBy(query_id, *by, index.id_col).agg(F.round(F.sum(part), 6).alias("score"))
    best = Window.partitionBy(query_id, *by).orderBy(F.desc("score"), index.id_col)
    ranked = scores.withColumn("rank", F.row_number().over(best)).filter((F.col("rank") <= k) & (F.col("score") > 0))
    return ranked.select(query_id, *by, "rank", index.id_col, "score")
