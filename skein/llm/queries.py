"""The queries pN_ over the tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import canonical, leakage, neighbours, oracles, packing, rankwalk, sentences, splitting, topn


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best chunks of every asked query and retriever type."""
    best = topn.best_chunks(_table(spark, folder, "rankings"), _table(spark, folder, "relevance"))
    return best.select("query_id", "retriever_type", "chunk_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks of which one is among the five nearest of the other."""
    return neighbours.neighbour_pairs(_table(spark, folder, "chunk_vectors"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences of every paper."""
    return sentences.split_sentences(_table(spark, folder, "papers"))


def p3_sums(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences of every paper held against its text."""
    return sentences.sentence_sums(_table(spark, folder, "papers"), p3_found(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every oversized paper."""
    return splitting.split_oversized(_table(spark, folder, "papers"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The three chunks that come first when all retriever types count equally."""
    return rankwalk.fused_top(_table(spark, folder, "rankings")).select("query_id", "chunk_id")


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Every document assigned to containers of every context window."""
    return packing.pack_documents(_table(spark, folder, "documents"), _table(spark, folder, "context_windows"))


def p6_sums(spark: SparkSession, folder: str) -> DataFrame:
    """The packing of every window held against its limits; documents have one text an id."""
    windows = _table(spark, folder, "context_windows")
    return packing.packing_sums(p6_packed(spark, folder), packing.window_limits(windows))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that expose held-out items."""
    items = leakage.held_out(_table(spark, folder, "eval_items"))
    return leakage.leaked_items(_table(spark, folder, "documents"), items)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that look the same but are stored with different characters."""
    return canonical.look_alike_pairs(_table(spark, folder, "documents"))


def p8_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that has a look-alike, with its class and its way of being stored."""
    return canonical.look_alike_classes(_table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    return {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_sums, p4_found, p5_found, p6_packed, p6_sums, p7_found, p8_found, p8_classes)}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that have it; sentences and packings are held against invariants in the tests."""
    return dict(oracles.SQL)
