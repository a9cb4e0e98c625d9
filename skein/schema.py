"""Schemas of the stage tables, and deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOCUMENTS = "document_id STRING, paper_id STRING, source STRING, title STRING, author STRING, page_count INT, page_starts ARRAY<INT>, content STRING, loader STRING, layout STRING, preprocess STRING"
CHUNKS = "chunk_id STRING, document_id STRING, paper_id STRING, source STRING, chunk_index INT, start_char INT, end_char INT, page_number INT, end_page INT, num_chars INT, num_tokens INT, num_sentences INT, section_indices ARRAY<INT>, content STRING, chunker STRING, embedder STRING"
VECTORS = "chunk_id STRING, chunk_index INT, content STRING, embedding ARRAY<FLOAT>"
RANKINGS = "query_id STRING, rank INT, chunk_id STRING, score DOUBLE, retriever_type STRING, original_rank INT"
RELEVANCE = "query_id STRING, query STRING, doc_id STRING, section_id INT, chunk_id STRING, answer STRING"
SECTIONS = "paper_id STRING, section_index INT, text STRING"
RUNS = "path STRING, experiment STRING, config_id STRING, chunker STRING, embedder STRING, retriever STRING, num_queries INT, mean_latency_ms DOUBLE, means MAP<STRING,DOUBLE>, latencies ARRAY<DOUBLE>"
SPANS = "array<struct<start:int,end:int,num_tokens:int,num_sentences:int>>"

RETRIEVER_TYPES = ("dense", "bm25", "hybrid")


def chunk_key(document_id: Column, spec: Column, index: Column) -> Column:
    """The id of a chunk: the same whenever the same document is cut by the same spec."""
    return F.sha2(F.concat_ws(":", document_id, spec, index.cast("string")), 256)


def blank_to_null(text: Column) -> Column:
    """Text without outer white space; null where nothing is left."""
    return F.nullif(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit(""))


def source_stem(source: Column) -> Column:
    """A file name without folders and without its last extension."""
    name = F.regexp_replace(source, r"^.*/", "")
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
