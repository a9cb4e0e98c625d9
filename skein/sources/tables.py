"""Reading and writing stage tables and the files of a project."""

from __future__ import annotations

import re
from datetime import datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import config_slug
from ..registry import Registry
from ..schema import CHUNKS, DOCUMENTS, RUNS, blank_to_null
from ..shared import list_names, read_text

RUN_FILE = "config STRUCT<chunker:STRING,embedder:STRING,retriever:STRING>, config_id STRING, experiment STRING, num_queries INT, mean_latency_ms DOUBLE, means MAP<STRING,DOUBLE>, per_query ARRAY<STRUCT<latency_ms:DOUBLE>>, retrievers STRING, _corrupt_record STRING"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def find_pdfs(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """``path, length`` of the PDF files of a folder, in order of path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.filter(F.lower("path").endswith(".pdf")).select("path", "length").orderBy("path")


def extract_pages(spark: SparkSession, path: str, layout: str = "blocks", recursive: bool = False, sort_blocks: bool = False) -> DataFrame:
    """``path, page_no, text, title, author, error`` of PDF files; needs a PDF library on the workers.

    ``blocks`` joins the text blocks of a page by blank lines, top to bottom if
    ``sort_blocks``; ``text`` is the page's raw stream. A file that can't be read gives
    one row with its error.
    """
    if layout not in ("blocks", "text"):
        raise ValueError(f"unknown layout {layout!r}; known: blocks, text")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).filter(F.lower("path").endswith(".pdf"))

    def read(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for name, body in zip(batch["path"], batch["content"]):
                try:
                    import fitz

                    with fitz.open(stream=bytes(body), filetype="pdf") as doc:
                        said = [(doc.metadata or {}).get(k) for k in ("title", "author")]
                        for i, page in enumerate(doc):
                            if layout == "text":
                                text = page.get_text("text")
                            else:
                                parts = [b[4].strip() for b in page.get_text("blocks", sort=sort_blocks) if b[6] == 0]
                                text = "\n\n".join(p for p in parts if p)
                            rows.append((name, i, text, *said, None))
                except Exception as e:
                    rows.append((name, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page_no", "text", "title", "author", "error"]).astype({"page_no": "Int32"})

    return files.select("path", "content").mapInPandas(read, "path string, page_no int, text string, title string, author string, error string")


def read_documents(spark: SparkSession, path: str | list[str], fmt: str = "parquet", in_order: bool = False) -> DataFrame:
    """Documents from Parquet or JSON files, in the schema ``DOCUMENTS``; blank titles and authors are null.

    With ``in_order`` they come in the order of the paths given, and of the rows in a file.
    """
    reader = spark.read.schema(DOCUMENTS)
    load = reader.parquet if fmt == "parquet" else reader.option("multiLine", "true").json
    if in_order:
        parts = [load(p).withColumn("__p", F.lit(i)).withColumn("__i", F.monotonically_increasing_id()) for i, p in enumerate([path] if isinstance(path, str) else path)]
        docs = reduce(DataFrame.unionByName, parts).orderBy("__p", "__i").drop("__p", "__i")
    else:
        docs = load(path) if isinstance(path, str) or fmt != "parquet" else load(*path)
    return docs.withColumns({c: blank_to_null(F.col(c)) for c in ("title", "author")})


def write_documents(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Documents as Parquet."""
    documents.write.mode(mode).parquet(path)


def new_documents(incoming: DataFrame, done: DataFrame, key: str = "document_id") -> DataFrame:
    """Rows of ``incoming`` that ``done`` doesn't have yet."""
    return incoming.join(done.select(key).distinct(), key, "left_anti")


def write_chunks(chunks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Chunks as Parquet, a folder for each chunker and embedder, which is also their catalogue."""
    chunks.write.mode(mode).partitionBy("chunker", "embedder").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks written by ``write_chunks``."""
    return spark.read.schema(CHUNKS).parquet(path)


def matching_sets(sets: DataFrame, wanted: str) -> DataFrame:
    """The rows of ``chunk_sets`` that ``wanted`` names: ``chunker__embedder`` as a file name, else all of a chunker spec."""
    named = sets.withColumn("stem", config_slug(F.col("chunker"), F.col("embedder")))
    exact = named.filter(F.col("stem") == wanted)
    return (named.filter(F.col("chunker") == wanted) if exact.isEmpty() else exact).orderBy("stem")


def chunk_sets(chunks: DataFrame) -> DataFrame:
    """``chunker, embedder, num_chunks``: what a chunk table holds."""
    return chunks.groupBy("chunker", "embedder").agg(F.count(F.lit(1)).alias("num_chunks"))


def write_index(vectors: DataFrame, chunks: DataFrame, path: str, index: str = "flat", metric: str = "cosine", mode: str = "errorifexists") -> None:
    """Vectors, chunks and a manifest. An empty index is refused. Vectors are computed once, and counted as written."""
    if vectors.isEmpty():
        raise ValueError("an index without vectors isn't written")
    vectors.write.mode(mode).parquet(f"{path}/vectors")
    chunks.write.mode(mode).parquet(f"{path}/chunks")
    width = vectors.sparkSession.read.parquet(f"{path}/vectors").agg(F.max(F.size("embedding")).alias("dimension"), F.count(F.lit(1)).alias("num_chunks"))
    width.select(F.lit("parquet").alias("store"), F.lit(index).alias("index"), F.lit(metric).alias("metric"), "dimension", "num_chunks").coalesce(1).write.mode(mode).json(f"{path}/meta")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(vectors, chunks)``; raises if one has ids the other lacks."""
    from ..operators.vector_index import index_integrity

    vectors, chunks = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/chunks")
    row = index_integrity(vectors, chunks).first()
    if row.without_chunk or row.without_vector:
        raise ValueError(f"{path}: {row.without_chunk} vectors without chunk, {row.without_vector} chunks without vector")
    return vectors, chunks


def read_sections(spark: SparkSession, folder: str) -> DataFrame:
    """``paper_id, section_index, text`` from one JSON file a paper, ``{"sections": [{"text": ...}]}``."""
    raw = spark.read.schema("sections ARRAY<STRUCT<text:STRING>>").option("multiLine", "true").json(folder)
    paper = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    return raw.select(paper.alias("paper_id"), F.posexplode("sections").alias("section_index", "s")).select("paper_id", "section_index", "s.text")


def read_json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """``key, value`` of a JSON file that is one object; ``value`` is the type of its values."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"MAP<STRING,{value}>")).alias("key", "value"))


def read_benchmark(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(queries, qrels, answers)`` from ``queries.json``, ``qrels.json`` and ``answers.json``."""
    raw = read_json_map(spark, f"{folder}/queries.json", "STRING")
    text = F.coalesce(F.get_json_object("value", "$.query"), F.col("value"))
    queries = raw.select(F.col("key").alias("query_id"), text.alias("query"))
    qrels = read_json_map(spark, f"{folder}/qrels.json", "STRUCT<doc_id:STRING,section_id:INT>").select(F.col("key").alias("query_id"), "value.*")
    answers = read_json_map(spark, f"{folder}/answers.json", "STRING").select(F.col("key").alias("query_id"), F.col("value").alias("answer"))
    return queries, qrels, answers


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Result files as a table in the schema ``RUNS``, oldest first; unreadable and older layouts are left out."""
    raw = spark.read.schema(RUN_FILE).option("multiLine", "true").option("mode", "PERMISSIVE").json(f"{folder}/*.json")
    rows = raw.select("*", F.col("_metadata.file_path").alias("path")).filter("_corrupt_record is null and retrievers is null").filter(F.size("means") > 0)
    names = [c.split()[0] for c in RUNS.replace("MAP<STRING,DOUBLE>", "MAP").replace("ARRAY<DOUBLE>", "ARRAY").split(", ")]
    flat = rows.select("*", "config.chunker", "config.embedder", "config.retriever", F.filter(F.transform("per_query", lambda r: r["latency_ms"]), lambda x: x.isNotNull()).alias("latencies"))
    return flat.withColumn("experiment", F.coalesce("experiment", F.lit(""))).select(*names).orderBy("path")


def write_runs(runs: DataFrame, path: str) -> None:
    """Append runs, means rounded to 4 decimals and latency to 2."""
    from ..plans.experiments import round_means

    runs.withColumns({"means": round_means(F.col("means")), "mean_latency_ms": F.round("mean_latency_ms", 2)}).write.mode("append").parquet(path)


def latest_price_file(names: list[str]) -> str | None:
    """The newest ``pricing_MMDDYYYY.csv``; names without a date lose, and ``pricing.csv`` is the last resort."""
    dated = []
    for n in names:
        m = re.fullmatch(r"pricing_(\d{8})\.csv", Path(n).name)
        if m:
            try:
                dated.append((datetime.strptime(m[1], "%m%d%Y"), n))
            except ValueError:
                continue
    return max(dated)[1] if dated else next((n for n in names if Path(n).name == "pricing.csv"), None)


def read_prices(spark: SparkSession, folder: str) -> DataFrame:
    """``model, input_per_1m, cached_input_per_1m, output_per_1m`` from the newest price list; lines with # are comments."""
    name = latest_price_file(list_names(spark, folder))
    if name is None:
        raise FileNotFoundError(f"no price list in {folder}")
    name = f"{folder}/{name}"
    kind = "model STRING, input_per_1m DOUBLE, cached_input_per_1m DOUBLE, output_per_1m DOUBLE"
    return spark.read.schema(kind).option("header", "true").option("comment", "#").option("ignoreLeadingWhiteSpace", "true").csv(name)


def latest_prompt(spark: SparkSession, folder: str) -> str:
    """The folder ``vN`` of the highest number."""
    found = [(int(m[1]), n) for n in list_names(spark, folder) if (m := re.fullmatch(r"v(\d+)", n))]
    if not found:
        raise FileNotFoundError(f"no version in {folder}")
    return max(found)[1]


def read_prompt(spark: SparkSession, folder: str, version: str | None = None) -> dict[str, str]:
    """``version, system, user`` of a prompt: one file of each kind must be there."""
    version = version or latest_prompt(spark, folder)
    names = list_names(spark, f"{folder}/{version}")
    out = {"version": version}
    for role, ending in (("system", "_system.prompt"), ("user", "_user.template")):
        files = [n for n in names if n.endswith(ending)]
        if len(files) != 1:
            raise ValueError(f"{folder}/{version}: {len(files)} files *{ending}, not one")
        out[role] = read_text(spark, f"{folder}/{version}/{files[0]}")
    return out


def write_manifest(spark: SparkSession, path: str, **values: object) -> None:
    """One JSON row that says how a set of papers was picked."""
    import json

    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_judged(spark: SparkSession, folder: str) -> DataFrame:
    """``label`` and four marks from JSON files ``{"label": ..., "means": {...}}``; marks left out are 0."""
    marks = ("relevance", "accuracy", "completeness", "citation_quality")
    raw = spark.read.schema("label STRING, means MAP<STRING,DOUBLE>").option("multiLine", "true").json(folder)
    name = F.coalesce("label", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1))
    return raw.select(name.alias("label"), *[F.coalesce(F.try_element_at("means", F.lit(m)), F.lit(0.0)).alias(m) for m in marks])


#: Loaders: functions of a session and a path that give pages.
LOADERS: Registry = Registry("loader", {"pymupdf": extract_pages})


def get_loader(name: str):
    """A loader by name."""
    return LOADERS.named(name)
