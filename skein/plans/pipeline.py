"""End to end: documents to an index, queries to rankings, rankings to runs and answers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers, chunking, fusion, lexical, metrics, rerank
from ..operators import vector_index as V
from ..schema import RUNS
from ..sources import tables
from .config import Pipeline, group_by_index

Embedder = Callable[[list[str]], np.ndarray]


@dataclass(frozen=True)
class Index:
    """What all retrievers of one chunker and embedder share."""

    chunks: DataFrame
    vectors: DataFrame
    lexical: lexical.LexicalIndex
    embedder: Embedder


@dataclass(frozen=True)
class Parts:
    """The components that a configuration names."""

    load: Callable[..., DataFrame]
    chunk: Callable[[DataFrame], DataFrame]
    embed: Embedder
    search: Callable[..., DataFrame]


def build_parts(cell: Pipeline) -> Parts:
    """Loader, chunker, embedder and store of ``cell``; a name that isn't known raises before any data is read."""
    embed, options = V.get_embedder(cell.embedder.name), dict(cell.loader.options)
    chunking.parse_chunker(cell.chunker.spec)
    load, search = tables.get_loader(cell.loader.name), V.get_store(cell.store.name)
    return Parts(partial(load, **options), lambda docs: chunking.chunk_documents(docs, cell.chunker.spec, embed, cell.embedder.spec), embed, search)


def clean_documents(documents: DataFrame, clean: str = "default") -> DataFrame:
    """Documents with cleaned content. Page maps of changed contents are dropped, as they no longer hold."""
    step = T.resolve_preprocessor(clean)
    if step is None:
        return documents
    done = documents.withColumn("__c", step(F.col("content")))
    same = F.col("__c").eqNullSafe(F.col("content"))
    return done.withColumns({"page_starts": F.when(same, F.col("page_starts")), "content": F.col("__c"), "preprocess": F.lit(clean)}).drop("__c")


def build_index(documents: DataFrame, cell: Pipeline, embedder: Embedder, stem: bool = True) -> Index:
    """Chunks, vectors and postings of ``documents``. Cached, as every retriever reads them; see ``release``."""
    chunks = chunking.chunk_documents(documents, cell.chunker.spec, embedder, cell.embedder.spec).persist()
    vectors = chunks.select("chunk_id", "chunk_index", "content", V.embed_column(F.col("content"), embedder).alias("embedding")).persist()
    fitted = lexical.fit(chunks, stem=stem)
    ready = lexical.LexicalIndex(fitted.postings.persist(), fitted.weights.persist(), fitted.id_col, fitted.k1, fitted.b, fitted.stem)
    return Index(chunks, vectors, ready, embedder)


def release(index: Index) -> None:
    """Free what ``build_index`` has cached."""
    for t in (index.chunks, index.vectors, index.lexical.postings, index.lexical.weights):
        t.unpersist()


def retrieve(index: Index, queries: DataFrame, spec: str = "hybrid", k: int = 5, store: str = "exact", **tuning: float) -> DataFrame:
    """``query_id, rank, chunk_id, score, retriever_type`` for ``queries(query_id, query)``.

    ``dense``, ``bm25``, or ``hybrid[:alpha[:weighted|rrf]]``. Blank queries have no results.
    ``tuning`` may give ``k1`` and ``b`` of the lexical score, and ``pool``, how many
    times ``k`` a hybrid reads of both rankings.
    """
    if unknown := sorted(tuning.keys() - {"k1", "b", "pool"}):
        raise ValueError(f"unknown retriever options {', '.join(unknown)}; known: b, k1, pool")
    name, *args = spec.split(":")
    asked = queries.filter(F.col("query").rlike(r"\S")).select("query_id", "query")

    def dense(depth: int) -> DataFrame:
        q = asked.select("query_id", V.embed_queries(F.col("query"), index.embedder).alias("embedding"))
        return V.get_store(store)(index.vectors, q, depth, unique=True)

    def sparse(depth: int) -> DataFrame:
        return lexical.search(lexical.tuned(index.lexical, tuning.get("k1"), tuning.get("b")), asked, depth)

    if name == "hybrid":
        alpha = float(args[0]) if args and args[0] else fusion.ALPHA
        how = args[1] if len(args) > 1 else "weighted"
        depth = fusion.pool_depth(k, int(tuning.get("pool", fusion.POOL)))
        found = fusion.hybrid(dense(depth), sparse(depth), k, alpha, how)
    elif name in ("dense", "bm25"):
        if args:
            raise ValueError(f"{spec!r}: {name} takes no arguments")
        found = dense(k) if name == "dense" else sparse(k)
    else:
        raise ValueError(f"unknown retriever {name!r}; known: bm25, dense, hybrid")
    return found.withColumn("retriever_type", F.lit(name))


def swept_rankings(index: Index, queries: DataFrame, alphas: Iterable[float], k: int = 5, how: str = "weighted") -> DataFrame:
    """Rankings of ``dense``, ``bm25`` and of a hybrid for every weight, told apart by ``retriever_type``."""
    found = [retrieve(index, queries, s, k).withColumn("retriever_type", F.lit(s)) for s in ("dense", "bm25", *(f"hybrid:{a}:{how}" for a in alphas))]
    return reduce(DataFrame.unionByName, found)


def _timed(index: Index, asked: DataFrame, cell: Pipeline, depth: int, sample: int) -> list[float]:
    """Milliseconds that each of ``sample`` queries takes when asked alone."""
    took = []
    for row in asked.select("query_id", "query").limit(sample).collect():
        began = time.time()
        retrieve(index, asked.sparkSession.createDataFrame([row]), cell.retriever.spec, depth).collect()
        took.append(round((time.time() - began) * 1000, 2))
    return took


def evaluate_cells(spark: SparkSession, cells: Iterable[Pipeline], documents: DataFrame, queries: DataFrame, judge: Callable[[DataFrame], DataFrame], embedders: Callable[[str], Embedder] = V.get_embedder, experiment: str = "", stem: bool = True, timed: int = 0, per_query: Callable[[str, DataFrame], None] | None = None) -> DataFrame:
    """Runs of ``cells`` in the schema ``RUNS``; an index is built once for the cells that share it.

    ``judge`` gives ``(query_id, chunk_id)`` for the chunks of an index. Runs hold the
    means of all measures, and as mean latency the time of all queries together over
    their number; latencies are those of ``timed`` queries asked alone. ``per_query`` gets
    each cell's id and its ``evaluation_rows``, with what came back for every query.
    """
    rows = []
    for group in group_by_index(cells).values():
        index = build_index(documents, group[0], embedders(group[0].embedder.name), stem)
        relevant = judge(index.chunks).persist()
        asked = queries.join(relevant.select("query_id").distinct(), "query_id", "left_semi")
        for cell in group:
            began = time.time()
            depth = max(cell.top_k, *metrics.KS)
            ranked = retrieve(index, asked, cell.retriever.spec, depth).persist()
            means = {r.metric.replace("_at_", "@"): r for r in metrics.mean_metrics(metrics.query_metrics(ranked, relevant)).collect()}  # one row a measure
            n = next((r.num_queries for r in means.values()), 0)
            path = time.strftime("%Y%m%d_%H%M%S") + f"_{cell.id}"
            each = round((time.time() - began) * 1000 / n, 2) if n else 0.0
            if per_query:
                per_query(cell.id, metrics.evaluation_rows(ranked, relevant, depth=depth))
            alone = _timed(index, asked, cell, depth, timed) if timed else []
            rows.append((path, experiment, cell.id, cell.chunker.spec, cell.embedder.spec, cell.retriever.spec, n, each, {m: round(r["mean"], 4) for m, r in means.items()}, alone))
            ranked.unpersist()
        relevant.unpersist()
        release(index)
    return spark.createDataFrame(rows, RUNS)


def answer(index: Index, queries: DataFrame, retriever: str = "hybrid", k: int = 5, reranker: str | None = None, depth: int | None = None, model: Callable[[DataFrame], DataFrame] = answers.extractive_answer) -> dict[str, DataFrame]:
    """``rankings, passages, answers, citations`` for ``queries``.

    ``model`` makes ``(query_id, answer)`` from the passages; without passages the
    fixed answer stands and no model is asked.
    """
    if reranker:
        first = retrieve(index, queries, retriever, rerank.rerank_depth(k, depth)).drop("retriever_type")
        ranked = rerank.rerank(first, queries, index.chunks, k, rerank.get_scorer(reranker))
    else:
        ranked = retrieve(index, queries, retriever, k)
    passages = ranked.select("query_id", "rank", "chunk_id", "score").join(index.chunks.select("chunk_id", "source", "page_number", "content"), "chunk_id")
    raw = model(passages)
    n = passages.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    status = queries.select("query_id", "query").join(raw, "query_id", "left").join(n, "query_id", "left")
    done = status.select("query_id", "query", answers.answer_status(F.col("answer"), F.col("n")).alias("s")).select("query_id", "query", "s.*")
    return {"rankings": ranked, "passages": passages, "answers": done, "citations": answers.citations(done, passages)}
