"""Command line: ``python -m skein.cli COMMAND``. Tables are Parquet folders."""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import answers, chunking, lexical, metrics, relevance
from .operators import vector_index as V
from .plans import experiments, pipeline
from .plans.config import Pipeline, load_grid
from .session import build_session
from .sources import tables

log = logging.getLogger("skein")


def set_up_logging(level: str = "INFO", file: str | None = None) -> None:
    """Messages to the console and, if asked for, to a file named with the time."""
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if file:
        handlers.append(logging.FileHandler(f"{file}_{time.strftime('%Y%m%d_%H%M%S')}.log"))
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    log.handlers[:] = handlers
    log.setLevel(level)


def _cell(args: argparse.Namespace) -> Pipeline:
    return Pipeline.build({"chunker": args.spec, "embedder": args.embedder, "retriever": getattr(args, "retriever", None), "top_k": getattr(args, "k", 5)})


def _documents(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    docs = tables.read_documents(spark, args.documents)
    docs = docs.dropDuplicates(["document_id"])
    return docs.limit(args.limit) if args.limit else docs


def _index(spark: SparkSession, args: argparse.Namespace) -> pipeline.Index:
    return pipeline.build_index(_documents(spark, args), _cell(args), V.get_embedder(args.embedder))


def _asked(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([("q", text)], "query_id string, query string")


def select_papers(spark: SparkSession, args: argparse.Namespace) -> None:
    """A reproducible sample of papers that have judged queries."""
    docs, judged = tables.read_documents(spark, args.documents), spark.read.parquet(args.qrels).withColumnRenamed("doc_id", "paper_id")
    picked = metrics.sample_keys(metrics.eligible(docs, key="paper_id", counted=judged), "paper_id", args.num_papers, args.seed)
    if args.dry_run:
        picked.show(args.num_papers, False)
        return
    docs.join(picked, "paper_id", "left_semi").write.parquet(args.out)
    tables.write_manifest(spark, f"{args.out}_manifest", num_papers=args.num_papers, seed=args.seed, documents=args.documents, qrels=args.qrels, papers=sorted(r.paper_id for r in picked.collect()))


def extract(spark: SparkSession, args: argparse.Namespace) -> None:
    """Documents from PDF files that aren't there yet; files that fail are listed."""
    from .functions.text import resolve_preprocessor
    from .operators.pages import join_pages
    from .shared import file_system, stage

    found = tables.find_pdfs(spark, args.path, args.recursive).withColumnRenamed("path", "document_id")
    files, target = file_system(spark, args.out)
    kept = files.exists(target) and not args.force
    fresh = stage(tables.new_documents(found, spark.read.parquet(args.out)) if kept else found)
    wanted = [r.document_id for r in fresh.select("document_id").collect()]  # names only
    read = stage(tables.get_loader(args.loader)(spark, wanted, args.layout, args.recursive)) if wanted else None
    if read is not None:
        clean = resolve_preprocessor(args.clean)
        pages = read.filter("error is null").select(F.col("path").alias("document_id"), "page_no", (clean(F.col("text")) if clean else F.col("text")).alias("text"))
        about = read.filter("error is null").groupBy(F.col("path").alias("document_id")).agg(F.first("title").alias("title"), F.first("author").alias("author"))
        stem = F.regexp_extract("document_id", r"([^/]+)\.[pP][dD][fF]$", 1)
        docs = join_pages(pages).join(about, "document_id").withColumns({"paper_id": stem, "source": F.regexp_extract("document_id", r"([^/]+)$", 1), "loader": F.lit(args.loader), "layout": F.lit(args.layout), "preprocess": F.lit(args.clean)})
        docs.write.mode("append" if kept else "overwrite").parquet(args.out)
    failed = read.filter("error is not null").select("path", "error") if read is not None else spark.createDataFrame([], "path string, error string")
    bad = failed.count()
    log.info("%d written, %d skipped, %d failed", len(wanted) - bad, found.count() - len(wanted), bad)
    if bad:
        failed.show(50, False)


def chunk(spark: SparkSession, args: argparse.Namespace) -> None:
    """Chunks of documents, with a summary and a check of their offsets."""
    docs = _documents(spark, args)
    rows = chunking.chunk_documents(docs, args.spec, V.get_embedder(args.embedder), args.embedder)
    tables.write_chunks(rows, args.out)
    stored = tables.read_chunks(spark, args.out)
    chunking.chunk_summary(stored).show(truncate=False)
    chunking.verify_offsets(docs, stored).show()


def align(spark: SparkSession, args: argparse.Namespace) -> None:
    """Chunks labelled with the gold sections they overlap, and a report; of a spec, or of all."""
    docs, sections = tables.read_documents(spark, args.documents), tables.read_sections(spark, args.sections)
    spans = relevance.locate_sections(docs, sections).persist()
    rows = tables.read_chunks(spark, args.chunks)
    if args.spec and not args.all:
        sets = tables.matching_sets(tables.chunk_sets(rows), args.spec)
        if sets.isEmpty():
            raise ValueError(f"no chunks of {args.spec!r}; --all takes every set")
        rows = rows.join(F.broadcast(sets.select("chunker", F.col("embedder").alias("__e"))), "chunker").filter(F.col("embedder").eqNullSafe(F.col("__e"))).drop("__e")  # a row a set
    rows = relevance.assign_sections(rows, spans)
    relevance.alignment_report(docs, sections, spans, rows).show(vertical=True)
    if not args.dry_run:
        tables.write_chunks(rows, args.out)


def index(spark: SparkSession, args: argparse.Namespace) -> None:
    """Vectors and chunks of a chunker and embedder, its BM25 index, and a preview query."""
    built = _index(spark, args)
    tables.write_index(built.vectors, built.chunks, args.out, mode="overwrite" if args.force else "errorifexists")
    lexical.write_index(built.lexical, f"{args.out}/bm25", mode="overwrite" if args.force else "errorifexists")
    if args.query:
        pipeline.retrieve(built, _asked(spark, args.query), "dense", 5).show(truncate=False)


def search(spark: SparkSession, args: argparse.Namespace) -> None:
    """The chunks that answer a question, by one retriever or all side by side."""
    built, asked = _index(spark, args), _asked(spark, args.query)
    hybrid = f"hybrid:{args.alpha}:{args.fusion}"
    if args.compare:
        from .operators.fusion import compare

        compare({n: pipeline.retrieve(built, asked, s, args.k) for n, s in (("dense", "dense"), ("bm25", "bm25"), ("hybrid", hybrid))}).orderBy("rank").show(truncate=False)
    else:
        found = pipeline.retrieve(built, asked, hybrid if args.retriever == "hybrid" else args.retriever, args.k)
        found.join(built.chunks.select("chunk_id", "source", "page_number", "content"), "chunk_id").orderBy("rank").show(truncate=120)


def evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    """Runs of one configuration, a sweep of weights, or the grid of a file."""
    if args.config:
        cells, name = load_grid(args.config), args.config.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    elif args.all_specs:
        cells, name = [Pipeline.build({"chunker": c, "embedder": args.embedder, "retriever": args.retriever, "top_k": args.k}) for c in args.all_specs], "all_specs"
    elif args.alpha_sweep:
        cells, name = [Pipeline.build({"chunker": args.spec, "embedder": args.embedder, "retriever": f"hybrid:{a}:{args.fusion}"}) for a in args.alpha_sweep], "alpha_sweep"
    else:
        cells, name = [_cell(args)], ""
    queries, qrels = spark.read.parquet(args.queries), spark.read.parquet(args.qrels)
    docs, sections = _documents(spark, args), tables.read_sections(spark, args.sections)
    spans = relevance.locate_sections(docs, sections).persist()
    judge = lambda rows: relevance.build_relevance(qrels, relevance.assign_sections(rows, spans), queries).select("query_id", "chunk_id")
    named = lambda n: V.get_embedder(args.embedder if args.embedder_for_all else n)
    keep = (lambda cell, rows: rows.withColumn("config_id", F.lit(cell)).write.mode("append").parquet(args.per_query)) if args.per_query else None
    runs = pipeline.evaluate_cells(spark, cells, docs, queries, judge, named, name, timed=args.timed, per_query=keep).persist()
    for r in runs.collect():  # a row a cell
        log.info("%s %s", r.config_id, metrics.summary_line(r.means, r.num_queries, r.mean_latency_ms))
    runs.select("config_id", "num_queries", F.col("means")["hit_rate@5"].alias("hit_rate@5"), F.col("means")["ndcg@5"].alias("ndcg@5"), F.col("means")["mrr"].alias("mrr")).orderBy(F.desc("hit_rate@5")).show(100, False)
    if not args.no_write:
        tables.write_runs(runs, args.out)


def serve(spark: SparkSession, args: argparse.Namespace) -> None:
    """An answer with its citations, and a judge's marks for it if a judge is named."""
    asked = _asked(spark, answers.checked_question(args.query))
    model = answers.extractive_answer
    if args.model:
        system, user = (tables.read_prompt(spark, args.prompts, args.prompt_version)[k] for k in ("system", "user"))
        ask = answers.with_retries(answers.get_model(args.model), temperature=args.temperature)

        def model(passages: DataFrame) -> DataFrame:
            contexts = answers.build_context(passages).join(asked, "query_id")
            prompt = F.concat(F.lit(system + "\n\n"), answers.render(user, question=F.col("query"), context=F.col("context")))
            return contexts.select("query_id", answers.model_column(prompt, ask).alias("answer"))

    out = pipeline.answer(_index(spark, args), asked, args.retriever, args.k, args.rerank, args.rerank_depth, model)
    out["answers"].show(truncate=False)
    out["citations"].select("marker", "source", "page_number", "text_snippet").show(truncate=100)
    if args.show_context:
        out["passages"].orderBy("rank").show(truncate=False)
    if args.judge:
        prompts = answers.judge_prompts(out["answers"], answers.build_context(out["passages"]))
        answers.judge(prompts, answers.with_retries(answers.get_model(args.judge))).show(truncate=False)


def visualize(spark: SparkSession, args: argparse.Namespace) -> None:
    """The tables behind the charts of stored runs."""
    runs = experiments.derive(experiments.valid(spark.read.parquet(args.runs)))
    runs = runs if args.all_runs else experiments.latest(runs)
    charts = {
        "heatmap": lambda: experiments.heatmap_wide(experiments.without_sweeps(runs)),
        "impact": lambda: experiments.axis_impact(experiments.without_sweeps(runs), args.metric),
        "best": lambda: experiments.baseline_and_best(experiments.without_sweeps(runs), args.metric),
        "alpha_sweep": lambda: experiments.alpha_sweep(runs),
        "latency": lambda: experiments.latency_summary(runs.select("label", F.explode("latencies").alias("ms")), "label", "ms"),
    }
    for name in args.charts or charts:
        table = charts[name]().persist()
        if table.isEmpty():
            log.info("%s is left out: the runs have nothing to show for it", name)
            continue
        table.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{args.out}/{name}") if args.out else table.show(100, False)


def parser() -> argparse.ArgumentParser:
    """All commands and their parameters."""
    top = argparse.ArgumentParser(prog="skein", description=__doc__)
    top.add_argument("--log-level", default="INFO"), top.add_argument("--log-file")
    sub = top.add_subparsers(dest="command", required=True)

    def command(f, *groups: str) -> argparse.ArgumentParser:
        p = sub.add_parser(f.__name__, help=(f.__doc__ or "").strip())
        p.set_defaults(run=f)
        if "docs" in groups:
            p.add_argument("-d", "--documents", required=True)
            p.add_argument("--limit", type=int)
        if "spec" in groups:
            p.add_argument("-s", "--spec", default="fixed_size:512:128")
            p.add_argument("-e", "--embedder", default="hashing")
        if "retrieve" in groups:
            p.add_argument("-r", "--retriever", default="hybrid")
            p.add_argument("-k", type=int, default=5)
            p.add_argument("--alpha", type=float, default=0.5)
            p.add_argument("--fusion", choices=("weighted", "rrf"), default="weighted")
        return p

    p = command(select_papers, "docs")
    p.add_argument("--qrels", required=True), p.add_argument("-n", "--num-papers", type=int, default=60), p.add_argument("--seed", type=int, default=7), p.add_argument("-o", "--out"), p.add_argument("--dry-run", action="store_true")
    p = command(extract)
    p.add_argument("path"), p.add_argument("-o", "--out", required=True), p.add_argument("--loader", default="pymupdf"), p.add_argument("--clean", choices=("default", "reflow", "none"), default="default"), p.add_argument("--layout", choices=("blocks", "text"), default="blocks"), p.add_argument("-r", "--recursive", action="store_true"), p.add_argument("--force", action="store_true")
    p = command(chunk, "docs", "spec")
    p.add_argument("-o", "--out", required=True)
    p = command(align, "docs")
    p.add_argument("spec", nargs="?"), p.add_argument("--all", action="store_true"), p.add_argument("-c", "--chunks", required=True), p.add_argument("--sections", required=True), p.add_argument("-o", "--out"), p.add_argument("--dry-run", action="store_true")
    p = command(index, "docs", "spec")
    p.add_argument("-o", "--out", required=True), p.add_argument("-q", "--query"), p.add_argument("--force", action="store_true")
    p = command(search, "docs", "spec", "retrieve")
    p.add_argument("query"), p.add_argument("--compare", action="store_true")
    p = command(evaluate, "docs", "spec", "retrieve")
    p.add_argument("-c", "--config"), p.add_argument("--all-specs", nargs="+"), p.add_argument("--per-query"), p.add_argument("--timed", type=int, default=0), p.add_argument("--alpha-sweep", type=float, nargs="+"), p.add_argument("--queries", required=True), p.add_argument("--qrels", required=True), p.add_argument("--sections", required=True), p.add_argument("-o", "--out"), p.add_argument("--no-write", action="store_true"), p.add_argument("--embedder-for-all", action="store_true")
    p = command(serve, "docs", "spec", "retrieve")
    p.add_argument("query"), p.add_argument("--rerank"), p.add_argument("--rerank-depth", type=int), p.add_argument("--show-context", action="store_true"), p.add_argument("-j", "--judge"), p.add_argument("-m", "--model"), p.add_argument("-t", "--temperature", type=float, default=0.0), p.add_argument("-p", "--prompt-version"), p.add_argument("--prompts", default="prompts/answer")
    p = command(visualize)
    p.add_argument("charts", nargs="*"), p.add_argument("--runs", required=True), p.add_argument("--metric", default="ndcg@5"), p.add_argument("--all-runs", action="store_true"), p.add_argument("-o", "--out")
    return top


def main(argv: list[str] | None = None) -> None:
    """Run a command."""
    args = parser().parse_args(argv)
    set_up_logging(args.log_level, args.log_file)
    args.run(build_session(), args)


if __name__ == "__main__":
    main()
