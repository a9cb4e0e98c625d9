import importlib
import json

import pytest
from pyspark.sql import functions as F

from skein import schema
from skein.plans import config, experiments
from skein.sources import tables
from skein.streaming import ingest


def run_rows():
    """One run of each cell, a second of some, one without metrics, one in an unnamed experiment."""
    rows = []
    for experiment, data in (("grid_12", config.GRID_12), ("alpha_sweep", config.ALPHA_SWEEP)):
        for i, c in enumerate(config.expand_grid(data)):
            for again in range(1 + (i % 4 == 0)):
                base = round(0.4 + 0.03 * ((i * 7 + again) % 11), 4)
                means = {"hit_rate@1": base, "hit_rate@3": round(base + 0.1, 4), "hit_rate@5": round(base + 0.15, 4), "hit_rate@10": round(base + 0.2, 4), "mrr": round(base + 0.05, 4), "ndcg@5": round(base - 0.02, 4), "precision@5": 0.25, "coverage@5": round(base / 2, 4)}
                if i % 5 == 2:
                    means["extra"] = 1.0
                rows.append((f"experiments/2026080{1 + again}_10{i:02d}00_{c.id}.json", experiment, c.id, c.chunker.spec, c.embedder.spec, c.retriever.spec, 450 + i, 7.5 + i, means, [1.0 + i, 2.0 + i]))
    rows.append(("experiments/20260101_000000_empty.json", "grid_12", "empty", "sentence:5:1", "minilm", "dense", 0, 0.0, {}, []))
    rows.append(("experiments/handmade.json", "", "handmade", "recursive:512:64", "minilm", "hybrid", 100, 3.0, {"mrr": 0.5, "ndcg@5": 0.9}, []))
    return rows


def runs_table(spark):
    """The runs in the schema ``RUNS``."""
    return spark.createDataFrame(run_rows(), schema.RUNS)


def test_config():
    cells = config.expand_grid(config.GRID_12)
    assert len(cells) == 12 and len(config.group_by_index(cells)) == 6 and cells[0].top_k == 10
    sweep = config.expand_grid(config.ALPHA_SWEEP)
    assert len(sweep) == 6 and len(config.group_by_index(sweep)) == 1 and sweep[-1].retriever.spec == "hybrid:0.5:rrf"
    assert config.expand_grid({"name": "n"})[0].name == "n" and config.expand_grid({"grid": {"chunker": "sentence"}})[0].chunker.name == "sentence"
    with pytest.raises(ValueError, match="axes"):
        config.expand_grid({"grid": {"color": ["red"]}})
    assert config.Part.parse({"name": "hybrid", "options": {"alpha": 0.3}}, "").spec == "hybrid:alpha=0.3"
    assert config.Part.parse(None, "dense").name == "dense" and config.slug("semantic:512:90", "mpnet") == "semantic_512_90__mpnet"
    with pytest.raises(TypeError):
        config.Part.parse(3, "x")


def test_runs(spark):
    rows = runs_table(spark)
    assert rows.count() == len(run_rows()) and experiments.valid(rows).count() == rows.count() - 1
    latest = experiments.latest(experiments.derive(experiments.valid(rows)))
    assert [r.experiment for r in experiments.sweeps(latest).collect()] == ["alpha_sweep"]
    assert experiments.without_sweeps(latest).filter("experiment = 'alpha_sweep'").count() == 0
    only = latest.filter("experiment = 'alpha_sweep'")
    assert experiments.without_sweeps(only).count() == only.count() == 6
    assert experiments.alpha_sweep(only).filter("peak and fusion = 'weighted' and metric = 'mrr'").count() == 1
    assert experiments.alpha_sweep(only.limit(1)).count() == 0
    derived = {r.path: r for r in experiments.derive(rows).collect()}
    assert derived["experiments/handmade.json"].ts is None and derived["experiments/handmade.json"].alpha is None


def test_files(spark, tmp_path):
    (tmp_path / "r").mkdir()
    good = {"config": {"chunker": "sentence:5:1", "embedder": "minilm", "retriever": "dense"}, "config_id": "x", "num_queries": 3, "means": {"mrr": 0.5}, "per_query": [{"latency_ms": 1.0}, {}]}
    (tmp_path / "r" / "20260101_000000_x.json").write_text(json.dumps(good))
    (tmp_path / "r" / "bad.json").write_text("{")
    (tmp_path / "r" / "old.json").write_text(json.dumps({**good, "retrievers": {"a": 1}}))
    (tmp_path / "r" / "empty.json").write_text(json.dumps({**good, "means": {}}))
    runs = tables.read_runs(spark, str(tmp_path / "r")).collect()
    assert len(runs) == 1 and runs[0].latencies == [1.0] and runs[0].means == {"mrr": 0.5}
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "queries.json").write_text(json.dumps({"q1": {"query": "one"}, "q2": "two"}))
    (tmp_path / "b" / "qrels.json").write_text(json.dumps({"q1": {"doc_id": "p", "section_id": 2}}))
    (tmp_path / "b" / "answers.json").write_text(json.dumps({"q1": "yes"}))
    q, r, a = tables.read_benchmark(spark, str(tmp_path / "b"))
    assert {tuple(x) for x in q.collect()} == {("q1", "one"), ("q2", "two")} and tuple(r.first()) == ("q1", "p", 2) and a.first().answer == "yes"
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "2401.1v1.json").write_text(json.dumps({"sections": [{"text": "a"}, {"text": "b"}]}))
    assert {tuple(x) for x in tables.read_sections(spark, str(tmp_path / "s")).collect()} == {("2401.1v1", 0, "a"), ("2401.1v1", 1, "b")}
    for n in ("pricing_04242026.csv", "pricing_06192026.csv", "pricing_99999999.csv", "pricing.csv"):
        (tmp_path / n).write_text("model,input_per_1m,cached_input_per_1m,output_per_1m\nm,1.0,,2.0\n" if "0619" in n else "model\n")
    assert tables.latest_price_file([p.name for p in tmp_path.glob("*.csv")]) == "pricing_06192026.csv"
    assert tuple(tables.read_prices(spark, str(tmp_path)).first()) == ("m", 1.0, None, 2.0)
    for v in ("v2", "v10"):
        (tmp_path / "prompt" / v).mkdir(parents=True)
        (tmp_path / "prompt" / v / "answer_system.prompt").write_text(v)
        (tmp_path / "prompt" / v / "answer_user.template").write_text("{q}")
    assert tables.read_prompt(spark, str(tmp_path / "prompt"))["version"] == "v10"


def test_index_round_trip(spark, tmp_path):
    v = spark.createDataFrame([("a", [1.0, 2.0])], "chunk_id string, embedding array<float>")
    c = spark.createDataFrame([("a", "t")], "chunk_id string, content string")
    tables.write_index(v, c, str(tmp_path / "i"))
    assert tables.read_index(spark, str(tmp_path / "i"))[0].count() == 1
    tables.write_index(v, c.limit(0), str(tmp_path / "j"))
    with pytest.raises(ValueError):
        tables.read_index(spark, str(tmp_path / "j"))
    with pytest.raises(ValueError):
        tables.write_index(v.limit(0), c, str(tmp_path / "k"))
    assert tables.new_documents(c.withColumnRenamed("chunk_id", "document_id"), v.withColumnRenamed("chunk_id", "document_id")).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from skein.operators.chunking import chunk_documents
    from skein.schema import DOCUMENTS

    rows = [(f"d{i}", "p", "s", None, None, 1, [0], f"Sentence number {i}. Another one follows.\nLast line.", None, None, None) for i in range(20)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    ingest.ingest(ingest.document_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "cp"), "sentence:2:1", "none").awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "chunks"))
    want = chunk_documents(docs, "sentence:2:1")
    assert {r.chunk_id for r in got.collect()} == {r.chunk_id for r in want.collect()} and got.select("batch").distinct().count() == 4
    assert spark.read.parquet(str(tmp_path / "out" / "postings")).agg(F.sum("tf")).first()[0] > 0


def test_event_stream_drops_late_rows(spark, tmp_path):
    batch = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (1, "2024-01-01 02:00:00", "a", 2.0)], "user_id bigint, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    batch.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "e"))
    q = ingest.tumbling(stream, "1 hour", "10 minutes").writeStream.format("memory").queryName("t_events").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select * from t_events").count() == 1
    assert ingest.tumbling(batch).count() == 2 and ingest.sessions(batch).count() == 2 and ingest.sliding(batch).count() == 4


def test_entry_needs_no_optional_package():
    entry = importlib.import_module("__spark_entry__")
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 60


def test_pipeline_and_commands(spark, tmp_path, capsys):
    from skein import cli
    from skein.operators.answers import NO_CONTEXT, with_retries
    from skein.plans import pipeline
    from skein.schema import DOCUMENTS

    texts = ["Cells were imaged under a microscope. Staining followed the protocol.", "Ripley K function measures clustering of points. It needs a window.", "Gradient boosting fits trees to residuals. Trees are shallow."]
    docs = spark.createDataFrame([(f"d{i}", f"p{i}", f"p{i}.pdf", None, None, 1, [0], t, None, None, None) for i, t in enumerate(texts)], DOCUMENTS)
    queries = spark.createDataFrame([("a", "Ripley clustering function"), ("b", " "), ("c", "zzz")], "query_id string, query string")
    cell = config.Pipeline.build({"chunker": "sentence:2:1", "embedder": "hashing", "retriever": "bm25"})
    index = pipeline.build_index(docs, cell, tables_embedder := pipeline.V.get_embedder("hashing"))
    source = {r.chunk_id: r.source for r in index.chunks.collect()}
    for spec in ("dense", "bm25", "hybrid", "hybrid:0.3:rrf"):
        got = pipeline.retrieve(index, queries, spec, 2).filter("query_id = 'a' and rank = 1").first()
        assert source[got.chunk_id] == "p1.pdf" and got.retriever_type == spec.split(":")[0]
    out = pipeline.answer(index, queries, "bm25", 2, "overlap")
    said = {r.query_id: r.answer for r in out["answers"].collect()}
    assert "[1]" in said["a"] and said["c"] == NO_CONTEXT and out["citations"].count() >= 1
    for wrong in ("nothing", "dense:1"):
        with pytest.raises(ValueError):
            pipeline.retrieve(index, queries, wrong, 2)
    pipeline.release(index)
    judge = lambda rows: rows.filter("source = 'p1.pdf'").select(F.lit("a").alias("query_id"), "chunk_id")
    runs = pipeline.evaluate_cells(spark, config.expand_grid({"grid": {"chunker": ["sentence:2:1"], "embedder": ["hashing"], "retriever": ["bm25", "dense"]}}), docs, queries, judge, lambda n: tables_embedder, "e")
    assert runs.count() == 2 and all(r.means["mrr"] == 1.0 and r.num_queries == 1 for r in runs.collect())
    docs.write.parquet(str(tmp_path / "docs"))
    cli.main(["search", "Ripley clustering", "-d", str(tmp_path / "docs"), "-r", "bm25", "-s", "sentence:2:1"])
    assert "p1.pdf" in capsys.readouterr().out
    cli.main(["chunk", "-d", str(tmp_path / "docs"), "-s", "sentence:2:1", "-o", str(tmp_path / "chunks")])
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == 3
    assert pipeline.clean_documents(docs).filter("page_starts is null").count() == 0
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise TimeoutError
        return "ok"

    assert with_retries(flaky, wait=0.0)("p") == "ok" and len(calls) == 3
