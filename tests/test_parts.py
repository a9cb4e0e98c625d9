import pytest
from pyspark.sql import functions as F

from skein import cli, shared
from skein.operators import answers, fusion, lexical, metrics, rerank
from skein.operators import vector_index as V
from skein.plans import config, pipeline
from skein.registry import Registry
from skein.schema import DOCUMENTS
from skein.sources import tables


def test_registries_name_what_they_know():
    with pytest.raises(ValueError, match="unknown thing 'c'; known: a, b"):
        Registry("thing", {"b": 1, "a": 2}).named("c")
    assert V.get_store("exact") is V.dense_topk and tables.get_loader("pymupdf") is tables.extract_pages
    for get in (V.get_store, tables.get_loader, V.get_embedder, answers.get_model, rerank.get_scorer):
        with pytest.raises(ValueError, match="unknown"):
            get("nothing")
    with pytest.raises(RuntimeError, match="sentence-transformers"):
        V.get_embedder("minilm")(["text"])


def test_once_keeps_a_row_for_each_key(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", None), (None, 3), (None, 4)], "k string, v int")
    rows = shared.once(df, "k").collect()
    assert sorted((r.k or "") for r in rows) == ["", "a", "b"] and shared.once(df.limit(0), "k").count() == 0
    assert {tuple(r) for r in rows} == {tuple(r) for r in shared.once(df.orderBy(F.desc("v")), "k").collect()}


def test_stored_lexical_index(spark, tmp_path):
    rows = spark.createDataFrame([("a", "cats and dogs run"), ("b", "dogs bark"), ("c", None), ("d", "birds sing loudly")], "chunk_id string, content string")
    asked = spark.createDataFrame([("q", "dogs run"), ("z", None)], "query_id string, query string")
    fitted = lexical.fit(rows, stem=False)
    lexical.write_index(fitted, str(tmp_path / "i"))
    stored = lexical.read_index(spark, str(tmp_path / "i"))
    got = lambda i: [tuple(r) for r in lexical.search(i, asked, 5).orderBy("rank").collect()]
    assert got(stored) == got(fitted) != got(lexical.tuned(stored, b=0.0)) and stored.k1 == 1.5
    with pytest.raises(Exception, match="exists"):
        lexical.write_index(fitted, str(tmp_path / "i"))


def test_waiting_and_counting(spark):
    calls = []

    def limited(q, contents):
        calls.append(q)
        if len(calls) < 3:
            raise RuntimeError("429")
        return [float(len(c)) for c in contents]

    assert rerank.patient(limited, lambda e: "429" in str(e), wait=0)("q", ["ab"]) == [2.0] and len(calls) == 3
    with pytest.raises(KeyError):
        rerank.patient(lambda: {}["x"], lambda e: False)()
    used = spark.createDataFrame([("q",), (None,)], "prompt string").select(answers.metered(F.col("prompt"), lambda p: ("yes", 10, 4, 2)).alias("u"))
    assert [tuple(r.u) for r in used.collect()] == [("yes", 6, 4, 2), (None, 0, 0, 0)]
    total = answers.usage_totals(used.select(F.lit("m").alias("model"), "u.*")).first()
    assert (total.calls, total.input_tokens, total.output_tokens) == (2, 6, 2)
    with pytest.raises(ValueError):
        answers.checked_question(" ")


def test_judging(spark):
    rows = spark.createDataFrame([("a", "why?", "so [1]"), ("b", None, None)], "query_id string, query string, answer string")
    contexts = spark.createDataFrame([("a", "[1] s\ntext")], "query_id string, context string")
    prompts = answers.judge_prompts(rows, contexts)
    by = {r.query_id: r.prompt for r in prompts.collect()}
    assert "[1] s\ntext" in by["a"] and answers.NO_PASSAGES in by["b"] and "Reference" not in by["a"]
    marks = answers.judge(prompts, lambda p: '{"relevance": 5, "accuracy": 4, "completeness": 3, "citation_quality": 4, "rationale": "r"}' if "why" in p else "no")
    assert [(r.query_id, r.average) for r in marks.collect()] == [("a", 4.0)]


def test_vectors_are_added_under_guards(spark, tmp_path):
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.5, 0.0])], "chunk_id string, embedding array<float>")
    path = str(tmp_path / "v")
    assert V.add_vectors(path, v) == 2 and V.add_vectors(path, v.limit(0)) == 0 and V.add_vectors(path, v) == 2
    for bad in ([("c", [1.0])], [("c", None)]):
        with pytest.raises(ValueError):
            V.add_vectors(path, spark.createDataFrame(bad, v.schema))
    assert spark.read.parquet(path).count() == 4


def test_evaluation(spark):
    rows = [(f"d{i}", f"p{i}", "s.pdf", None, None, 1, [0], f"Text number {i} speaks of {w}.", None, None, None) for i, w in enumerate(["cats", "dogs", "birds", "fish"])]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    asked = spark.createDataFrame([("q1", "cats"), ("q2", "fish")], "query_id string, query string")
    cells = config.expand_grid({"defaults": {"embedder": "hashing", "chunker": "fixed_size:16:0"}, "grid": {"retriever": ["bm25", "hybrid:0.5"]}})
    kept = {}
    judge = lambda c: c.filter("document_id = 'd0'").selectExpr("'q1' as query_id", "chunk_id").union(c.filter("document_id = 'd3'").selectExpr("'q2'", "chunk_id"))
    runs = pipeline.evaluate_cells(spark, cells, docs, asked, judge, timed=1, per_query=lambda c, r: kept.update({c: r.collect()})).collect()
    assert [r.means["mrr"] for r in runs] == [1.0, 1.0] and all(len(r.latencies) == 1 and r.num_queries == 2 for r in runs)
    assert set(kept) == {c.id for c in cells} and all(len(rows) == 2 and rows[0].ranked for rows in kept.values())
    index = pipeline.build_index(docs, cells[0], V.get_embedder("hashing"))
    assert pipeline.swept_rankings(index, asked, [0.2, 0.8]).select("retriever_type").distinct().count() == 4
    with pytest.raises(ValueError, match="options"):
        pipeline.retrieve(index, asked, "bm25", 5, k2=1.0)
    pipeline.release(index)


def test_parts_of_a_configuration(spark):
    parts = pipeline.build_parts(config.Pipeline.build({"embedder": "hashing", "chunker": "sentence:2:1", "loader": {"name": "pymupdf", "layout": "text"}}))
    docs = spark.createDataFrame([("d", "p", "s", None, None, 1, [0], "One. Two. Three.", None, None, None)], DOCUMENTS)
    assert parts.chunk(docs).count() == 2 and parts.load.keywords == {"layout": "text"} and parts.search is V.dense_topk
    for bad in ({"store": "none"}, {"loader": "none"}, {"chunker": "none"}, {"embedder": "none"}):
        with pytest.raises(ValueError, match="unknown"):
            pipeline.build_parts(config.Pipeline.build({"embedder": "hashing", **bad}))


def test_measures(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), (None, "z", 2.0)], "g string, i string, score double")
    assert {(r.i, r.normalized) for r in fusion.minmax(df, ["g"]).collect()} == {("x", 0.0), ("y", 1.0), ("z", 1.0)}
    names = spark.createDataFrame([("hit_rate@5",), ("mrr",), ("ndcg@10",), (None,)], "m string")
    assert [r[0] for r in names.select(metrics.pretty(F.col("m"))).collect()] == ["Hit Rate@5", "MRR", "NDCG@10", None]
    assert metrics.summary_line({"mrr": 0.5}, 3, 2.0) == "3 queries | mrr=0.500 | 2.0 ms a query"


def test_sets_and_order(spark, tmp_path):
    sets = spark.createDataFrame([("semantic:512:90", "minilm", 3), ("semantic:512:90", "mpnet", 4), ("sentence:5:1", None, 2)], "chunker string, embedder string, num_chunks bigint")
    stems = lambda w: [r.stem for r in tables.matching_sets(sets, w).collect()]
    assert stems("semantic:512:90") == ["semantic_512_90__minilm", "semantic_512_90__mpnet"] and stems("semantic_512_90__mpnet") == ["semantic_512_90__mpnet"] and stems("x") == []
    for n in ("b", "a"):
        spark.createDataFrame([(n, *[None] * 10)], DOCUMENTS).write.parquet(str(tmp_path / n))
    assert [r.document_id for r in tables.read_documents(spark, [str(tmp_path / "b"), str(tmp_path / "a")], in_order=True).collect()] == ["b", "a"]
    tables.write_manifest(spark, str(tmp_path / "m"), seed=7)
    assert spark.read.text(str(tmp_path / "m")).first().value == '{"seed": 7}'


def test_commands_parse():
    args = cli.parser().parse_args(["serve", "-d", "x", "why?", "-j", "judge", "-m", "model", "-t", "0.5", "-p", "v2"])
    assert (args.judge, args.model, args.temperature, args.prompt_version) == ("judge", "model", 0.5, "v2")
    assert cli.parser().parse_args(["align", "-d", "x", "-c", "c", "--sections", "s", "--all"]).all
