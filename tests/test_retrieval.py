import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import answers as A
from skein.operators import fusion, lexical, metrics, rerank
from skein.operators import vector_index as V

CORPUS = ["Cell imaging was performed under a microscope", "XGBoost is a gradient boosted tree model", "Ripley's K function measures spatial clustering", "The treaty of Vienna was signed", "Gradient boosting fits residual trees", "$$ 1 + 1 = 2 $$"]


def corpus(spark, texts):
    return spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, content string")


@pytest.mark.parametrize("stem", [False, True])
def test_bm25(spark, stem):
    index = lexical.fit(corpus(spark, CORPUS), stem=stem)
    queries = spark.createDataFrame([("a", "Ripley K function"), ("b", "Vienna treaty"), ("c", "what is the"), ("d", "photosynthesis"), ("e", None)], "query_id string, query string")
    got = lexical.search(index, queries, 5).collect()
    first = {r.query_id: r.chunk_id for r in got if r["rank"] == 1}
    assert first == {"a": "c2", "b": "c3"} and all(r.score > 0 and r.chunk_id != "c5" for r in got)
    two = lexical.fit(corpus(spark, ["cell imaging", "cell counting"]), stem=stem)
    assert lexical.search(two, spark.createDataFrame([("q", "cell")], "query_id string, query string"), 5).count() == 0
    assert lexical.search(index, queries, 0).count() == 0


def test_chunks_of_every_chunker_are_indexed(spark, tmp_path):
    from skein.plans.queries import QUERIES

    rows = [(f"d:{mark}:{i:04d}", t, kind) for mark, kind in (("fs", "fixed_size:128:25%"), ("sn", "sentence:5:1"), ("xx", None)) for i, t in enumerate(CORPUS)]
    rows += [("d:sn:0009", "Clustering, clustering", "sentence:5:1")]
    spark.createDataFrame(rows + rows[:2], "chunk_id string, content string, chunker string").write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame([("q00000020", "Ripley K function"), ("q00000021", "Vienna")], "query_id string, query string").write.parquet(str(tmp_path / "queries.parquet"))
    assert {r.chunk_id for r in QUERIES["embed_hash"](spark, str(tmp_path)).collect()} == {r[0] for r in rows}
    got = {(r.chunker, r.chunk_id): (r["rank"], r.score) for r in QUERIES["bm25_topk_stemmed"](spark, str(tmp_path)).collect()}
    assert set(got) == {("fixed_size:128:25%", "d:fs:0002"), ("sentence:5:1", "d:sn:0002"), ("", "d:xx:0002")}
    alone = lexical.fit(corpus(spark, CORPUS), stem=True)
    one = lexical.search(alone, spark.createDataFrame([("q", "Ripley K function")], "query_id string, query string"), 5).first()
    assert got["fixed_size:128:25%", "d:fs:0002"] == got["", "d:xx:0002"] == (1, one.score) != got["sentence:5:1", "d:sn:0002"]


def test_dense(spark):
    rows = spark.createDataFrame([("first", [1.0, 0.0, 0.0]), ("second", [0.0, 5.0, 0.0]), ("third", [0.0, 0.0, 1.0]), ("zero", [0.0] * 3), ("null", None), ("first", [1.0, 0.0, 0.0])], "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([("a", [0.0, 1.0, 0.0]), ("b", [0.9, 0.4, 0.1]), ("n", None)], "query_id string, embedding array<float>")
    got = V.dense_topk(rows, q, 50).orderBy("query_id", "rank").collect()
    assert [(r.chunk_id, r.score) for r in got if r.query_id == "a"][:1] == [("second", 1.0)]
    assert [r.chunk_id for r in got if r.query_id == "b"] == ["first", "second", "third", "zero"] and len(got) == 8
    assert V.dense_topk(rows, q, 0).count() == 0 and V.dense_topk(rows.limit(0), q, 3).count() == 0
    assert [r.chunk_id for r in V.dense_topk(rows, q.filter("query_id = 'a'"), 3).orderBy("rank").collect()] == ["second", "first", "third"]
    with pytest.raises(Exception, match="width"):
        V.dense_topk(rows, spark.createDataFrame([("a", [1.0, 0.0])], q.schema), 3).collect()


def test_dense_blocks(spark, monkeypatch):
    r = np.random.default_rng(0)
    rows = spark.createDataFrame([(f"v{i:03d}", r.standard_normal(8).tolist()) for i in range(100)], "chunk_id string, embedding array<float>").repartition(5)
    q = rows.withColumnRenamed("chunk_id", "query_id")
    whole = {tuple(x) for x in V.dense_topk(rows, q, 4).collect()}
    monkeypatch.setattr(V, "BLOCK_NUMBERS", 80)
    assert {tuple(x) for x in V.dense_topk(rows, q, 4).collect()} == whole and len(whole) == 400


def test_dense_memory(spark, monkeypatch):
    """A worker never holds the scores of all queries for a batch of rows."""
    r = np.random.default_rng(1)
    m = r.standard_normal((10_000, 8)).astype(np.float32)
    m[::7], m[1::11] = 0, m[1]
    ids = [f"v{i:05d}" for i in r.permutation(len(m))]
    rows = spark.createDataFrame(list(zip(ids, m.tolist(), strict=True)), "chunk_id string, embedding array<float>").coalesce(1)
    q = rows.limit(3000).withColumnRenamed("chunk_id", "query_id")
    plain = type(rows).mapInArrow

    def measured(df, search, schema):
        def run(batches):
            import tracemalloc

            tracemalloc.start()
            yield from search(batches)
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            assert peak < 60e6, peak

        return plain(df, run, schema)

    monkeypatch.setattr(type(rows), "mapInArrow", measured)
    got = {(x.query_id, x["rank"]): (x.chunk_id, x.score) for x in V.dense_topk(rows, q, 3, unique=True).collect()}
    order = np.argsort(ids)
    n = np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    u = np.divide(m, n, out=np.zeros(m.shape), where=n > 0)
    score = np.round(u[:3000] @ u[order].T, 6)
    best = np.argsort(-score, axis=1, kind="stable")[:, :3]
    assert got == {(ids[i], j + 1): (ids[order[b]], score[i, b]) for i in range(3000) for j, b in enumerate(best[i])}


def rankings(spark, rows):
    return spark.createDataFrame(rows, "query_id string, chunk_id string, score double, rank int")


def test_fusion(spark):
    d = rankings(spark, [("q", "a", 0.9, 1), ("q", "b", 0.5, 2), ("q", "c", 0.1, 3)])
    s = rankings(spark, [("q", "c", 12.0, 1), ("q", "d", 4.0, 2)])
    order = lambda df: [r.chunk_id for r in df.orderBy("rank").collect()]
    assert order(fusion.weighted(d, s, 5, 1.0)) == ["a", "b"] and order(fusion.weighted(d, s, 5, 0.0)) == ["c"]
    assert order(fusion.hybrid(d, s, 2, fusion="rrf"))[0] == "c"
    one = fusion.minmax(rankings(spark, [("q", "a", 2.0, 1), ("q", "b", 2.0, 2)]), ["query_id"]).collect()
    assert all(r.normalized == 1.0 for r in one)
    with pytest.raises(ValueError):
        fusion.hybrid(d, s, fusion="other")
    assert fusion.pool_depth(3) == 20 and fusion.pool_depth(10) == 40


def test_rerank(spark):
    first = rankings(spark, [("q", "c0", 1.0, 1), ("q", "c2", 0.9, 2), ("q", "gone", 0.8, 3)])
    queries = spark.createDataFrame([("q", "Ripley function")], "query_id string, query string")
    got = rerank.rerank(first, queries, corpus(spark, CORPUS), 0).orderBy("rank").collect()
    assert [r.chunk_id for r in got][0] == "c2" and {r.chunk_id for r in got} == {"c0", "c2", "gone"} and [r.original_rank for r in got][0] == 2
    assert rerank.rerank(first, queries, corpus(spark, CORPUS), 1).count() == 1 and rerank.rerank_depth(5) == 20


def test_metrics(spark):
    r = rankings(spark, [("x", "A", 1.0, 1), ("x", "B", 1.0, 2), ("x", "C", 1.0, 3), ("x", "C", 1.0, 4)])
    rel = spark.createDataFrame([("x", "C"), ("x", "C"), ("y", "A"), (None, "A")], "query_id string, chunk_id string")
    got = {m.query_id: m for m in metrics.query_metrics(r, rel).collect()}
    assert got["x"].hit_rate_at_3 == 1 and got["x"].hit_rate_at_1 == 0 and got["x"].precision_at_5 == 0.2 and got["x"].mrr == pytest.approx(1 / 3, abs=1e-6)
    assert got["y"].mrr == 0 and got["y"].ndcg_at_5 == 0 and set(got) == {"x", "y"}
    five = rankings(spark, [("z", k, 1.0, i + 1) for i, k in enumerate("ABCDE")])
    many = spark.createDataFrame([("z", k) for k in "ABCDE"] + [("z", f"o{i}") for i in range(195)], "query_id string, chunk_id string")
    assert metrics.query_metrics(five, many).first().ndcg_at_5 == 1.0


@pytest.mark.parametrize(
    ("answer", "marks"),
    [("a [1] and [2].", [1, 2]), ("[1][3]", [1, 3]), ("[1, 3]", [1, 3]), ("[1-3]", [1, 2, 3]), ("[3] then [1]", [3, 1]), ("[sic] [Smith et al.]", []), ("[2020-2024]", [2020, 2024]), ("[5-3]", [5, 3]), ("[1-3-5]", [1, 3, 5]), ("[2020-01-15]", [2020, 1, 15]), ("[0]", [0]), (None, []), ("[99999999999]", [])],
)
def test_markers(spark, answer, marks):
    got = spark.createDataFrame([(answer,)], "a string").select(A.parse_markers(F.col("a")).alias("m"), A.unresolved_markers(A.parse_markers(F.col("a")), F.lit(3)).alias("u")).first()
    assert got.m == marks and got.u == [m for m in marks if not 1 <= m <= 3]


def test_answers(spark):
    df = spark.createDataFrame([("a", "fine [1]", 2), ("b", " insufficient_context.", 2), ("c", "x", 0), ("d", None, None)], "query_id string, raw string, n int")
    got = {r.query_id: r.s for r in df.select("query_id", A.answer_status(F.col("raw"), F.col("n")).alias("s")).collect()}
    assert got["a"].answer == "fine [1]" and got["a"].confidence is None and got["b"].answer == A.ABSTAINED and got["c"].answer == A.NO_CONTEXT and got["d"].confidence == 0
    p = spark.createDataFrame([("a", 1, "c1", 0.5, "s.pdf", None, "w " * 400), ("a", 2, "c2", 0.4, "s.pdf", 3, None)], "query_id string, rank int, chunk_id string, score double, source string, page_number int, content string")
    assert A.build_context(p).first().context.startswith("[1] s.pdf\nw w") and "[2] s.pdf p3\n" in A.build_context(p).first().context
    c = A.citations(df.select("query_id", F.col("raw").alias("answer")), p).collect()
    assert len(c) == 1 and len(c[0].text_snippet) == 302 and c[0].text_snippet.endswith("w...")


def test_judge(spark):
    good = '{"relevance":5,"accuracy":5,"completeness":4,"citation_quality":5,"rationale":"r"}'
    rows = [("a", good)] + [(f"b{v}", good.replace("4", str(v))) for v in (0, 6, -1)] + [("n", None), ("j", "no json"), ("m", '{"relevance":5}')]
    s = A.judge_scores(spark.createDataFrame(rows, "query_id string, raw string"))
    one = s.collect()
    assert len(one) == 1 and one[0].average == 4.75 and one[0].confidence == 0.9375
    assert A.judge_means(s).first().scored == 1 and A.judge_means(s.limit(0)).first().citation_quality_is_low is False


def test_cost(spark):
    prices = spark.createDataFrame([("m", 1.0, None, 2.0)], "model string, input_per_1m double, cached_input_per_1m double, output_per_1m double")
    usage = spark.createDataFrame([("m", 10, 5, 1), ("u", 1, 1, 1)], "model string, input_tokens int, cached_tokens int, output_tokens int")
    assert {r.model: r.cost_usd for r in A.cost(usage, prices).collect()} == {"m": 17e-6, "u": None}
