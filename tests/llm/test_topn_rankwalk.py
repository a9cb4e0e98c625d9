import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import _cluster, rankwalk, topn


def brute_top(rows, n):
    groups = {}
    for g, k, s in rows:
        groups.setdefault(g, []).append((s is None or s != s, -(s if s is not None and s == s else 0.0), k))
    return {(g, x[2]) for g, xs in groups.items() for x in sorted(xs)[:n]}


@pytest.mark.parametrize("hot", [5, 1000])
def test_top_n_equals_sorting(spark, hot):
    r = random.Random(3)
    rows = [(r.choice(["a", "a", "a", "b", None]), f"k{i:04d}", r.choice([1.0, 2.0, 2.5, float("nan"), None])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k string, s double")
    got = topn.top_n_per_group(df, ["g"], "s", ["k"], 7, hot_rows=hot)
    assert {(x.g, x.k) for x in got.collect()} == brute_top(rows, 7)
    assert got.groupBy("g").agg(F.max("rank").alias("m")).collect()[0].m == 7


def test_top_n_edges(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", 1.0, "x")], "g string, s double, k string")
    assert topn.top_n_per_group(df, ["g"], "s", ["k"], 5).count() == 2  # repeated rows each count
    assert topn.top_n_per_group(df, ["g"], "s", ["k"], 0).count() == 0
    assert topn.top_n_per_group(df.limit(0), ["g"], "s", ["k"], 3).count() == 0
    with pytest.raises(ValueError):
        topn.top_n_per_group(df.withColumn("rank", F.lit(1)), ["g"], "s", ["k"], 3)


def test_hot_groups_are_range_partitioned_and_limited_before_the_final_shuffle(spark):
    df = spark.range(1000).selectExpr("'a' as g", "cast(id as string) as k", "rand(1) as s")
    plan = topn.top_n_per_group(df, ["g"], "s", ["k"], 5, hot_rows=10)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "WindowGroupLimit" in plan


def test_best_chunks_cleans_scores_and_types(spark):
    rows = [("q", "c1", 1.0, " Dense"), ("q", "c1", 3.0, "dense"), ("q", "c2", float("inf"), "dense"), ("q", "c3", float("nan"), "dense"), ("q", "c4", 2.0, "DENSE "), ("z", "c1", 1.0, "dense"), (None, "c1", 1.0, "dense")]
    rankings = spark.createDataFrame(rows, "query_id string, chunk_id string, score double, retriever_type string").withColumn("rank", F.lit(1))
    relevance = spark.createDataFrame([("q",), ("q",), (None,)], "query_id string")
    got = [(x.chunk_id, x.score, x["rank"]) for x in topn.best_chunks(rankings, relevance).orderBy("rank").collect()]
    assert got == [("c1", 3.0, 1), ("c4", 2.0, 2)]


def dense_walk(kinds, n, damping):
    """The walk by its full transition matrix."""
    p = np.zeros((n, n))
    for index, score in kinds:
        has = dict(zip(index, score))
        for i in range(n):
            above = [j for j in has if i not in has or has[j] > has[i]]
            for j in above or range(n):
                p[i, j] += 1.0 / len(above or range(n)) / len(kinds)
    pi = np.ones(n)
    for _ in range(200):
        pi = 1 - damping + damping * (pi @ p)
    return pi


def test_walks_of_several_groups_equal_their_matrices():
    r = np.random.default_rng(0)
    rows, truth = [], {}
    for g in range(30):
        n = int(r.integers(1, 12))
        kinds = [(i := r.permutation(n)[: r.integers(1, n + 1)], r.integers(0, 4, len(i)).astype(float)) for _ in range(1 + g % 3)]
        have = sorted({int(x) for i, _ in kinds for x in i})
        kinds = [(np.searchsorted(have, i), s) for i, s in kinds]
        rows += [(f"g{g}", f"k{k}", f"i{x}", float(y)) for k, (i, s) in enumerate(kinds) for x, y in zip(i, s)]
        truth |= {(f"g{g}", f"i{x}"): p for x, p in enumerate(dense_walk(kinds, len(have), 0.4))}
    table = pa.table(dict(zip("gkis", map(list, zip(*rows)))))
    got = rankwalk._walk_table(table, "g", "k", "i", "s", 0.4).to_pylist()
    assert len(got) == len(truth) and all(abs(x["weight"] - truth[x["g"], x["i"]]) < 1e-5 for x in got)


def test_key_runs_put_whole_groups_together():
    r = random.Random(1)
    keys = sorted(r.choice("abcdef") for _ in range(100))
    table = pa.table({"k": keys, "v": list(range(100))})
    for size in (1, 7, 30, 100):
        for least in (1, 20, 1000):
            parts = list(_cluster.key_runs(table.to_batches(size), ["k"], least))
            assert pa.concat_tables(parts).equals(table.combine_chunks()) or [x for p in parts for x in p.column("v").to_pylist()] == list(range(100))
            groups = [set(p.column("k").to_pylist()) for p in parts]
            assert sum(map(len, groups)) == len(set(keys))
            assert all(p.num_rows >= least for p in parts[:-1]) and (least > 1 or all(len(g) == 1 for g in groups))


def test_many_hot_groups_are_joined_by_a_shuffle(spark):
    df = spark.range(400).selectExpr("id % 40 as g", "id as k", "cast(id % 7 as double) as s")
    hot = _cluster.hot_keys(df, ["g"], 5, "n")
    plan = lambda t: df.join(t, "g")._jdf.queryExecution().optimizedPlan().toString()
    assert hot.count() == 40 and "broadcast" in plan(_cluster.small(hot, 40)) and "broadcast" not in plan(_cluster.small(hot, 39))
    assert topn.top_n_per_group(df, ["g"], "s", ["k"], 2, hot_rows=5).count() == 80


def test_equal_rows_of_a_hot_group_each_count(spark):
    df = spark.createDataFrame([("a", 1.0, "x")] * 50 + [("a", 0.5, "y")] * 50, "g string, s double, k string")
    got = topn.top_n_per_group(df, ["g"], "s", ["k"], 60, hot_rows=10).collect()
    assert sorted(x.k for x in got) == ["x"] * 50 + ["y"] * 10 and sorted(x["rank"] for x in got) == list(range(1, 61))


def test_the_limit_of_hot_groups_follows_the_counts():
    assert topn.hot_limit(1_660_000, 12, 10) < 50_000 and topn.hot_limit(10**13, 10_000, 10) == topn.MOST_ROWS and topn.hot_limit(100, 8, 10) == 500


def test_large_groups_have_the_same_weights(spark):
    r = random.Random(5)
    rows = [(g, t, f"c{i:03d}", float(r.randint(0, 30))) for g in "ab" for t in ("x", "y", "z") for i in range(60) if r.random() < 0.7]
    rows += [("a", "x", None, 1.0), ("a", None, "c1", 1.0), ("a", "x", "c9", float("nan")), rows[0]]
    df = spark.createDataFrame(rows, "query_id string, retriever_type string, chunk_id string, score double")
    one = {(x.query_id, x.chunk_id): x.weight for x in rankwalk.rank_walk(df, hot_rows=10**6).collect()}
    two = {(x.query_id, x.chunk_id): x.weight for x in rankwalk.rank_walk(df, hot_rows=20).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)
    assert rankwalk.rank_walk(df.limit(0)).count() == 0


def test_units_do_not_matter(spark):
    r = random.Random(8)
    rows = [("q", t, f"c{i}", r.random()) for t in ("dense", "bm25", "hybrid") for i in range(30)]
    scale = {"dense": 1.0, "bm25": 1000.0, "hybrid": -0.001}
    df = lambda f: spark.createDataFrame([(q, t, c, f(t, s)) for q, t, c, s in rows], "query_id string, retriever_type string, chunk_id string, score double")
    top = lambda d: {x.chunk_id for x in rankwalk.fused_top(d).collect()}
    assert top(df(lambda t, s: s)) == top(df(lambda t, s: s * abs(scale[t]) + 7)) and len(top(df(lambda t, s: s))) == 3
    assert rankwalk.fused_top(df(lambda t, s: s).filter("retriever_type <> 'dense'")).count() == 0


def test_the_walk_goes_on_until_weights_are_settled():
    assert rankwalk.DAMPING ** rankwalk.steps_needed(rankwalk.DAMPING) <= 1e-7
