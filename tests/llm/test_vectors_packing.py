import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import neighbours, packing


def brute(vectors, k, least):
    ids = sorted(vectors)
    m = np.array([vectors[i] for i in ids], dtype=np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 6)
    out = set()
    for i in range(len(ids)):
        near = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if j != i and s[i, j] >= least)
        out |= {(ids[i], b) for _, b in near[:k]}
    return out


@pytest.mark.parametrize(("cell", "plan"), [(16, None), (8192, None), (8192, (12, 1, 6)), (32, (14, 2, 4))])
def test_neighbours_equal_brute_force(spark, cell, plan):
    r = np.random.default_rng(1)
    centres = r.standard_normal((12, 16))
    vectors = {f"v{i:03d}": (centres[i % 12] + 0.25 * r.standard_normal(16)).tolist() for i in range(240)}
    for i in range(9):  # equal and proportional copies
        vectors[f"c{i}"] = (np.array(vectors["v001"]) * (1 + i % 3)).tolist()
    rows = list(vectors.items()) + [("v000", vectors["v000"]), ("z", [0.0] * 16), ("n", None), ("w", [1.0] * 8), ("x", [float("nan")] * 16), (None, [1.0] * 16), ("y", [])]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    got = neighbours.similar_pairs(df, width=16, plan=plan, cell_rows=cell, hot_rows=3)
    pairs = {(x.id, x.other) for x in got.collect()}
    truth = brute(vectors, 5, 0.8)
    assert len(pairs & truth) >= 0.97 * len(truth) and len(pairs - truth) <= 0.03 * len(truth)
    copies = {f"c{i}" for i in range(9)}
    assert all(sum(a == c for a, _ in pairs) == 5 for c in copies)
    both = neighbours.neighbour_pairs(df, width=16).collect()
    assert all(x.chunk_id_a < x.chunk_id_b for x in both)
    assert neighbours.similar_pairs(df.limit(0), width=16).count() == 0
    assert neighbours.similar_pairs(df.filter("chunk_id = 'z'"), width=16).count() == 0


def test_plans_follow_the_rows():
    assert neighbours.index_plan(1000) == neighbours.index_plan(100_000) == (5, 0, 9) and neighbours.index_plan(1_000_000) == (8, 0, 17)
    assert neighbours.index_plan(4_000_000)[:2] == (10, 0) and neighbours.index_plan(15_000_000)[:2] == (12, 1)


def test_plans_keep_the_chance_to_share_a_cell():
    agree = 1 - math.acos(0.8) / math.pi
    for rows in (1000, 200_000, 500_000, 1_000_000, 2_000_000, 4_000_000):
        bits, probe, tables = neighbours.index_plan(rows)
        assert probe == 0 and 1 - (1 - agree**bits) ** tables > 0.935


@pytest.mark.parametrize(("bits", "probe", "tables"), [(3, 0, 4), (4, 1, 3), (5, 2, 2)])
def test_a_pair_is_ranked_in_one_cell(bits, probe, tables):
    flips = [f for f in range(1 << bits) if bin(f).count("1") <= probe]
    r = np.random.default_rng(5)
    own, others = r.integers(0, 1 << bits, (2, 300, tables)).astype(np.int32)
    for a, b in zip(own, others):
        both = [{c | f for f in flips if c & f == 0} & {d | f for f in flips if d & f == 0} for c, d in zip(a.tolist(), b.tolist())]
        met = [(t, c) for t in range(tables) for c in both[t]]
        chosen = [m for m in met if neighbours.first_meeting(a[None], b[None], m[0], m[1], probe)[0]]
        assert len(chosen) == (1 if met else 0)


def test_substrings_and_radius():
    codes = np.packbits(np.array([[1, 0, 1, 1, 1, 0, 0, 1, 0, 1, 1, 0, 0, 0, 0, 0]], dtype=bool), axis=1)
    assert neighbours.substrings(codes, 3, 4).tolist() == [[5, 3, 2, 3]]
    assert neighbours.code_radius(0.8) == 36 and neighbours.code_radius(1.0) == 0


@pytest.mark.parametrize(("bits", "probe"), [(10, 1), (14, 2)])
def test_probing_visits_all_cells_within_reach(bits, probe):
    flips = [f for f in range(1 << bits) if bin(f).count("1") <= probe]
    r = np.random.default_rng(2)
    for _ in range(200):
        a = int(r.integers(1 << bits))
        b = a
        for x in r.choice(bits, probe, replace=False):
            b ^= 1 << int(x)
        visited = [{c | f for f in flips if c & f == 0} for c in (a, b)]
        assert visited[0] & visited[1]


def test_fill_respects_all_limits():
    r = np.random.default_rng(3)
    demand = np.stack([r.integers(1, 100, 500), np.ones(500, int), r.integers(0, 20, 500)], axis=1).astype(float)
    limits = np.array([256.0, 6.0, 30.0])
    at = packing.fill(demand, limits)
    for b in set(at):
        assert (demand[at == b].sum(axis=0) <= limits).all()
    least = np.ceil((demand.sum(axis=0) / limits).max())
    assert len(set(at)) <= 1.12 * least


def test_pack_keeps_everything(spark):
    rows = [(i, 1 + i * 37 % 300, 0 if i % 3 else (1 + i * 37 % 300)) for i in range(400)] + [(1000, 5000, 0), (1001, 900, 900), (1002, 0, 0), (1003, None, None), (1004, 10, 99), (0, 1, 1)]
    examples = spark.createDataFrame(rows, "doc_id bigint, tokens bigint, loss_tokens bigint")
    kinds = spark.createDataFrame([(1, 256, 8, 200), (2, 512, 16, 300), (2, 512, 16, 300)], "window_id int, capacity_tokens int, max_segments int, max_loss_tokens int")
    got = packing.pack(examples, kinds, shard_rows=100).toPandas()
    for w, cap, seg, most in ((1, 256, 8, 200), (2, 512, 16, 300)):
        g = got[got.window_id == w]
        assert set(g.doc_id) == {r[0] for r in rows}
        used = g[g.container_id.notna()].assign(n=g.token_end - g.token_start).groupby("container_id").agg(n=("n", "sum"), s=("n", "size"), l=("loss_tokens", "sum"))
        assert used.n.max() <= cap and used.s.max() <= seg and used.l.max() <= most
        assert used.n.sum() / (len(used) * cap) > 0.9
        for doc, tokens in ((5, 186), (1000, 5000), (1001, 900)):
            one = g[g.doc_id == doc].sort_values("token_start")
            assert list(one.token_start) == [0, *one.token_end[:-1]] and one.token_end.max() == tokens
            assert len(one) == 1 if tokens <= min(cap, most) else len(one) > 1
        assert g[g.doc_id.isin([1002, 1003])].container_id.isna().all() and g[g.doc_id == 1001].loss_tokens.sum() == 900
    assert packing.pack(examples.limit(0), kinds).count() == 0


def test_texts_within_the_window_stay_whole(spark):
    texts = [(i, "answer", "word " * n) for i, n in enumerate((200, 231, 250, 600))] + [(100 + i, "abstract", "word " * (1 + i % 25)) for i in range(60)]
    documents = spark.createDataFrame(texts, "doc_id bigint, kind string, text string")
    sizes = {x.doc_id: x.tokens for x in packing.token_counts(documents, "doc_id", "text").collect()}
    assert all(192 < sizes[i] <= 256 for i in range(3)) and sizes[3] > 512
    windows = spark.createDataFrame([(1, 256), (2, 1024)], "window_id int, capacity_tokens int")
    got = packing.pack_documents(documents, windows).toPandas()
    for w, cap in ((1, 256), (2, 1024)):
        g = got[got.window_id == w]
        assert g.groupby("doc_id").size().to_dict() == {i: -(-n // cap) for i, n in sizes.items()}
        assert (g.token_end - g.token_start).groupby(g.doc_id).sum().to_dict() == sizes
        used = g.assign(n=g.token_end - g.token_start, bears=g.loss_tokens > 0).groupby("container_id").agg(n=("n", "sum"), l=("loss_tokens", "sum"), b=("bears", "sum"))
        assert used.n.max() <= cap and ((used.l <= 0.75 * cap) | (used.b == 1)).all()


def test_rows_without_an_id_and_texts_of_one_id_all_count(spark):
    rows = [(None, "abstract", "word " * n) for n in [*range(1, 40), 7]] + [(1, "abstract", "one two"), (1, "abstract", "two one"), (1, "abstract", "one two"), (1, "answer", "one two three four"), (2, "abstract", None)]
    documents = spark.createDataFrame(rows, "doc_id bigint, kind string, text string")
    sizes = sorted(x.tokens for x in packing.token_counts(documents.filter("doc_id is null"), "doc_id", "text").collect())
    got = packing.pack_documents(documents, spark.createDataFrame([(1, 256)], "window_id int, capacity_tokens int"), shard_rows=10).toPandas()
    assert sorted(got.token_end[got.doc_id.isna()]) == sizes
    assert (got.doc_id == 1).sum() == 3 and (got.doc_id == 2).sum() == 1
    assert (got.token_end - got.token_start).groupby(got.container_id).sum().max() <= 256


def test_sums_of_packings_show_faults(spark):
    kinds = spark.createDataFrame([(1, 10, 2, 5)], "window_id int, capacity_tokens int, max_segments int, max_loss_tokens int")
    rows = [("a", 1, 0, 6, 0), ("a", 2, 0, 5, 0), ("b", 3, 0, 4, 0), ("c", 3, 4, 8, 0), ("d", 4, 1, 9, 0), (None, 5, 0, 0, 0), ("e", 6, 0, 9, 9)]
    packed = spark.createDataFrame(rows, "container_id string, doc_id int, token_start int, token_end int, loss_tokens int").withColumn("window_id", F.lit(1))
    assert tuple(packing.packing_sums(packed, kinds).first()) == (1, 6, 1, 1, 1, False)
    assert packing.packing_sums(packed.limit(0), kinds).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>")], "doc_id bigint, text string").selectExpr("*", "7 as tokens")
    got = {x.doc_id: x.tokens for x in packing.token_counts(df, "doc_id", "text").collect()}
    assert got[1] >= 2 and got[2] == 0 and got[3] == 0 and got[4] > 1
