import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.operators import chunking as C
from skein.operators import pages, relevance
from skein.operators.vector_index import get_embedder
from skein.schema import DOCUMENTS

PROSE = "Cells were imaged overnight. The model was boosted! Is spatial statistics useful? It is.\nTables follow here; they are long. " * 4
EDGES = ["", "   \n\n   \n", None, "x" * 4000, "col " * 4000, "café — naïve — 日本語のテキスト — emoji 🧪 tail", "a <|endoftext|> b", "one\n\ntwo\n\nthree. four"]
SPECS = ["fixed_size:32:8", "sliding_window:32:0.5", "sentence:2:1", "sentence:2:0:true", "recursive:32:8", "semantic:40:80"]


def documents(spark):
    rows = [(f"d{i}", f"p{i}", "test.pdf", None, None, 1, [0, 40] if i % 2 else None, t, None, None, None) for i, t in enumerate([PROSE, *EDGES])]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.mark.parametrize("spec", SPECS)
def test_invariants(spark, spec):
    docs = documents(spark)
    rows = C.chunk_documents(docs, spec, get_embedder("hashing"), "hashing").cache()
    assert C.verify_offsets(docs, rows).first().broken == 0
    for doc, text in enumerate([PROSE, *EDGES]):
        own = sorted(rows.filter(F.col("document_id") == f"d{doc}").collect(), key=lambda r: r.chunk_index)
        assert [r.chunk_index for r in own] == list(range(len(own)))
        assert bool(own) == bool(text and text.strip())
        assert all(r.content.strip() and r.num_chars == r.end_char - r.start_char for r in own)
        assert all((r.page_number is None) == (doc % 2 == 0) for r in own)
        if own:
            covered = set().union(*(range(r.start_char, r.end_char) for r in own))
            assert all(not text[i].strip() for i in set(range(len(text))) - covered)
    assert rows.select("chunk_id").distinct().count() == rows.count()
    rows.unpersist()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=200), st.integers(1, 8), st.integers(0, 7))
def test_recursive_tiles_and_advances(text, size, overlap):
    spans = C.recursive_spans(text, size, min(overlap, size - 1))
    assert all(b[0] > a[0] and b[0] <= a[1] for a, b in zip(spans, spans[1:]))
    assert (not text and not spans) or spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(n <= size for _, _, n, _ in spans)


def test_sentence_groups():
    s = [(i, i + 1, 40) for i in range(6)]
    assert [x[3] for x in C.group_sentences(s, 5, 0, 100, None)] == [2, 2, 2]
    assert [x[3] for x in C.group_sentences([(i, i + 1, 5) for i in range(5)], 2, 1, 100, None)] == [2, 2, 2, 2]
    assert [x[3] for x in C.group_sentences([(i, i + 1, 5) for i in range(8)], 2, 0, 100, 20)] == [4, 4]
    assert C.sentence_cap(5) == 273 and C.sentence_floor(5) == 97


def test_seams():
    s = [(i, i + 1, 40) for i in range(4)]
    count = lambda d, t, cap=1000: [x[3] for x in C.seam_groups(s, d, t, cap)]
    assert count([0, 0.9, 0], 0.5) == [2, 2] and count([0, 0.9, 0], None) == [4] and count([0, 0, 0], None, 100) == [2, 2]
    assert C.seam_threshold([0.4, 0.4], 90) is None and C.seam_threshold([], 90) is None
    assert abs(C.seam_threshold([0, 0.1, 0.2, 0.9], 90) - 0.69) < 1e-9


def test_specs():
    assert C.parse_chunker("fixed_size:512:25%")[1] == {"chunk_size": 512, "overlap": "25%"}
    for bad in ("nothing", "sentence:1:2:true:4"):
        with pytest.raises(ValueError):
            C.parse_chunker(bad)


def test_pages(spark):
    df = spark.createDataFrame([("a", 0, "first"), ("a", 1, "second"), ("a", 2, None), ("b", 0, "x")], "document_id string, page_no int, text string")
    rows = {r.document_id: r for r in pages.join_pages(df).collect()}
    assert rows["a"].content == "first\n\nsecond\n\n" and rows["a"].page_starts == [0, 7, 15] and rows["b"].page_count == 1
    one = spark.range(1).select(*[pages.page_of(F.array(F.lit(0), F.lit(3), F.lit(3)), F.lit(o)).alias(f"o{o}") for o in (0, 2, 3, 99)], pages.page_of(F.array().cast("array<int>"), F.lit(1)).alias("none"))
    assert list(one.first()) == [1, 1, 3, 3, None]


def test_sections(spark):
    parts = [" ".join(random.Random(i).choice(["alpha", "beta", "gamma", "delta", "kappa"]) + str(random.Random(i * 99 + j).randint(0, 999)) for j in range(30)) for i in range(3)]
    text = "Contents " + parts[2][:30] + "\n" + "\n\n".join(parts)
    docs = spark.createDataFrame([("d", "p", None, None, None, None, None, text, None, None, None), ("e", "q", None, None, None, None, None, None, None, None, None)], DOCUMENTS)
    sections = spark.createDataFrame([("p", 0, parts[0]), ("p", 1, "never seen anywhere in this document at all"), ("p", 2, parts[1]), ("p", 3, parts[2]), ("p", 4, None)], "paper_id string, section_index int, text string")
    spans = relevance.locate_sections(docs, sections).orderBy("start_char").collect()
    assert [s.section_index for s in spans] == [0, 2, 3] and spans[-1].end_char == len(text)
    assert all(text[s.start_char :].startswith(parts[i]) for s, i in zip(spans, (0, 1, 2)))
    tiles = spark.createDataFrame([("d", i, i * 100, i * 100 + 100, 5) for i in range(3)], "document_id string, section_index int, start_char int, end_char int, probe_hits int")
    cuts = [(10, 50), (80, 120), (50, 250), (0, 100), (400, 500)]
    ch = spark.createDataFrame([(f"c{i}", "d", a, b) for i, (a, b) in enumerate(cuts)], "chunk_id string, document_id string, start_char int, end_char int")
    got = {r.chunk_id: r.section_indices for r in relevance.assign_sections(ch, tiles).collect()}
    assert got == {"c0": [0], "c1": [0, 1], "c2": [0, 1, 2], "c3": [0], "c4": []}
