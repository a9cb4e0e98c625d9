import itertools
import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm import canonical, leakage, sentences, splitting


@pytest.mark.parametrize(
    ("a", "b"),
    [("ﬁne ﬂow", "fine flow"), ("ＡＢ１", "AB1"), ("étude", "étude"), ("ｶﾞｽ", "ガス"), ("a b", "a b"), ("a​b­", "ab"), ("Αthеns", "Athens"), ("νet", "vet"), ("ё", "ë"), ("가", "가"), ("o‍́", "ó")],
)
def test_alike(a, b):
    assert canonical.canonical(a) == canonical.canonical(b)


@pytest.mark.parametrize(("a", "b"), [("A", "a"), ("é", "e"), ("x²", "x2"), ("①", "1"), ("½", "1/2"), ("O", "0"), ("l", "1"), ("a  b", "a b"), ("a\nb", "a b"), ("й", "и")])
def test_different(a, b):
    assert canonical.canonical(a) != canonical.canonical(b)


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"])))
def test_splicing_equals_the_whole_and_is_stable(text):
    whole = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text.translate(canonical._FOLD)).translate(canonical._ALIKE))
    assert canonical.canonical(text) == whole
    assert canonical.canonical(whole) == whole


def test_pairs(spark):
    rows = [(1, "fine"), (2, "ﬁne"), (3, "fine"), (4, " ​"), (5, "  "), (6, None), (7, "ｆine"), (None, "ﬁne"), (2, "ﬁne"), (8, ""), (9, "other")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for hot in (1, 1000):
        got = {tuple(x) for x in canonical.look_alike_pairs(df, hot_rows=hot).collect()}
        assert got == {(1, 2), (2, 3), (1, 7), (3, 7), (2, 7)}
    assert canonical.look_alike_pairs(df.limit(0)).count() == 0
    forms = canonical.canonical_text(df, out_col="text").collect()
    assert len(forms) == len(rows) and forms[5].text is None and forms[1].text == "fine"


def test_classes_say_what_pairs_say(spark):
    rows = [(1, "fine"), (2, "ﬁne"), (3, "fine"), (4, " ​"), (6, None), (7, "ｆine"), (None, "ﬁne"), (2, "ﬁne"), (9, "other"), (10, "other")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("class_id", F.lit("clash"))
    got = {tuple(x) for x in canonical.look_alike_classes(df).collect()}
    assert got == {(1, 1, 1, 3), (3, 1, 1, 3), (2, 1, 2, 3), (7, 1, 7, 3)}
    pairs = {(a[0], b[0]) for a in got for b in got if a[0] < b[0] and a[1] == b[1] and a[2] != b[2]}
    assert pairs == {tuple(x) for x in canonical.look_alike_pairs(df).collect()}
    assert canonical.look_alike_classes(df.limit(0)).count() == 0


def brute_leaks(docs, items, span):
    out = set()
    for d, t in docs:
        w = leakage.words(t or "")
        for i, x in items:
            v = leakage.words(x or "")
            n = min(span, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            if any(tuple(w[k : k + n]) in grams for k in range(len(w) - n + 1)):
                out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark):
    r = random.Random(1)
    vocabulary = ["alpha", "beta", "Gamma", "δ", "5", "ﬁn"]
    text = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", ",", "."]) for _ in range(n))
    items = [(f"i{k}", text(r.randint(1, 20))) for k in range(30)] + [("e", ""), ("n", None), ("i0", None), ("p", "...")]
    docs = [(k, text(r.randint(0, 40)) + " " + r.choice(items[:30])[1] + " " + text(3)) for k in range(60)] + [(97, None), (98, ""), (99, "?!")]
    got = leakage.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string"))
    assert {tuple(x) for x in got.collect()} == brute_leaks(docs, items, 12)
    empty = spark.createDataFrame([], "item_id string, text string")
    assert leakage.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), empty).count() == 0


def test_leaks_of_texts_that_repeat_themselves(spark):
    r = random.Random(11)
    phrase = lambda n: [r.choice("ab") for _ in range(n)]
    texts = [phrase(r.randint(0, 6)) + phrase(r.randint(1, 4)) * r.randint(1, 60) + phrase(r.randint(0, 14)) for _ in range(160)]
    docs = [(i, " ".join(w)) for i, w in enumerate(texts)] + [(999, "a " * 300_000)]
    items = [(f"i{k}", " ".join(phrase(r.randint(0, 5)) + phrase(r.randint(1, 3)) * r.randint(1, 12) + phrase(r.randint(0, 8)))) for k in range(60)] + [("long", "a " * 500)]
    got = leakage.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string"))
    found = {tuple(x) for x in got.collect()}
    assert {x for x in found if x[0] != 999} == brute_leaks(docs[:-1], items, 12) and (999, "long") in found


def test_words_of_many_texts_hash_like_those_of_one():
    texts = [leakage.folded(t) for t in ("One two, ONE!", "", "two\none", "…", "ʼn 二 x²")]
    text, hashes = leakage.word_hashes(texts)
    names = [(i, w) for i, t in enumerate(texts) for w in leakage.WORD.findall(t)]
    assert [i for i, _ in names] == text.tolist()
    by = {}
    for (_, w), h in zip(names, hashes.tolist()):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


def test_runs_are_extended_from_a_hit():
    doc, item = "a b c d e f".split(), "x b c d e y".split()
    assert leakage.shared_run(doc, item, 3, 3, 9) == 4 and leakage.shared_run(doc, item, 3, 3, 2) == 2 and leakage.shared_run(doc, item, 0, 0, 3) == 0


def test_winnowing_keeps_a_hash_of_every_long_enough_run():
    r = random.Random(2)
    for _ in range(50):
        text, one = leakage.word_hashes([" ".join(str(r.randint(0, 9)) for _ in range(60))])
        h = leakage.gram_hashes(one, 8)
        assert len(h) == 53 and not text.any()
        kept = set(leakage.winnow(h, 5))
        assert all(kept & set(range(a, a + 5)) for a in range(len(h) - 4))


def slow_pieces(t, limit, least, overlap):
    blank, s, out = " \t\r\n", 0, []
    while len(t) - s > limit:
        tests = (lambda e: t[e - 2 : e] == "\n\n", lambda e: t[e - 2] in ".?!" and t[e - 1] in blank or t[e - 1] in "。！？।؟", lambda e: t[e - 1] in blank, lambda e: e == s + limit)
        e = next(e for f in tests for e in range(s + limit, s + least, -1) if f(e))
        out.append((s, e))
        s = next((q for q in range(e - overlap, e) if q and t[q - 1] in blank and t[q] not in blank), e - overlap)
    return [*out, (s, len(t))] if t else []


def test_pieces_equal_the_rule():
    r = random.Random(4)
    for _ in range(200):
        t = "".join(r.choice(["a", "bc", " ", "\n", "\n\n", ". ", "。", "x" * 30, "\t"]) for _ in range(r.randint(0, 300)))
        assert splitting.piece_spans(t, 120, 60, 15) == slow_pieces(t, 120, 60, 15)


def test_sections_come_before_paragraphs():
    t = "a " * 40 + "\n\n" + "b " * 10 + "\n# Next\n\n" + "c " * 60
    spans = splitting.piece_spans(t, 120, 60, 15, section=r"(?m)^# ")
    assert t[: spans[0][1]].endswith("b \n") and t[spans[0][1] :].startswith("# Next") and splitting.piece_spans(t, 120, 60, 15)[0][1] != spans[0][1]


def test_split_edges(spark):
    long = "word " * 500
    df = spark.createDataFrame([("a", long), ("a", long), ("b", "short"), ("c", ""), ("d", None), (None, "z" * 1300)], "document_id string, content string").selectExpr("*", "1 as start_char")
    got = splitting.split_oversized(df)
    assert got.filter("document_id = 'a'").count() == len(splitting.piece_spans(long))
    assert {x.document_id for x in got.collect()} == {"a", None}
    assert splitting.split_oversized(df, only_oversized=False).filter("document_id = 'b'").count() == 1
    assert splitting.split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(df, limit=10, overlap=10)


ENGLISH = ["The first value rose by 3.5 points.", "Dr. A. Smith saw it.", "Was it so?", "“Stop. Look again.” was printed there.", "We saw Fig. 4 and Sec. 12 for it.", "It fell (cf. Sec. 3, approx. 0.5) again.", "Then it ended."]
CHINESE = ["我们发现结果。", "“可靠吗？”他问道。", "此外，它改善了。"]
LAO = ["ພວກເຮົາພົບຜົນ", "ຄ່ານີ້ຫຼຸດລົງ"]
THAI = ["เราพบว่าดัชนีลดผลลัพธ์", "ค่า 18.80 หน่วยหมายถึงตัวอย่าง", "ทีมงานใช้ Sundavar ช่วยอธิบาย"]


def test_sentences_of_many_scripts(spark):
    r = random.Random(6)
    rows, truth = [], set()
    for k in range(300):
        parts, at = [], 0
        for _ in range(r.randint(1, 4)):
            kind, gap = r.choice([(ENGLISH, " "), (CHINESE, ""), (THAI, " "), (LAO, " ")])
            for i in range(n := r.randint(1, 4)):
                s = r.choice(kind)
                truth.add((f"d{k}", at, at + len(s)))
                g = gap if i < n - 1 else "\n\n"
                g = "\n" if g == " " and r.random() < 0.2 else g
                parts.append(s + g)
                at += len(s) + len(g)
        rows.append((f"d{k}", "".join(parts)))
    extra = [("n", None), ("e", ""), ("b", " \n "), rows[0], (None, "One line"), ("u", "x" * 20_000)]
    df = spark.createDataFrame(rows + extra, "document_id string, content string")
    got = {tuple(x) for x in sentences.split_sentences(df).collect()}
    both = len(got & truth)
    assert both / len(truth) > 0.97 and both / len(got) > 0.97
    assert (None, 0, 8) in got and ("u", 0, 20_000) in got and not {"n", "e", "b"} & {x[0] for x in got}
    texts = {a: b for a, b in rows}
    for key in list(texts)[:50]:
        spans = sorted(x[1:] for x in got if x[0] == key)
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
        left = "".join(texts[key][b:c] for (_, b), (c, _) in zip([(0, 0), *spans], [*spans, (len(texts[key]), 0)]))
        assert not left.strip() and all(texts[key][a:b] == texts[key][a:b].strip() for a, b in spans)
    assert sentences.split_sentences(df.limit(0)).count() == 0


def test_blank_lines_and_pairs_bound_sentences():
    model = sentences.Model([])
    spans = lambda t: [t[a:b] for a, b in sentences.sentence_spans(t, model)]
    assert spans("1.2 Methods\r\n\r\nA title\nover lines\n \n(a) An item") == ["1.2 Methods", "A title\nover lines", "(a) An item"]
    words = sentences.analyse(["(One thing. Two.) “A? B!” said."])[0].words
    assert words[:, 1].tolist() == [sentences.word_hash(w, sentences.SHAPES["<mark>"]) for w in (".)", "!”")]


def test_sums_of_sentences_show_faults(spark):
    df = spark.createDataFrame([("a", "One two. Three"), ("a", "One two. Three"), ("b", " "), ("c", None)], "document_id string, content string")
    spans = lambda *x: spark.createDataFrame([("a", *p) for p in x], "document_id string, start_char int, end_char int")
    sums = lambda *x: [tuple(r) for r in sentences.sentence_sums(df, spans(*x)).collect()]
    assert sums((0, 8), (9, 14)) == [("a", 11, 0, 0)] and sums((0, 9), (7, 14)) == [("a", 11, 1, 1)]
    assert [tuple(r) for r in sentences.sentence_sums(df, sentences.split_sentences(df)).collect()] == [("a", 11, 0, 0)]


def test_tokens():
    def words(text):
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        t = sentences.tokenize(codes, np.array([0]), np.array([len(text)]))
        return [text[a:b] for a, b in zip(t.start.tolist(), t.end.tolist())]

    assert words("It's 3.5, vari-\nable x... a²") == ["It's", "3.5", ",", "vari-\nable", "x", "...", "a", "²"]
    assert words("汉字学 abc汉字 'tis 1.2.3. 5:") == ["汉字", "学", "abc汉字", "'", "tis", "1.2.3", ".", "5", ":"]
    assert words("ภาษาไทยดี x-\r\n汉d") == ["ภาษา", "ไทยดี", "x-\r\n汉d"] and words("") == []


def test_texts_are_analysed_alike_alone_and_together():
    r = random.Random(9)
    pieces = [*ENGLISH, *CHINESE, *THAI, "\n\n", " \n", "(a) ", "“", "”", "(", ")", "'", "... ", "-\n", "x", "۔ ", "ບົດຄວາມ ", "። "]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 12))) for _ in range(300)]
    for together, text in zip(sentences.analyse(texts), texts):
        assert all(np.array_equal(a, b) for a, b in zip(together, sentences.analyse([text])[0]))


def test_words_are_known_by_hash_and_shape():
    names = lambda t: sentences.analyse([t])[0].words[0].tolist()
    h = lambda w, s: sentences.word_hash(w, sentences.SHAPES[s])
    assert names("Two vari-\nables. Then A") == [h("variables", "<xx>"), h(".", "<mark>"), h("Then", "<Xx>"), h("A", "<X>")]
    assert names("at 5... NASA: 3") == [sentences.SHAPES["<num>"], h("…", "<mark>"), h("NASA", "<XX>"), h(":", "<mark>")]
    assert names("x? 学会") == [h("x", "<x>"), h("?", "<mark>"), h("学会", "<other>"), 0]


def test_counts_are_found_by_key():
    r = np.random.default_rng(3)
    keys = np.unique(r.integers(0, 1 << 62, 5000))
    table = sentences.Counts(keys, np.arange(len(keys)) + 1.0)
    asked = np.concatenate([keys[::-1], r.integers(0, 1 << 62, 1000)])
    wanted = {k: i + 1.0 for i, k in enumerate(keys.tolist())}
    assert table[asked].tolist() == [wanted.get(k, 0.0) for k in asked.tolist()]
    assert sentences.Counts(np.empty(0, np.int64), np.empty(0))[np.array([[5]])].tolist() == [[0.0]]


def walk_by_hand(model, q):
    """Posteriors of one chain by all ways to place boundaries."""
    n, total, yes = len(q.u), 0.0, np.zeros(len(q.u))
    p = lambda *w: float(model.prob(*w))
    for events in itertools.product((0, 1), repeat=n):
        m, e = 1.0, [(sentences.STAY, sentences.CUT)[x] for x in events]
        for k in range(n):
            before = e[k - 1] if q.link[k] & 1 else q.u[k]
            m *= p(before, q.v[k], e[k]) * p(int(model.plain[q.v[k]]), e[k], q.x[k]) * (q.seed[k] if events[k] else 1 - q.seed[k]) ** model.trust
            m *= 1.0 if q.link[k] & 2 else p(e[k], q.x[k], q.y[k])
        total += m
        yes += m * np.array(events)
    return yes / total


def test_posteriors_equal_all_ways_to_place_boundaries():
    texts = ["Go. No. So it is. Ja! Ok? We saw p. 4 of Sec. A. B. Then.", "A. B. C. D.", "One. Two."]
    r = np.random.default_rng(4)
    model = sentences.Model(np.unique([w for q in sentences.analyse(texts) for w in q.words.ravel() if w > 15 or w < 0]))
    for text in texts:
        q = sentences.analyse([text])[0]
        e = model.encoded(q.words, q.cues, q.edges)
        for _ in range(2):
            assert np.allclose(model.posteriors(e), walk_by_hand(model, e))
            keys, counts = model.expected(e, model.posteriors(e))
            model = sentences.Model(model.words, keys, counts * r.uniform(0.5, 2.0, len(keys)))


@pytest.mark.parametrize(("text", "sentences_"), [("(a. b.) " * 20_000, 20_000), ("((" * 50_000, 1), ("„x? " * 20_000, 20_000), ("a" * 200_000, 1)])
def test_very_long_texts(text, sentences_):
    spans = sentences.sentence_spans(text, sentences.Model([]))
    assert len(spans) == sentences_ and spans[-1][1] == len(text.rstrip())
    assert canonical.canonical(text) == text and splitting.piece_spans(text)[-1][1] == len(text)


def test_a_bound_keeps_part_of_the_words_seen_equally_often(spark):
    counts = spark.createDataFrame([(f"w{i}", 1.0) for i in range(9)] + [("often", 8.0)], "key string, n double")
    kept = lambda limit: {r.key for r in sentences._most_frequent(counts, limit).collect()}
    assert kept(4) == {"often", "w0", "w1", "w2"} and kept(1) == {"often"} and len(kept(10)) == 10
