import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.stem import porter
from skein.functions.tokens import count_tokens, py_token_starts, resolve_overlap
from skein.schema import blank_to_null, source_stem

STEPS = [
    (T.normalize_characters, "ﬁnal classiﬁcation eﬀect", "final classification effect"),
    (T.normalize_characters, "a\x00b\x07c\nd\te", "abc\nd\te"),
    (T.dehyphenate, "real-\ntime movies", "realtime movies"),
    (T.dehyphenate, "dash -\n\nNext paragraph", "dash -\n\nNext paragraph"),
    (T.dehyphenate, "café-\nété", "caféété"),
    (T.reflow, "First para\nwrapped.\n\nSecond para\nwrapped.", "First para wrapped.\n\nSecond para wrapped."),
    (T.reflow, "\n\n  \n\nOnly text.\n\n   ", "Only text."),
    (T.merge_continuations, "a\n\nb\n\nc.\n\nd.", "a b c.\n\nd."),
    (T.merge_continuations, "2 Methods\n\nWe began by.", "2 Methods We began by."),
    (T.clean_text, "The clas-\nsiﬁcation  of  eﬀects\nwas   measured.\n\nA second\nparagraph.", "The classification of effects was measured.\n\nA second paragraph."),
    (T.clean_text, "", ""),
    (T.clean_text, None, None),
    (T.reflow_only, "ﬁnal\nresult", "ﬁnal result"),
    (T.strip_math, "a $x+1$ b \\alpha c <tag> $$y\nz$$", "a   b  c    "),
    (T.normalize_alnum, "Ab-9 é!", "ab9"),
    (blank_to_null, "  \t ", None),
    (blank_to_null, " x ", "x"),
    (source_stem, "dir/2401.00001v1.pdf", "2401.00001v1"),
    (lambda c: T.snippet(c, 5, "..."), " ab  cd ef ", "ab cd..."),
    (lambda c: F.array_join(T.lexical_terms(c), " "), "The a BM25 baseline in 2024, x", "bm25 baseline 2024"),
    (T.config_slug, "fixed_size:512:25%", "fixed_size_512_25pct"),
]


def test_steps(spark):
    for step, given, wanted in STEPS:
        df = spark.createDataFrame([(given,)], "t string")
        assert df.select(step(F.col("t"))).first()[0] == wanted, (given, wanted)


def test_preprocessors():
    assert T.resolve_preprocessor("none") is None and T.resolve_preprocessor(len) is len
    with pytest.raises(ValueError, match="default"):
        T.resolve_preprocessor("nothing")


def test_tokens(spark):
    for t, n in (("", 0), ("a", 1), (" a b ", 3), ("日本 語", 2), (" \n", 1)):
        assert len(py_token_starts(t)) - 1 == n
        assert spark.createDataFrame([(t,)], "t string").select(count_tokens(F.col("t"))).first()[0] == n
    assert resolve_overlap("25%", 512) == 128
    with pytest.raises(ValueError):
        resolve_overlap(8, 8)


def test_porter():
    pairs = "caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration digitizer:digit operator:oper feudalism:feudal hopefulness:hope formaliti:formal triplicate:triplic formative:form electrical:electr goodness:good revival:reviv adjustment:adjust adoption:adopt effective:effect rate:rate cease:ceas controll:control roll:roll"
    for p in pairs.split():
        word, stem = p.split(":")
        assert porter(word) == stem, word
