"""One form for texts that look the same.

Texts are scanned for characters that the form may change or that may combine with
a neighbour (the quick-check properties of Unicode normalization, and the folds
below). Only these runs, each with the character before it, are normalized; the
results are spliced into the rest, which stays as it is.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cluster import arrow_map, hot_keys, small, stage

# Letters of Cyrillic and Greek that look like a Latin letter.
LOOK_ALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТХҮԚԜΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿаеѕіјорсухԁһԛԝӏνοϲϳ",
        "ABESIJKMHOPCTXYQWABEZHIKMNOPTYXCJaesijopcyxdhqwlvocj",
        strict=True,
    )
)
# Format characters that are visible, and fillers that are not.
VISIBLE_FORMATS = set("؀؁؂؃؄؅۝܏࣢")
FILLERS = set("͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ")
KEPT_CONTROLS = set("\t\n\v\f\r\x85")


def _fold(ch: str) -> str:
    """What ``ch`` stands for, apart from accents and look-alikes: itself, other characters or nothing."""
    category = unicodedata.category(ch)
    if category == "Zs":
        return " "
    if ch in FILLERS or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef":
        return ""
    if category == "Cf" and ch not in VISIBLE_FORMATS or category == "Cc" and ch not in KEPT_CONTROLS:
        return ""
    kind, _, parts = unicodedata.decomposition(ch).partition(" ")
    if not kind.startswith("<"):
        return ch
    target = "".join(chr(int(x, 16)) for x in parts.split())
    joined = len(target) > 1 and kind in ("<compat>", "<isolated>", "<initial>", "<medial>", "<final>") and "LIGATURE" in unicodedata.name(ch, "")
    digraph = kind == "<compat>" and len(target) == 2 and target.isalpha() and unicodedata.name(ch, "").startswith("LATIN")
    if kind in ("<wide>", "<narrow>", "<noBreak>") or joined or digraph:
        return "".join(map(_fold, target))
    return ch


def _tables() -> tuple[dict[int, str], str]:
    """The fold of every character it changes; a pattern class of all unstable characters."""
    fold: dict[int, str] = {}
    unstable: list[int] = []
    seconds = set()
    scanned = [*range(0x323B0), *range(0xE0000, 0xE1000)]
    for c in scanned:
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            seconds.add(int(parts[1], 16))
    jamo = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    for c in scanned:
        ch = chr(c)
        if 0xD800 <= c < 0xE000 or 0xAC00 <= c < 0xD7A4:
            continue
        folded = _fold(ch)
        if folded != ch:
            fold[c] = folded
        form = unicodedata.normalize("NFC", ch)
        whole = unicodedata.normalize("NFC", "".join(LOOK_ALIKES.get(x, x) for x in unicodedata.normalize("NFD", folded)))
        if whole != ch or form != ch or unicodedata.combining(ch) or c in seconds or c in jamo:
            unstable.append(c)
    ranges, start = [], None
    within = [c for c in unstable if c <= 0xFFFF]
    for a, b in zip(within, [*within[1:], sys.maxunicode]):
        start = a if start is None else start
        if b != a + 1:
            ranges.append(f"\\u{start:04x}-\\u{a:04x}")
            start = None
    # Characters beyond the basic plane are rare: all count as unstable, and the class stays one table.
    return fold, "".join(ranges) + "\\U00010000-\\U0010ffff"


_FOLD, _CLASS = _tables()
_ALIKE = {ord(k): v for k, v in LOOK_ALIKES.items()}
#: A run of unstable characters.
UNSTABLE = re.compile(f"[{_CLASS}]+")


@lru_cache(maxsize=100_000)
def _segment(text: str) -> str:
    parts = unicodedata.normalize("NFD", text.translate(_FOLD)).translate(_ALIKE)
    return unicodedata.normalize("NFC", parts)


def canonical(text: str) -> str:
    """The form of ``text``: equal for two texts just when they look the same.

    One form have: full- and half-width and ordinary characters, composed and
    combining accents, ligatures and their letters, all spaces of one width or
    another, look-alike letters of Latin, Cyrillic and Greek. Invisible characters
    go. Case, accents, superscripts, digits, and numbers of spaces are kept, and
    tabs and line breaks remain different from spaces.
    """
    if text.isascii() and text.isprintable():
        return text
    out, at = [], 0
    for m in UNSTABLE.finditer(text):
        start, end = m.span()
        start -= start > at  # the stable character before may combine with the run
        out.append(text[at:start])
        part = text[start:end]
        out.append(_segment(part) if end - start < 64 else _segment.__wrapped__(part))
        at = end
    out.append(text[at:])
    return "".join(out)


def canonical_text(df: DataFrame, text_col: str = "text", out_col: str = "canonical") -> DataFrame:
    """``df`` with the canonical form of ``text_col`` in ``out_col``; null stays null.

    ``out_col`` replaces a column of that name. All rows are kept.
    """

    @F.pandas_udf("string")
    def form(texts):
        return texts.map(lambda t: None if t is None else canonical(t))

    return df.withColumn(out_col, form(F.col(text_col)))


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def _digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, form, raw``: digests of the canonical form and of the text as it is stored; staged."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, forms, raws = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                form = canonical(text)
                if form.strip():
                    ids.append(key)
                    forms.append(_digest(form))
                    raws.append(_digest(text))
            return pa.record_batch([pa.array(ids, batch.schema.field(0).type), pa.array(forms, pa.binary()), pa.array(raws, pa.binary())], names=["id", "form", "raw"])

        return one

    rows = df.select(id_col, text_col).filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return stage(arrow_map(rows, make, f"id {kind}, form binary, raw binary"))


def _members(digests: DataFrame) -> DataFrame:
    """Rows of ``digests`` whose form is stored in several ways, each once; staged."""
    kinds = digests.select("form", "raw").distinct()
    varied = kinds.groupBy("form").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("form")
    return stage(digests.join(varied, "form", "left_semi").distinct())


def look_alike_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, class_id, stored_id, variants`` of every row that looks like another stored differently.

    ``class_id`` is the least id of all that look the same, ``stored_id`` the least of
    those that are stored alike too, and ``variants`` counts the ways of storing in the
    class: what ``look_alike_pairs`` gives as pairs, in one row a document however many
    copies there are. Null ids and texts, and texts that look blank, have no row.
    """
    members = _members(_digests(df, id_col, text_col))
    stored = members.groupBy("form", "raw").agg(F.min("id").alias("stored_id"))
    classes = stored.groupBy("form").agg(F.min("stored_id").alias("class_id"), F.count(F.lit(1)).alias("variants"))
    named = stage(stored.join(classes, "form").select("form", "raw", "stored_id", "class_id", "variants"))
    return members.join(small(named), ["form", "raw"]).select(F.col("id").alias(id_col), "class_id", "stored_id", "variants")


def look_alike_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = 50_000) -> DataFrame:
    """``(id_col_a, id_col_b)``, smaller first, of rows whose texts look the same but are not stored alike.

    Null texts and texts that look blank take no part, nor do null ids; a repeated
    id with the same text counts once. Rows stored alike are grouped by digest
    before any pairing, so identical copies are never compared with one another;
    large groups are salted on both sides. Where copies are many, see ``look_alike_classes``.
    """
    members = _members(_digests(df, id_col, text_col))

    hot = small(hot_keys(members, ["form", "raw"], hot_rows, "n"))
    salted = members.join(hot, ["form", "raw"], "left").withColumn("salts", F.ceil(F.coalesce("n", F.lit(1)) / hot_rows).cast("int"))
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("id"), "salts").cast("int")).drop("n")
    stored = salted.select("form", "raw", "salts").distinct()
    a, b = stored.alias("a"), stored.alias("b")
    pairs = a.join(b, (F.col("a.form") == F.col("b.form")) & (F.col("a.raw") < F.col("b.raw")))
    pairs = pairs.select("a.form", F.col("a.raw").alias("raw_a"), F.col("b.raw").alias("raw_b"), F.explode(F.sequence(F.lit(0), F.col("a.salts") - 1)).alias("salt_a"), F.col("b.salts").alias("salts_b"))
    pairs = pairs.withColumn("salt_b", F.explode(F.sequence(F.lit(0), F.col("salts_b") - 1)))
    left = salted.select("form", F.col("raw").alias("raw_a"), F.col("salt").alias("salt_a"), F.col("id").alias("x"))
    right = salted.select("form", F.col("raw").alias("raw_b"), F.col("salt").alias("salt_b"), F.col("id").alias("y"))
    found = pairs.join(left, ["form", "raw_a", "salt_a"]).join(right, ["form", "raw_b", "salt_b"]).filter("x <> y")
    return found.select(F.least("x", "y").alias(f"{id_col}_a"), F.greatest("x", "y").alias(f"{id_col}_b")).distinct()
