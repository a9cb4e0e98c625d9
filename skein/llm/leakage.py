"""Evaluation texts inside a corpus, found by winnowed fingerprints.

A document keeps the least k-gram hash of every window of ``span - k + 1`` k-grams,
so any shared run of ``span`` words shares a kept hash with the item, all of whose
k-grams are indexed. Items shorter than ``span`` are looked up by the hash of their
whole word sequence. From every hit the shared run is extended to both sides, on the
words themselves, until it is long enough or a word differs.

Words and k-grams of many documents are hashed at once, in arrays over all their
characters; only a document with a hit is cut into words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cluster import BASE, BLOCK_CHARS, arrow_map, mixed, small, span_hashes, stage
from .canonical import canonical

WORD = regex.compile(r"[\p{L}\p{N}]+")
#: log2 of the least and the most bits of the filter sent to the workers (8 kB, 128 MB).
FILTER_BITS = (16, 30)


def folded(text: str) -> str:
    """``text`` in canonical form and lower case."""
    return canonical(text).lower()


def words(text: str) -> list[str]:
    """The runs of letters and digits of ``text`` in canonical form and lower case."""
    return WORD.findall(folded(text))


@lru_cache(maxsize=1)
def _word_characters() -> np.ndarray:
    """Whether a code point belongs to a word."""
    table = np.zeros(0x110000, dtype=bool)
    for a, b in ((0, 0xD800), (0xE000, 0x110000)):
        for m in WORD.finditer("".join(map(chr, range(a, b)))):
            table[a + m.start() : a + m.end()] = True
    return table


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of every word of the (folded) texts, one text after the other: its text, and its hash."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = np.zeros(len(codes) + 2, dtype=np.int8)
    inside[1:-1] = _word_characters()[codes]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = span_hashes(codes)(starts, ends)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    return np.searchsorted(begins, starts, side="right") - 1, hashes


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k-grams of a sequence of word hashes, in order."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(BASE) + hashes[i : i + n]
    return mixed(out) + np.uint64(k)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each ``window`` consecutive hashes the position of the least (the last such)."""
    if len(hashes) < window:
        return np.empty(0, np.int64)
    least, at = hashes[: len(hashes) - window + 1].copy(), np.arange(len(hashes) - window + 1)
    for i in range(1, window):
        other = hashes[i : i + len(least)]
        less = other <= least
        least[less] = other[less]
        at[less] = np.flatnonzero(less) + i
    return at


def without_repeats(text: np.ndarray, at: np.ndarray, hashes: np.ndarray, reach: int) -> np.ndarray:
    """Which of the kept positions are needed, where texts repeat themselves.

    Equal hashes at equal steps mean words that recur with that period. A run of
    words inside recurs ``reach`` words from its start or end at most, so positions
    farther in are left out: else a text of one word has as many hits as words.
    """
    n = len(at)
    if n < 3:
        return np.ones(n, dtype=bool)
    step = np.diff(at)
    alike = (text[1:] == text[:-1]) & (hashes[1:] == hashes[:-1])
    tied = alike.copy()
    tied[1:] &= ~alike[:-1] | (step[1:] == step[:-1])
    first = np.maximum.accumulate(np.where(np.concatenate([[True], ~tied]), np.arange(n), 0))
    ends = np.where(np.concatenate([~tied, [True]]), np.arange(n), n)
    last = np.minimum.accumulate(ends[::-1])[::-1]
    return (at - at[first] < reach) | (at[last] - at < reach)


def shared_run(doc: list[str], item: list[str], at: int, item_at: int, enough: int) -> int:
    """Equal words of ``doc`` and ``item`` around a hit, counted up to ``enough``."""
    a, b = at, item_at
    while a and b and at - a < enough and doc[a - 1] == item[b - 1]:
        a, b = a - 1, b - 1
    run = 0
    while run < enough and a + run < len(doc) and b + run < len(item) and doc[a + run] == item[b + run]:
        run += 1
    return run


def _key(name: object, text: str) -> bytes:
    return xxhash.xxh3_128_digest(f"{name!r}\0{text}".encode("utf-8", "surrogatepass"))


def _blocks(texts: list[str]):
    """``(start, end)`` of consecutive texts of ``BLOCK_CHARS`` characters together."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > BLOCK_CHARS:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    span: int = 12,
    k: int = 8,
) -> DataFrame:
    """``(doc_id, item_id)`` of every document and item that share ``span`` consecutive
    words, or the item's whole word sequence where it has fewer.

    Null texts and texts without words take no part; null ids are kept as ids;
    repeated rows count once; other columns are ignored.
    """
    if not 1 <= k <= span:
        raise ValueError("1 <= k <= span must hold")
    spark = docs.sparkSession
    doc_kind, item_kind = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()

    def make_items():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, ids, toks, prints = [], [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                form = folded(text)
                w = WORD.findall(form)
                if w:
                    size = k if len(w) >= span else len(w)
                    keys.append(_key(name, form))
                    ids.append(name)
                    toks.append(w)
                    prints.append([(int(h), i) for i, h in enumerate(gram_hashes(word_hashes([form])[1], size).astype(np.int64))])
            return pa.record_batch(
                [pa.array(keys, pa.binary()), pa.array(ids, batch.schema.field(0).type), pa.array(toks, pa.list_(pa.string())), pa.array([[{"hash": h, "item_at": i} for h, i in p] for p in prints], pa.list_(pa.struct([("hash", pa.int64()), ("item_at", pa.int32())])))],
                names=["item_key", "item", "item_words", "prints"],
            )

        return one

    rows = items.select(item_id, item_text).filter(F.col(item_text).isNotNull()).distinct()
    known = stage(arrow_map(rows, make_items, f"item_key binary, item {item_kind}, item_words array<string>, prints array<struct<hash:bigint,item_at:int>>"))
    prints = stage(known.select("item_key", F.inline("prints")))
    size = F.size("item_words")
    lengths = known.filter(size < span).select(size.alias("n")).distinct()
    # Whole items must be met without winnowing; at most `span` lengths.
    short = sorted({r.n for r in lengths.collect()} | ({k} if k == span else set()))
    # Of 256 bits a hash or more, each sets two: short items are looked up at every word.
    bits = int(np.clip(np.ceil(np.log2(256 * max(prints.count(), 1))), *FILTER_BITS))
    low = prints.select(F.explode(F.array(*[F.shiftrightunsigned("hash", n).bitwiseAND((1 << bits) - 1) for n in (0, 32)])).alias("b"))
    low = low.groupBy(F.shiftright("b", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 31 AS int)))").alias("m")).toArrow()  # no more than the filter
    mask = np.zeros(1 << (bits - 5), np.uint32)
    mask[low.column("w").to_numpy()] = low.column("m").to_numpy().astype(np.uint32)
    shared = spark.sparkContext.broadcast(mask)

    def make_docs():
        table = shared.value

        def seen(h: np.ndarray) -> np.ndarray:
            good = np.ones(len(h), dtype=bool)
            for n in (0, 32):
                own = (h >> np.uint64(n)) & np.uint64((1 << bits) - 1)
                good &= (table[(own >> np.uint64(5)).astype(np.int64)] >> (own & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
            return good

        def found(forms: list[str]):
            """Text, word within the text and hash of every kept k-gram that an item may have."""
            text, hashes = word_hashes(forms)
            first = np.searchsorted(text, np.arange(len(forms)))
            out = []
            for length, window in ((k, span - k + 1), *((n, 1) for n in short)):
                grams = gram_hashes(hashes, length)
                at = winnow(grams, window)
                at = at[text[: len(at)] == text[length + window - 2 :][: len(at)]]
                at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at  # positions only ascend
                at = at[seen(grams[at])]
                if window > 1:
                    at = at[without_repeats(text[at], at, grams[at], span + k)]
                else:  # a whole item: one place of each in a text will do
                    at = at[np.sort(np.unique(np.stack([text[at].astype(np.uint64), grams[at]]), axis=1, return_index=True)[1])] if len(at) else at
                out.append((text[at], at - first[text[at]], grams[at]))
            return (np.concatenate(x) for x in zip(*out))

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, forms = batch.column(0).to_pylist(), [folded(t) for t in batch.column(1).to_pylist()]
            keys, ids, toks, hits = [], [], [], []
            for a, b in _blocks(forms):
                text, at, hashes = found(forms[a:b])
                order = np.argsort(text, kind="stable")
                text, at, hashes = text[order], at[order], hashes[order].astype(np.int64)
                own, starts = np.unique(text, return_index=True)
                for t, x, y in zip(own.tolist(), starts, [*starts[1:], len(text)]):
                    keys.append(_key(names[a + t], forms[a + t]))
                    ids.append(names[a + t])
                    toks.append(WORD.findall(forms[a + t]))
                    hits.append([{"hash": h, "at": i} for h, i in zip(hashes[x:y].tolist(), at[x:y].tolist())])
            return pa.record_batch([pa.array(keys, pa.binary()), pa.array(ids, batch.schema.field(0).type), pa.array(toks, pa.list_(pa.string())), pa.array(hits, pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32())])))], names=["doc_key", "doc", "doc_words", "hits"])

        return one

    texts = docs.select(doc_id, doc_text).filter(F.col(doc_text).isNotNull())
    hit = stage(arrow_map(texts, make_docs, f"doc_key binary, doc {doc_kind}, doc_words array<string>, hits array<struct<hash:bigint,at:int>>"))

    def make_check():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = [batch.column(c).to_pylist() for c in ("doc_words", "item_words", "places")]
            good = [any(shared_run(d, i, p["at"], p["item_at"], min(span, len(i))) >= min(span, len(i)) for p in places) for d, i, places in zip(*own)]
            rows = pa.array(np.flatnonzero(good))
            return pa.record_batch([batch.column("doc").take(rows), batch.column("item").take(rows)], names=["doc", "item"])

        return one

    # The texts join once a pair, after its hits have been put together.
    met = hit.select("doc_key", F.inline("hits")).join(small(prints), "hash").groupBy("doc_key", "item_key").agg(F.collect_set(F.struct("at", "item_at")).alias("places"))
    once = hit.select("doc_key", "doc", "doc_words").dropDuplicates(["doc_key"])
    pairs = met.join(once, "doc_key").join(small(known.select("item_key", "item", "item_words").dropDuplicates(["item_key"])), "item_key")
    checked = arrow_map(pairs.select("doc", "doc_words", "item", "item_words", "places"), make_check, f"doc {doc_kind}, item {item_kind}").distinct()
    return checked.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id))


def held_out(items: DataFrame) -> DataFrame:
    """The items whose ``split`` is test or validation."""
    return items.filter(F.col("split").isin("test", "validation"))
