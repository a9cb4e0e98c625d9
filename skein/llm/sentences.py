"""Sentence boundaries in any script, by a hidden-event n-gram language model.

Between two words there may be a hidden event, the boundary. A trigram model over
words, marks and boundaries is trained on the texts themselves: blank lines give
certain boundaries, surface cues give first guesses for the rest, and expected
counts of a few forward-backward passes over all texts replace the guesses. The
same forward-backward posteriors then decide. The hidden event has two values,
boundary and none, which stand in the stream of words alike, so that the words
after it are weighed under equal histories. It can occur only where the writing
system admits a boundary: after a closing mark (with the quotes and brackets
that belong to it), or at a space within a script that has no such marks. Nothing
inside a quotation or a bracket is a boundary.

Every text is read once. Many texts are cut into tokens together, in arrays over
their characters; what is kept of them are the words around the possible boundaries,
from which the passes and the decision work.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import once
from ._cluster import BASE, mixed, parts_for, span_hashes, stage

# Marks that may end a sentence; those that do so without white space;
# pairs of quotes and brackets; marks that a sentence doesn't start with.
ENDERS = set(".?!…。！？।॥؟｡．۔։።፧។៕။།᠃")
SOLID_ENDERS = set("。！？।॥؟｡።፧។៕။།")
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "「": "」", "『": "』", "《": "》", "〈": "〉", "【": "】", "“": "”", "‘": "’", "«": "»", "„": "“", "‚": "‘", "‹": "›"}
STRAIGHT = {'"', "'"}
DASHES = set("—–-")
NEVER_FIRST = set(",;:、，；،؛)]}")
ROUND = set("(（[")

BLANK_LINE = regex.compile(r"(?:\r\n|[\n\r\x85 ])[^\S\n\r\x85  ]*(?:\r\n|[\n\r\x85 ])\s*|\s* \s*")
LIST_MARK = regex.compile(r"\s*(?:\(?\p{Nd}{1,3}(?:\.\p{Nd}{1,3})*[.)]|\(?\p{L}[.)]|\([ivxlc]+\)|[•‣◦*–-])(?=\s)")
WRAP = regex.compile(r"-(?:\r\n|\r|\n)")

# Symbols of the model: the paragraph's edge, the two values of the hidden event, the
# shapes of rare words, then words.
EDGE, CUT, STAY = 0, 1, 2
SHAPES = {"<num>": 3, "<Xx>": 4, "<X>": 5, "<xx>": 6, "<x>": 7, "<XX>": 8, "<other>": 9, "<mark>": 10, "<end>": 11}
FIRST_WORD = 12
#: Weight of uncertain surface cues in the first counts, which certain ones shall lead.
UNSURE = 0.1
BITS = 21


def paragraphs(text: str) -> list[tuple[int, int]]:
    """``(start, end)`` of the parts of ``text`` between blank lines, without outer white space."""
    spans, at = [], 0
    for m in [*BLANK_LINE.finditer(text), None]:
        end = m.start() if m else len(text)
        part = text[at:end]
        a, b = at + len(part) - len(part.lstrip()), end - len(part) + len(part.rstrip())
        if a < b:
            spans.append((a, b))
        at = m.end() if m else end
    return spans


# --- characters ------------------------------------------------------------------------

SPACE, HAN, SOUTH, DIGIT, LETTER, MARK, NONE = range(7)
_SCANNED, _CASED = 0x33500, 0x1F200


@lru_cache(maxsize=1)
def _tables() -> dict[str, np.ndarray]:
    """By code point: its class, and what else the rules ask of a character.

    HAN are characters of scripts without spaces between words, SOUTH those whose
    spaces part sentences or phrases, LETTER other letters and marks that combine.
    """
    kinds = np.full(0x110000, MARK, dtype=np.uint8)
    letters = np.zeros(0x110000, dtype=bool)
    both = np.zeros(0x110000, dtype=bool)

    def fill(table: np.ndarray, value: int, pattern: str) -> None:
        p = regex.compile(pattern, regex.V1)
        for a, b in ((0, 0xD800), (0xE000, _SCANNED), (0xE0000, 0xE0200)):
            for m in p.finditer("".join(map(chr, range(a, b)))):
                table[a + m.start() : a + m.end()] = value

    fill(kinds, NONE, r"\w+")
    fill(kinds, MARK, r"[\p{N}_]+")
    fill(kinds, LETTER, r"[\p{L}\p{M}]+")
    fill(kinds, DIGIT, r"\p{Nd}+")
    fill(kinds, SOUTH, r"[[\p{Thai}\p{Lao}]--\p{Nd}]+")
    fill(kinds, HAN, r"[\p{Han}\p{Hiragana}\p{Katakana}ー々]+")
    fill(kinds, SPACE, r"\s+")
    fill(both, 1, r"[\p{L}\p{M}]+")
    fill(letters, 1, r"\p{L}+")
    out = {"kind": kinds, "letter": letters, "joins": both}
    for name in ("islower", "isupper", "isalpha", "isnumeric"):
        table = np.zeros(0x110000, dtype=bool)
        table[:_CASED] = list(map(getattr(str, name), map(chr, range(_CASED))))
        table[_CASED:_SCANNED] = letters[_CASED:_SCANNED] & (name == "isalpha")  # no case beyond
        out[name] = table
    for name, chars in (("ender", ENDERS), ("solid", SOLID_ENDERS), ("opens", set(PAIRS)), ("dash", DASHES), ("straight", STRAIGHT), ("never", NEVER_FIRST), ("round", ROUND), ("free", set("¿¡—")), ("paired", set(PAIRS) | set(PAIRS.values()) | STRAIGHT | {"’"}), ("colon", set(":："))):
        table = np.zeros(0x110000, dtype=bool)
        table[[ord(c) for c in chars]] = True
        out[name] = table
    return out


class Tokens(NamedTuple):
    """Tokens of a block of texts: where they stand, their kinds, the lengths of their names, and their paragraphs."""

    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    length: np.ndarray
    wrapped: np.ndarray
    paragraph: np.ndarray


WORD_KIND, NUMBER_KIND, MARK_KIND, HAN_KIND, FIRST_PART, LAST_PART = range(6)


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate([[0], flag.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _chains(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each chain, where ``linked[i]`` ties ``i`` to ``i + 1``."""
    if not len(linked):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    tied = linked.copy()
    tied[-1] = False
    return np.flatnonzero(~np.concatenate([[False], tied[:-1]])), np.flatnonzero(~tied)


def tokenize(codes: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> Tokens:
    """Tokens of the paragraphs ``[begins, stops)`` of a block of code points.

    A word is a run of letters, going on behind an apostrophe or a hyphen at a line
    end; scripts without spaces give pairs of characters; a run of a SOUTH script
    gives its first and its last four characters; a number may have marks inside; every
    other character but white space is a token, and two dots or more are one.
    """
    t = _tables()
    kind = t["kind"][codes]
    where = np.zeros(len(codes) + 1, dtype=np.int32)
    where[begins] += 1
    where[stops] -= 1
    kind[np.cumsum(where[:-1]) == 0] = SPACE
    at = lambda i: codes[np.minimum(i, len(codes) - 1)]
    inside = lambda i: (i < len(codes)) & (kind[np.minimum(i, len(codes) - 1)] != SPACE)

    # Words: runs of letters from the first LETTER on, or all of a run that a joint ties to a word before.
    joins = t["joins"][codes] & (kind != SPACE)
    a, b = _runs(joins)
    positions = np.flatnonzero((kind == LETTER) & joins)
    first = positions[np.minimum(np.searchsorted(positions, a), len(positions) - 1)] if len(positions) else np.full(len(a), len(codes))
    own = (first >= a) & (first < b)
    gap = np.concatenate([a[1:], [len(codes) + 9]]) - b if len(a) else np.empty(0, np.int64)
    c0, c1, c2 = at(b), at(b + 1), at(b + 2)
    line = ((gap == 2) & ((c1 == 10) | (c1 == 13))) | ((gap == 3) & (c1 == 13) & (c2 == 10))
    hyphen = (c0 == ord("-")) & line
    mark = ((c0 == ord("'")) | (c0 == 0x2019)) & (gap == 1) & t["letter"][c1] & inside(b + 1)
    paragraph = np.searchsorted(begins, a, side="right")
    tie = (hyphen | mark) & (paragraph == np.concatenate([paragraph[1:], [-1]])) if len(a) else np.empty(0, bool)
    whole = np.zeros(len(a), dtype=bool)
    while True:
        more = np.concatenate([[False], (tie & (own | whole))[:-1]]) if len(a) else whole
        if (more == whole).all():
            break
        whole = more
    word = own | whole
    tie = tie & word
    begin_word = np.where(whole, a, first)
    taken = np.zeros(len(codes) + 1, dtype=np.int32)
    taken[begin_word[word]] += 1
    taken[b[word]] -= 1
    is_word = np.cumsum(taken[:-1]) > 0
    index = np.flatnonzero(word)
    heads, tails = _chains(tie[index])
    w_start, w_end = begin_word[index][heads], b[index][tails]
    lost = np.concatenate([[0], np.cumsum(np.where(hyphen & tie, gap, 0)[index])])
    w_lost = lost[tails] - lost[heads]  # the last of a chain ties nothing

    # Numbers.
    a, b = _runs(kind == DIGIT)
    linked = (np.concatenate([a[1:], [len(codes) + 9]]) - b == 1) & np.isin(at(b), [ord(c) for c in ".,:"]) if len(a) else np.empty(0, bool)
    if len(a):
        paragraph = np.searchsorted(begins, a, side="right")
        linked &= paragraph == np.concatenate([paragraph[1:], [-1]])
    heads, tails = _chains(linked)
    n_start, n_end = a[heads], b[tails]
    inner = np.zeros(len(codes), dtype=bool)
    inner[b[linked]] = True

    # Characters of words, their joints included, are no marks.
    joint = np.zeros(len(codes) + 1, dtype=np.int32)
    joint[w_start] += 1
    joint[w_end] -= 1
    in_word = np.cumsum(joint[:-1]) > 0

    # Scripts without spaces between words, in pairs from the start of a run.
    a, b = _runs((kind == HAN) & ~is_word)
    pairs = (b - a + 1) // 2
    h_start = np.repeat(a, pairs) + 2 * (np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs))
    h_end = np.minimum(h_start + 2, np.repeat(b, pairs))

    # Scripts whose spaces part sentences: the two ends of a run.
    a, b = _runs((kind == SOUTH) & ~is_word)
    cut = np.minimum(b, a + 4)

    # Marks.
    plain = (kind == MARK) & ~in_word & ~inner
    dot = plain & (codes == ord("."))
    d_start, d_end = _runs(dot)
    several = d_end - d_start > 1
    single = plain & ~dot
    single[d_start[~several]] = True
    m_start = np.flatnonzero(single)
    d_start, d_end = d_start[several], d_end[several]

    starts = np.concatenate([w_start, n_start, h_start, a, cut, m_start, d_start])
    ends = np.concatenate([w_end, n_end, h_end, cut, b, m_start + 1, d_end])
    sizes = [len(x) for x in (w_start, n_start, h_start, a, cut, m_start, d_start)]
    kinds = np.repeat(np.array([WORD_KIND, NUMBER_KIND, HAN_KIND, FIRST_PART, LAST_PART, MARK_KIND, MARK_KIND], dtype=np.int8), sizes)
    lengths = np.concatenate([w_end - w_start - w_lost, n_end - n_start, h_end - h_start, cut - a + 1, np.minimum(b - a, 4) + 1, np.ones(len(m_start) + len(d_start), np.int64)])
    wrapped = np.concatenate([w_lost > 0, np.zeros(len(starts) - len(w_start), bool)])
    order = np.lexsort((kinds, starts))
    starts, ends, kinds = starts[order], ends[order], kinds[order]
    return Tokens(starts, ends, kinds, lengths[order], wrapped[order], np.searchsorted(begins, np.minimum(starts, ends - (ends > starts)), side="right") - 1)


def _closings(codes: np.ndarray, t: Tokens) -> np.ndarray:
    """By token, the opening quote or bracket that it closes, or -1."""
    closes = np.full(len(t.start), -1, dtype=np.int64)
    tables = _tables()
    char = codes[t.start.clip(max=len(codes) - 1)]
    single = (t.kind == MARK_KIND) & (t.end - t.start == 1)
    picked = np.flatnonzero(single & tables["paired"][char])
    if not len(picked):
        return closes
    n = len(t.start)
    before, after = np.maximum(picked - 1, 0), np.minimum(picked + 1, n - 1)
    left = (picked > 0) & (t.paragraph[before] == t.paragraph[picked]) & (t.end[before] == t.start[picked])
    right = (picked + 1 < n) & (t.paragraph[after] == t.paragraph[picked]) & (t.start[after] == t.end[picked])
    word_right = right & (t.kind[after] == WORD_KIND)
    after_word = left & np.isin(t.kind[before], (WORD_KIND, NUMBER_KIND))
    stack: list[tuple[int, str]] = []
    waiting: dict[str, int] = {}
    current = -1
    for i, c, p, gl, gr, wr, aw in zip(picked.tolist(), map(chr, char[picked].tolist()), t.paragraph[picked].tolist(), left.tolist(), right.tolist(), word_right.tolist(), after_word.tolist()):
        if p != current:
            stack, waiting, current = [], {}, p
        if c in STRAIGHT or c == "’":
            shut = waiting.get(c) and (gl or not gr) and (c != "'" or not wr)
            opening = c in STRAIGHT and gr and not aw
            mate = c
        else:
            shut, opening, mate = waiting.get(c), c in PAIRS, PAIRS.get(c, "")
        if shut:
            while True:
                at, wanted = stack.pop()
                waiting[wanted] -= 1
                if wanted == c:
                    closes[i] = at
                    break
        elif opening:
            stack.append((i, mate))
            waiting[mate] = waiting.get(mate, 0) + 1
    return closes


class Gaps(NamedTuple):
    """The possible boundaries of a block: token before, token where its mark began, first guess."""

    last: np.ndarray
    mark: np.ndarray
    seed: np.ndarray


def _seeds(codes: np.ndarray, t: Tokens, i: np.ndarray, j: np.ndarray, nxt: np.ndarray, lower: np.ndarray, whole: np.ndarray, announced: np.ndarray) -> np.ndarray:
    """First guesses of the probability of a boundary, from the surface alone: case, lengths, marks."""
    tables = _tables()
    char = codes[t.start[i].clip(max=len(codes) - 1)]
    alone = i == j
    has = (i > 0) & (t.paragraph[np.maximum(i - 1, 0)] == t.paragraph[i])
    before = np.maximum(i - 1, 0)
    length = np.where(has, t.length[before], 0)
    kind = np.where(has, t.kind[before], -1)
    period = (char == ord(".")) & (t.end[i] - t.start[i] == 1) & (t.kind[i] == MARK_KIND)
    dots = (t.kind[i] == MARK_KIND) & ((char == ord("…")) | (t.end[i] - t.start[i] > 1))
    glued = period & alone & has & (t.end[before] == t.start[i])
    upper, numeric, alpha = tables["isupper"][nxt], tables["isnumeric"][nxt], tables["isalpha"][nxt]
    rules = [
        (whole, np.where(lower, 0.5, 0.95)),
        (lower, 0.08),
        (t.kind[i] == LAST_PART, 0.95),
        (upper & glued & (kind == NUMBER_KIND), 0.4),
        (upper & glued & (kind == WORD_KIND), np.where(length <= 1, 0.05, np.where(length <= 4, 0.4, 0.9))),
        (upper, 0.9),
        (numeric, np.where(~period, 0.9, np.where(length <= 4, 0.25, 0.5))),
        (~alpha, np.where(alone, 0.85, 0.6)),
        (~alone, np.where(announced, 0.7, 0.3)),
        (dots, 0.3),
        (period & (length <= 1), 0.05),
    ]
    return np.select([r[0] for r in rules], [r[1] for r in rules], 0.9)


def _gaps(codes: np.ndarray, t: Tokens, closes: np.ndarray, skip: np.ndarray) -> Gaps:
    """Where a boundary is possible; ``skip`` is, by token, the first token of its paragraph behind a list mark."""
    tables = _tables()
    n = len(t.start)
    char = codes[t.start.clip(max=len(codes) - 1)]
    mark = t.kind == MARK_KIND
    ender = mark & (tables["ender"][char] | (t.end - t.start > 1))
    depth = np.zeros(n + 1, dtype=np.int64)
    shut = np.flatnonzero(closes >= 0)
    depth += np.bincount(closes[shut], minlength=n + 1)
    depth[shut] -= 1
    depth = np.cumsum(depth)[:n]
    nxt = np.minimum(np.arange(n) + 1, n - 1)
    same = (np.arange(n) + 1 < n) & (t.paragraph[nxt] == t.paragraph)
    follows = same & (ender[nxt] & (t.start[nxt] == t.end) | (closes[nxt] >= 0))
    last = np.arange(n)
    taken = np.zeros(n, dtype=bool)
    for i in np.flatnonzero(ender & follows).tolist():
        if taken[i]:
            continue
        j = i
        while j + 1 < n and t.paragraph[j + 1] == t.paragraph[i] and (ender[j + 1] and t.start[j + 1] == t.end[j] or 0 <= closes[j + 1] < i):
            j += 1
        last[i] = j
        taken[i + 1 : j + 1] = True
    spaced = same & (t.start[nxt] > t.end)
    south = (t.kind == LAST_PART) & spaced & ((t.kind[nxt] == FIRST_PART) | mark[nxt] & tables["opens"][char[nxt]])
    i = np.flatnonzero((ender & ~taken) | south & ~taken)
    j = last[i]
    k = np.minimum(j + 1, n - 1)
    good = same[j] & (depth[j] == 0) & (j >= skip[j])
    i, j, k = i[good], j[good], k[good]
    after = char[k]
    two = np.minimum(k + 1, n - 1)
    lower = np.where(tables["dash"][after] & same[k], tables["islower"][char[two]], tables["islower"][after])
    is_ender = ender[i]
    tight = is_ender & ~spaced[j] & ~(tables["solid"][char[i]] & (t.end[i] - t.start[i] == 1))
    blocked = tight & ~(tables["isalpha"][after] & ~lower) & ~(mark[k] & tables["opens"][after]) & ~tables["free"][after]
    blocked |= mark[k] & (t.end[k] - t.start[k] == 1) & tables["never"][after]
    i, j, k, after, lower = (x[~blocked] for x in (i, j, k, after, lower))
    first = closes[j]
    ahead = np.maximum(first - 1, 0)
    has = (first > 0) & (t.paragraph[ahead] == t.paragraph[j])
    whole = (first >= 0) & tables["round"][char[np.maximum(first, 0)]] & ((first <= skip[j]) | has & ender[ahead] | has & (closes[ahead] >= 0))
    announced = has & mark[ahead] & tables["colon"][char[ahead]]
    return Gaps(j, i, _seeds(codes, t, i, j, after, lower, whole, announced))


class Places(NamedTuple):
    """Places of texts where a boundary is possible, paragraph by paragraph.

    ``spans``: a row for every paragraph, its begin and stop and how many places it has.
    A row for every place: ``cuts``, the end of the sentence before it and the start of
    the one behind; ``words``, the two before and the two after; ``cues``, the first guess, and
    whether a single word parts it from the place before (1) or behind (2). ``edges``: the
    two first and the two last words of every paragraph that ends like a sentence.
    """

    spans: np.ndarray
    cuts: np.ndarray
    words: np.ndarray
    cues: np.ndarray
    edges: np.ndarray


# Words are hashes, the lowest bits of which say the shape; 0 is the edge of a paragraph.
SHAPE_BITS = 4
KINDS = {"spans": np.int32, "cuts": np.int32, "words": np.int64, "cues": np.float64, "edges": np.int64}
WIDTHS = {"spans": 3, "cuts": 2, "words": 4, "cues": 2, "edges": 4}


def _with_shape(hashes: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return ((hashes << np.uint64(SHAPE_BITS)) | shape.astype(np.uint64)).view(np.int64)


def word_hash(name: str, shape: int) -> int:
    """The hash of one word."""
    codes = np.frombuffer(name.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return int(_with_shape(span_hashes(codes)(np.array([0]), np.array([len(codes)])), np.array([shape]))[0])


@lru_cache(maxsize=1)
def _ender_hashes() -> np.ndarray:
    return np.array(sorted(word_hash(c, SHAPES["<mark>"]) for c in ENDERS), dtype=np.int64)


def analyse(texts: list[str]) -> list[Places]:
    """The places of every text, all texts together."""
    offsets = np.cumsum([0, *(len(x) + 1 for x in texts)])
    spans = [paragraphs(x) for x in texts]
    counts = np.array([len(x) for x in spans], dtype=np.int64)
    flat = np.array([p for x in spans for p in x], dtype=np.int64).reshape(-1, 2) + np.repeat(offsets[:-1], counts)[:, None]
    block = "\n".join(texts)
    codes = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), counts)
    begins, stops = flat[:, 0], flat[:, 1]
    if not len(codes) or not len(begins):
        return [Places(*(np.empty((0, WIDTHS[f]), KINDS[f]) for f in Places._fields)) for _ in texts]
    t = tokenize(codes, begins, stops)
    n = len(t.start)
    head = np.searchsorted(t.paragraph, np.arange(len(begins)))
    tail = np.searchsorted(t.paragraph, np.arange(len(begins)), side="right")
    skip = head.copy()
    for p in range(len(begins)):
        if m := LIST_MARK.match(block, begins[p], stops[p]):
            skip[p] += int(np.searchsorted(t.end[head[p] : tail[p]], m.end(), side="right"))
    closes = _closings(codes, t)
    gaps = _gaps(codes, t, closes, skip[t.paragraph])

    char = codes[t.start.clip(max=len(codes) - 1)]
    mark = t.kind == MARK_KIND
    ender = mark & (_tables()["ender"][char] | (t.end - t.start > 1))
    straight = mark & _tables()["straight"][char]
    final = tail - 1
    for p in np.flatnonzero((tail > head) & (((closes >= 0) | straight) & ~ender)[np.maximum(final, 0)]).tolist():
        f = int(final[p])
        while f >= head[p] and (closes[f] >= 0 or straight[f]) and not ender[f]:
            f -= 1
        final[p] = f
    ended = (final >= head) & (ender | (t.kind >= FIRST_PART))[np.maximum(final, 0)]

    # A mark and the quotes or brackets closed after it become one token; of marks alone, the last.
    drop = np.zeros(n, dtype=bool)
    merged: dict[int, int] = {}
    end = t.end.copy()
    for i, j in zip(gaps.mark[gaps.last > gaps.mark].tolist(), gaps.last[gaps.last > gaps.mark].tolist()):
        drop[i + 1 : j + 1] = True
        end[i] = t.end[j]
        name = lambda x: "…" if t.end[x] - t.start[x] > 1 else block[t.start[x]]
        merged[i] = word_hash(name(j) if ender[i : j + 1].all() else "".join(map(name, range(i, j + 1))), SHAPES["<mark>"])
    kept = np.flatnonzero(~drop)
    renumber = np.cumsum(~drop) - 1
    skip_after = np.where(skip < n, renumber[np.minimum(skip, n - 1)] + drop[np.minimum(skip, n - 1)], len(kept))
    head_after = np.searchsorted(t.paragraph[kept], np.arange(len(begins)))
    tail_after = np.searchsorted(t.paragraph[kept], np.arange(len(begins)), side="right")
    skip_after = np.maximum(np.minimum(skip_after, tail_after), head_after)

    spell, tables = span_hashes(codes), _tables()
    small_upto = np.concatenate([[0], np.cumsum(tables["islower"][codes])])
    dots = word_hash("…", SHAPES["<mark>"])
    by_kind = np.array([0, SHAPES["<num>"], SHAPES["<mark>"], 0, SHAPES["<other>"], SHAPES["<other>"]])

    def hashes(at: np.ndarray, within: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Words of tokens by number; 0 before ``least`` and beyond the paragraphs ``within``."""
        good = (at >= least) & (at < tail_after[within])
        own = kept[np.where(good, at, 0)]
        a, b, k = t.start[own], t.end[own], t.kind[own]
        a = np.where(k == LAST_PART, np.maximum(b - 4, t.start[np.maximum(own - 1, 0)]), a)
        one, upper, lower = t.length[own] == 1, tables["isupper"][codes[a.clip(max=len(codes) - 1)]], tables["islower"][codes[a.clip(max=len(codes) - 1)]]
        capital = np.where(small_upto[b] > small_upto[a], SHAPES["<Xx>"], SHAPES["<XX>"])
        word = np.where(upper, np.where(one, SHAPES["<X>"], capital), np.where(lower, np.where(one, SHAPES["<x>"], SHAPES["<xx>"]), SHAPES["<other>"]))
        out = _with_shape(spell(a, b) ^ (k == LAST_PART).astype(np.uint64), np.where((k == WORD_KIND) | (k == HAN_KIND), word, by_kind[k]))
        out[k == NUMBER_KIND] = SHAPES["<num>"]
        out[(k == MARK_KIND) & (b - a > 1)] = dots
        odd = np.isin(own, special) & good
        for i in np.flatnonzero(odd).tolist():
            x = int(own[i])
            out[i] = merged[x] if x in merged else word_hash(WRAP.sub("", block[t.start[x] : t.end[x]]), int(out[i]) & 15)
        return np.where(good, out, EDGE)

    special = np.concatenate([np.fromiter(merged, np.int64, len(merged)), np.flatnonzero(t.wrapped)])
    g = renumber[gaps.mark]
    p = t.paragraph[gaps.last]
    least = skip_after[p]
    base = offsets[owner[p]]
    cuts = np.stack([t.end[gaps.last] - base, t.start[np.minimum(gaps.last + 1, n - 1)] - base], axis=1)
    neighbour = (g[1:] == g[:-1] + 1) & (p[1:] == p[:-1])
    link = np.zeros(len(g), dtype=np.int64)
    link[1:] += neighbour
    link[:-1] += 2 * neighbour
    words = np.stack([hashes(g + d, p, least) for d in (-1, 0, 1, 2)], axis=1)
    closed = np.flatnonzero(ended & (tail_after > skip_after))
    edges = np.stack([hashes(e, closed, skip_after[closed]) for e in (skip_after[closed], skip_after[closed] + 1, tail_after[closed] - 2, tail_after[closed] - 1)], axis=1)
    places = np.bincount(p, minlength=len(begins))
    spans = np.stack([begins - offsets[owner], stops - offsets[owner], places], axis=1)
    of_text = np.searchsorted(owner, np.arange(len(texts) + 1))
    at_place, at_edge = np.concatenate([[0], np.cumsum(places)])[of_text], np.searchsorted(closed, of_text)
    rows = {"spans": (spans, of_text), "cuts": (cuts, at_place), "words": (words, at_place), "cues": (np.stack([gaps.seed, link], axis=1), at_place), "edges": (edges, at_edge)}
    parts = [[x[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())] for x, at in ((x.astype(KINDS[n]), at) for n, (x, at) in rows.items())]
    return [Places(*five) for five in zip(*parts)]


# --- the model -------------------------------------------------------------------------


class Counts:
    """Numbers by key, found for many keys at once in a table of hashed places; 0 where there is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << int(np.ceil(np.log2(4 * max(len(keys), 4))))
        self.mask = np.uint64(size - 1)
        self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size)
        at, left = self._place(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]  # of several the last stays
            placed = self.keys[at] == keys[left]
            self.values[at[placed]] = values[left[placed]]
            at, left = (at[~placed] + 1) & int(self.mask), left[~placed]

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys.astype(np.uint64) * np.uint64(BASE)) & self.mask).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        shape, keys = np.shape(keys), np.ravel(keys)
        at = self._place(keys)
        here = self.keys[at]
        out = np.where(here == keys, self.values[at], 0.0)
        left = np.flatnonzero((here != keys) & (here >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & int(self.mask)
            here = self.keys[at]
            same = here == keys[left]
            out[left[same]] = self.values[at[same]]
            more = ~same & (here >= 0)
            at, left = at[more], left[more]
        return out.reshape(shape)


class Encoded(NamedTuple):
    """The numbers of the words around the places, and their cues, of many texts."""

    u: np.ndarray
    v: np.ndarray
    x: np.ndarray
    y: np.ndarray
    link: np.ndarray
    seed: np.ndarray
    edges: np.ndarray


class Model:
    """Interpolated trigram probabilities over words, marks and boundaries.

    ``words`` are the hashes of the vocabulary; ``keys`` and ``values`` the counts of
    n-grams, a key holding the numbers of its words.
    """

    def __init__(self, words: np.ndarray, keys: np.ndarray | None = None, values: np.ndarray | None = None, prior: float = 2.0, spread: float = 100.0, trust: float = 0.5):
        self.words, self.prior, self.spread, self.trust = np.sort(np.asarray(words, np.int64)), prior, spread, trust
        keys = np.empty(0, np.int64) if keys is None else np.asarray(keys, np.int64)
        values = np.empty(0) if values is None else np.asarray(values, np.float64)
        self.keys, self.values = keys, values
        longer = keys >= 1 << BITS
        contexts, at = np.unique(keys[longer] >> BITS, return_inverse=True)
        self.counts, self.sums = Counts(keys, values), Counts(contexts, np.bincount(at, weights=values[longer], minlength=len(contexts)))
        self.total = float(self.values[~longer & (self.keys > STAY)].sum())
        self.floor = 1.0 / (len(self.words) + FIRST_WORD + 1)
        # What follows a closing mark alone doesn't depend on which it is.
        self.plain = np.arange(len(self.words) + FIRST_WORD)
        self.plain[FIRST_WORD + np.flatnonzero(np.isin(self.words, _ender_hashes()))] = SHAPES["<end>"]

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The numbers of words; EDGE for none, its shape for a word that isn't in the vocabulary."""
        if not len(self.words):
            return words & 15
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at + FIRST_WORD, words & 15)

    def encoded(self, words: np.ndarray, cues: np.ndarray, edges: np.ndarray) -> Encoded:
        """The numbers of ``Places``."""
        return Encoded(*np.ascontiguousarray(self.numbers(words).T), cues[:, 1].astype(np.int64), np.ascontiguousarray(cues[:, 0]), self.numbers(edges))

    def prob(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Probabilities of ``w`` after ``u, v``."""
        u, v, w = (np.asarray(z, np.int64) for z in np.broadcast_arrays(u, v, w))
        lam = self.prior
        p = (self.counts[w] + lam * self.floor) / (self.total + lam)
        vw = v << BITS | w
        p = (self.counts[vw] + lam * p) / (self.sums[v] + lam)
        lam = np.where((v == CUT) | (v == STAY), self.spread, lam)  # a rare mark must not own the few words seen after it
        return (self.counts[u << 2 * BITS | vw] + lam * p) / (self.sums[u << BITS | v] + lam)

    def posteriors(self, q: Encoded) -> np.ndarray:
        """For each place the probability of a boundary there.

        The surface cue stays in as evidence, its odds to the power ``trust``.
        Forward-backward over chains of places: the event before matters to the next one
        only where a single word lies between them. Chains are walked side by side.
        """
        n = len(q.u)
        if not n:
            return np.empty(0)
        prob, v = self.prob, self.plain[q.v]
        cut, stay = prob(v, CUT, q.x) * q.seed**self.trust, prob(v, STAY, q.x) * (1.0 - q.seed) ** self.trust
        ahead, behind = (q.link & 2) > 0, (q.link & 1) > 0
        cut = np.where(ahead, cut, cut * prob(CUT, q.x, q.y))  # else an event stands before y
        stay = np.where(ahead, stay, stay * prob(STAY, q.x, q.y))
        w = np.empty((n, 2, 2))  # event before, event
        for e, weight in ((0, stay), (1, cut)):
            event = (STAY, CUT)[e]
            w[:, 0, e] = w[:, 1, e] = prob(q.u, q.v, event) * weight
            for before in (0, 1):  # a single word since the event before
                w[behind, before, e] = prob((STAY, CUT)[before], q.v[behind], event) * weight[behind]
        starts = np.flatnonzero(~behind)
        lengths = np.diff(np.append(starts, n))
        forward, back = np.empty((n, 2)), np.ones((n, 2))
        forward[starts] = w[starts, 0]
        forward[starts] /= forward[starts].sum(axis=1, keepdims=True)
        for step in range(1, int(lengths.max())):
            at = starts[lengths > step] + step
            f = np.einsum("ni,nij->nj", forward[at - 1], w[at])
            forward[at] = f / f.sum(axis=1, keepdims=True)
        for step in range(int(lengths.max()) - 1, 0, -1):
            at = starts[lengths > step] + step
            m = np.einsum("nij,nj->ni", w[at], back[at])
            back[at - 1] = m / m.sum(axis=1, keepdims=True)
        both = forward * back
        return both[:, 1] / both.sum(axis=1)

    def expected(self, q: Encoded, post: np.ndarray, unsure: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Keys and expected counts of the n-grams around hidden events.

        Events of a probability between 0.2 and 0.8 enter with weight ``unsure``.
        The edges of a paragraph that ends like a sentence are certain boundaries.
        """
        keys, counts = [], []

        def add(mass, *grams):
            for words in grams:
                key = np.zeros(len(mass), np.int64)
                for w in words:
                    key = key << BITS | w
                keys.append(key)
                counts.append(mass)

        x, y, u, v = q.edges.reshape(-1, 4).T
        one = np.ones(len(x))
        around = lambda m, e, v, x, y: add(m, (x,), (e, x), (v, e, x), (x, y), (e, x, y))
        up_to = lambda m, e, u, v: add(m, (np.full(len(m), e),), (v, e), (u, v, e))
        around(one, CUT, EDGE, x, y)
        up_to(one, CUT, u, v)
        weight = np.where((post > 0.2) & (post < 0.8), unsure, 1.0)
        for e, c in ((CUT, post * weight), (STAY, (1.0 - post) * weight)):
            some = c > 0
            up_to(c[some], e, q.u[some], q.v[some])
            around(c[some], e, self.plain[q.v[some]], q.x[some], q.y[some])
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        return found, np.bincount(at, weights=np.concatenate(counts), minlength=len(found))


def sentence_spans(text: str, model: Model, threshold: float = 0.5) -> list[tuple[int, int]]:
    """``(start, end)`` of the sentences of ``text``; only white space lies outside them."""
    q = analyse([text])[0]
    starts, ends, _ = _decided(q.spans, q.cuts, model.posteriors(model.encoded(q.words, q.cues, q.edges)) > threshold)
    return list(zip(starts.tolist(), ends.tolist()))


def _decided(spans: np.ndarray, cuts: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of sentences, and the paragraph of each, from the places that are boundaries."""
    begin, stop, places = spans.T
    paragraph = np.repeat(np.arange(len(begin)), places)[cut]
    owner = np.concatenate([np.arange(len(begin)), paragraph])
    starts, ends = np.concatenate([begin, cuts[cut, 1]]), np.concatenate([stop, cuts[cut, 0]])
    order, last = np.lexsort((starts, owner)), np.lexsort((ends, owner))
    return starts[order], ends[last], owner[order]


# --- over tables -----------------------------------------------------------------------

#: The places of a text as a table has them: every array's bytes.
_PLACES = ", ".join(f"{n} binary" for n in Places._fields)
#: Characters analysed together, unless one text has more.
BLOCK_CHARS = 500_000


def _most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` most frequent rows of ``counts``, the smaller key first; all where there are no more.

    A histogram of frequencies finds them, so only the bucket that reaches the limit is sorted.
    """
    table = stage(counts)
    if table.count() <= limit:
        return table
    bucket = F.floor(F.log2("n") * 16)
    sizes = sorted(((r.b, r.c) for r in table.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True)
    kept = 0
    for b, c in sizes:  # some hundreds
        if kept + c > limit:
            return table.filter(bucket > b).unionByName(table.filter(bucket == b).orderBy(F.desc("n"), "key").limit(limit - kept))
        kept += c
    return table


def _analysed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col`` and the ``Places`` of every text of ``df``, rows equal in id and text once; staged."""
    spark = df.sparkSession
    rows = df.select(id_col, text_col).filter(F.col(text_col).rlike(r"\S"))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # 16 bytes for every text of the partition

        def out(ids, texts, field):
            found = analyse(texts)
            columns = [pa.array([getattr(q, n).tobytes() for q in found], pa.binary()) for n in Places._fields]
            return pa.record_batch([pa.array(ids, field.type), *columns], names=[id_col, *Places._fields])

        for batch in batches:
            ids, texts, size = [], [], 0
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key = xxhash.xxh3_128_digest(f"{name!r}\0{text}".encode("utf-8", "surrogatepass"))
                if key in seen:
                    continue
                seen.add(key)
                ids.append(name)
                texts.append(text)
                size += len(text)
                if size > BLOCK_CHARS:
                    yield out(ids, texts, batch.schema.field(0))
                    ids, texts, size = [], [], 0
            if ids:
                yield out(ids, texts, batch.schema.field(0))

    # The work is heavy on each text, and the files may be few; equal rows meet.
    dealt = rows.repartition(parts_for(spark, df.count(), 400), F.xxhash64(id_col, text_col))
    return stage(dealt.mapInArrow(run, f"`{id_col}` {kind}, {_PLACES}"))


def _arrays(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    """The arrays of many texts, one after the other."""
    return [np.frombuffer(b"".join(batch.column(n).to_pylist()), dtype=KINDS[n]).reshape(-1, WIDTHS[n]) for n in names]


def _counted(rows: DataFrame, count: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``key, n``: what ``count`` finds in the batches of ``rows``."""

    def run(batches):
        for batch in batches:
            keys, n = count(batch)
            if len(keys):
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(n, pa.float64())], names=["key", "n"])

    return rows.mapInArrow(run, "key long, n double").groupBy("key").agg(F.round(F.sum("n"), 6).alias("n")).filter("n > 0")


def _vocabulary(places: DataFrame, size: int) -> np.ndarray:
    """The ``size`` most frequent words around possible boundaries."""

    def words(batch: pa.RecordBatch):
        every = np.concatenate([x.ravel() for x in _arrays(batch, "words", "edges")])
        return np.unique(every[(every != EDGE) & (every != SHAPES["<num>"])], return_counts=True)

    return np.sort(_most_frequent(_counted(places.select("words", "edges"), words), size).toArrow().column("key").to_numpy())


def _trained(places: DataFrame, words: np.ndarray, max_ngrams: int, passes: int) -> Model:
    spark = places.sparkSession
    shared = SharedModel(spark, words)
    only = places.select("words", "cues", "edges")
    for k in range(passes + 1):

        def events(batch: pa.RecordBatch, shared=shared, first=k == 0):
            model = shared.get()
            q = model.encoded(*_arrays(batch, "words", "cues", "edges"))
            return model.expected(q, q.seed if first else model.posteriors(q), UNSURE if first else 1.0)

        grams = _most_frequent(_counted(only, events), max_ngrams).toArrow()
        shared = SharedModel(spark, words, grams.column(0).to_numpy(), grams.column(1).to_numpy())
    return shared.get()


def train(texts: DataFrame, text_col: str = "content", vocabulary_size: int = 200_000, max_ngrams: int = 2_000_000, passes: int = 3) -> Model:
    """A model of all texts of ``texts``.

    Every text is counted, equal ones once. The model keeps the ``vocabulary_size`` most
    frequent words around possible boundaries (others enter by their shape) and the
    ``max_ngrams`` most frequent n-grams: these parameters bound what is sent to the
    driver and the workers.
    """
    places = _analysed(texts.select(F.lit(0).alias("id"), text_col), "id", text_col)
    return _trained(places, _vocabulary(places, vocabulary_size), max_ngrams, passes)


_MODELS: dict[str, Model] = {}


class SharedModel:
    """A model for the workers: broadcast, and built once in each of them."""

    def __init__(self, spark, words: np.ndarray, keys=None, values=None):
        self.name = uuid.uuid4().hex
        self.held = spark.sparkContext.broadcast((words, keys, values))

    def get(self) -> Model:
        if self.name not in _MODELS:
            _MODELS.clear()
            _MODELS[self.name] = Model(*self.held.value)
        return _MODELS[self.name]


def split_sentences(df: DataFrame, id_col: str = "document_id", text_col: str = "content", model: Model | None = None, threshold: float = 0.5, vocabulary_size: int = 200_000, max_ngrams: int = 2_000_000, passes: int = 3) -> DataFrame:
    """``(id_col, start_char, end_char)`` of every sentence of every text of ``df``.

    Trains on ``df`` unless a ``model`` is given, within the bounds of ``train``. Null,
    empty and blank texts give no rows; repeated rows count once; a null id is kept;
    other columns are ignored.
    """
    spark = df.sparkSession
    places = _analysed(df, id_col, text_col)
    if model is None:
        model = _trained(places, _vocabulary(places, vocabulary_size), max_ngrams, passes)
    shared = SharedModel(spark, model.words, model.keys, model.values)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        own = shared.get()
        for batch in batches:
            spans, cuts, words, cues, edges = _arrays(batch, *Places._fields)
            starts, ends, paragraph = _decided(spans, cuts, own.posteriors(own.encoded(words, cues, edges)) > threshold)
            paragraphs_of = pc.divide(pc.binary_length(batch.column("spans")), WIDTHS["spans"] * 4).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), paragraphs_of)[paragraph]
            yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[id_col, "start_char", "end_char"])

    # Different texts of one id may have sentences in the same place.
    unique = places.groupBy(id_col).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").isEmpty()
    spans = places.mapInArrow(run, f"`{id_col}` {kind}, start_char int, end_char int")
    return spans if unique else spans.distinct()


def sentence_sums(df: DataFrame, spans: DataFrame, id_col: str = "document_id", text_col: str = "content") -> DataFrame:
    """What sentences must hold, a row for every text that isn't blank.

    ``id_col, kept``, the letters and digits within the sentences, and how many
    sentences are ``loose`` (blank at an edge, or empty) or begin before the one before
    them ends (``overlapping``). Ids must be unique but for repeated rows.
    """
    texts = once(df.select(id_col, text_col).filter(F.col(text_col).rlike(r"\S")), id_col)
    order = Window.partitionBy(id_col).orderBy("start_char")
    parts = spans.withColumn("__before", F.lag("end_char", 1, 0).over(order)).join(texts, id_col)
    body = F.substring(text_col, F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    parts = parts.select(id_col, body.alias("s"), (F.col("start_char") < F.col("__before")).alias("o"))
    letters = F.length(F.regexp_replace("s", r"[^\p{L}\p{N}]", ""))
    return parts.groupBy(id_col).agg(F.sum(letters).alias("kept"), F.count_if(~F.col("s").rlike(r"(?Us)^\S(.*\S)?$")).alias("loose"), F.count_if("o").alias("overlapping"))
