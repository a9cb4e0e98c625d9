"""Text cleaning and tokenizing as expressions: everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ligatures and their letters; invisible characters dropped.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
INVISIBLE = "­​‌‍﻿⁠"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"

# Words that carry no weight in lexical search.
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by "
    "can cannot could did do does doing down during each few for from further had has have having he her here hers herself "
    "him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or "
    "other our ours ourselves out over own same she should so some such than that the their theirs them themselves then "
    "there these they this those through to too under until up very was we were what when where which while who whom why "
    "will with would you your yours yourself yourselves"
).split()

# Line ends of Python's splitlines, and white space of Python's strip.
_LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
_STRIP = "(?U)^[\\s\x1c-\x1f\x85]+|[\\s\x1c-\x1f\x85]+$"
_LETTER = r"[\p{L}\p{N}_]"
# Fixed value: formulas, commands and placeholders.
MATH = r"(?s)\$\$.*?\$\$|\$[^$]*\$|\\begin\{.*?\}.*?\\end\{.*?\}|\\[a-zA-Z]+\s*|<[^>]{1,60}>"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, _STRIP, "")


def normalize_characters(text: Column) -> Column:
    """Expand ligatures; drop invisible and control characters (tab and line ends stay)."""
    for glyph, letters in LIGATURES.items():
        text = F.replace(text, F.lit(glyph), F.lit(letters))
    return F.regexp_replace(F.translate(text, INVISIBLE, ""), CONTROLS, "")


def dehyphenate(text: Column) -> Column:
    """Join a word broken by a hyphen at a line end."""
    return F.regexp_replace(text, f"({_LETTER})[-‐‑]\n(?={_LETTER})", "$1")


def reflow(text: Column) -> Column:
    """Join the lines of every paragraph; paragraphs, parted by blank lines, remain."""
    lines = lambda p: F.array_join(F.filter(F.transform(F.split(p, _LINE_END), _strip), lambda x: x != ""), " ")
    parts = F.transform(F.split(text, r"(?U)\n[ \t]*\n\s*"), lines)
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def merge_continuations(text: Column) -> Column:
    """Append a paragraph to the one before, unless that ends a sentence."""
    right, left = "(?U)\\s+$", "(?U)^\\s+"

    def step(done: Column, part: Column) -> Column:
        last = F.regexp_replace(F.try_element_at(done, F.lit(-1)), right, "")
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.lit(" "), F.regexp_replace(part, left, ""))))
        keep = (F.size(done) == 0) | last.rlike("[.!?][\"'’”)\\]]*$")
        return F.when(keep, F.concat(done, F.array(part))).otherwise(joined)

    return F.array_join(F.aggregate(F.split(text, "\n\n"), F.array().cast("array<string>"), step), "\n\n")


def collapse_spaces(text: Column) -> Column:
    """Squeeze runs of spaces and tabs."""
    return F.regexp_replace(text, "[ \t]+", " ")


def clean_text(text: Column) -> Column:
    """The default cleaning: characters, hyphens, lines, paragraphs, spaces, in this order."""
    return collapse_spaces(merge_continuations(reflow(dehyphenate(normalize_characters(text)))))


def reflow_only(text: Column) -> Column:
    """Hyphens and lines only."""
    return reflow(dehyphenate(text))


PREPROCESSORS: dict[str, Callable[[Column], Column] | None] = {"default": clean_text, "reflow": reflow_only, "none": None}


def resolve_preprocessor(choice: str | Callable[[Column], Column] | None) -> Callable[[Column], Column] | None:
    """A cleaning function by name; functions and None pass through."""
    if choice is None or callable(choice):
        return choice
    if choice not in PREPROCESSORS:
        raise ValueError(f"unknown preprocessor {choice!r}; known: {', '.join(PREPROCESSORS)}")
    return PREPROCESSORS[choice]


def strip_math(text: Column) -> Column:
    """Replace formulas, commands and placeholders by a space."""
    return F.regexp_replace(text, MATH, " ")


def normalize_alnum(text: Column) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def collapse_whitespace(text: Column) -> Column:
    """All runs of white space as one space, none outside."""
    return _strip(F.regexp_replace(text, "(?U)[\\s\x1c-\x1f\x85]+", " "))


def snippet(text: Column, limit: int, mark: str) -> Column:
    """Collapsed text, cut to ``limit`` characters with ``mark`` after the cut."""
    flat = collapse_whitespace(text)
    cut = F.concat(F.rtrim(F.substring(flat, 1, limit)), F.lit(mark))
    return F.when(F.length(flat) > limit, cut).otherwise(flat)


def lexical_terms(text: Column, remove_stopwords: bool = True) -> Column:
    """Terms of lexical search, unstemmed: runs of ASCII letters and digits of two or more, without stopwords."""
    terms = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), 0)
    return F.filter(terms, lambda w: ~w.isin(STOPWORDS)) if remove_stopwords else terms


def config_slug(spec: Column, embedder: Column | None = None) -> Column:
    """A spec as a file name: ``fixed_size:512:25%`` gives ``fixed_size_512_25pct``."""

    def plain(c: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("%"), F.lit("pct")), "[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", "")

    return plain(spec) if embedder is None else F.concat(plain(spec), F.when(embedder.isNotNull(), F.concat(F.lit("__"), plain(embedder))).otherwise(""))


def passage_label(number: Column, source: Column, page: Column) -> Column:
    """``[N] source`` and the page where known."""
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), source, F.coalesce(F.concat(F.lit(" p"), page.cast("string")), F.lit("")))
