"""Named queries over the tables of a folder, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stem import porter_stem
from ..functions.tokens import PIECE, token_starts
from ..functions.vectors import norm, sigmoid, unit
from ..operators import answers as A
from ..operators import chunking as C
from ..operators import fusion, lexical, metrics, pages, relevance, rerank
from ..operators import vector_index as V
from ..schema import blank_to_null
from ..shared import once, shared_dir
from ..sources.tables import read_table
from ..streaming import ingest
from . import experiments as X
from . import pipeline
from .runs import runs_sql, runs_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function as a query under its name, with the SQL to hold it against."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- tables, repeated rows taken once --------------------------------------------------


def papers(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "papers").dropDuplicates(["document_id"])


def texts(spark: SparkSession, d: str) -> DataFrame:
    """``papers`` for queries that need the contents: only repeated ones are shuffled."""
    return once(read_table(spark, d, "papers"), "document_id")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "chunks").dropDuplicates(["chunk_id"])


def chunk_texts(spark: SparkSession, d: str) -> DataFrame:
    """``chunks`` for queries that need the contents: only repeated ones are shuffled."""
    return once(read_table(spark, d, "chunks"), "chunk_id")


def by_chunker(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with a chunker that isn't null, as each has an index of its own."""
    return chunk_texts(spark, d).withColumn("chunker", F.coalesce("chunker", F.lit("")))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "chunk_vectors").dropDuplicates(["chunk_id"])
    return rows.filter(F.size("embedding") == 96)


def every_twentieth(number: Column) -> Column:
    """The stated query set of a search: ids divisible by 20."""
    return number % 20 == 0


def asked(spark: SparkSession, d: str) -> DataFrame:
    q = read_table(spark, d, "queries").dropDuplicates(["query_id"]).filter("query is not null")
    return q.filter(every_twentieth(F.substring("query_id", 2, 20).cast("int")))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Best finite score of every chunk by query and retriever type."""
    r = read_table(spark, d, "rankings").filter("query_id is not null and score is not null and not isnan(score) and abs(score) < double('infinity')")
    kind = F.lower(F.trim("retriever_type"))
    return r.groupBy("query_id", kind.alias("retriever_type"), "chunk_id").agg(F.max("score").alias("score"))


def top_scored(spark: SparkSession, d: str, k: int, kind: str | None = None) -> DataFrame:
    rows = scored(spark, d) if kind is None else scored(spark, d).filter(F.col("retriever_type") == kind)
    w = Window.partitionBy("query_id", "retriever_type").orderBy(F.desc("score"), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


_PAPERS = "papers_ AS (SELECT DISTINCT document_id, paper_id, source, content FROM papers)"
_CHUNKS = "chunks_ AS (SELECT DISTINCT ON (chunk_id) * FROM chunks)"
_VECTORS = "vectors_ AS (SELECT DISTINCT ON (chunk_id) * FROM chunk_vectors WHERE len(embedding) = 96)"
_ASKED = "asked_ AS (SELECT DISTINCT query_id, query FROM queries WHERE query IS NOT NULL AND CAST(substr(query_id, 2) AS INT) % 20 = 0)"
_SCORED = "scored_ AS (SELECT query_id, lower(trim(retriever_type)) AS retriever_type, chunk_id, max(score) AS score FROM rankings WHERE query_id IS NOT NULL AND isfinite(score) GROUP BY ALL)"
_RANKED = _SCORED + ", ranked_ AS (SELECT *, row_number() OVER (PARTITION BY query_id, retriever_type ORDER BY score DESC, chunk_id) AS rank FROM scored_)"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def _terms(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda w: len(w) >= 2 AND NOT list_contains({_STOP}, w))"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g')"


def _flat(x: str) -> str:
    return _strip(f"regexp_replace({x}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')")


def _snippet(x: str, n: int, mark: str) -> str:
    return f"CASE WHEN len({_flat(x)}) > {n} THEN rtrim(substr({_flat(x)}, 1, {n})) || '{mark}' ELSE {_flat(x)} END"


_NORMAL = "content"
for _glyph, _letters in T.LIGATURES.items():
    _NORMAL = f"replace({_NORMAL}, '{_glyph}', '{_letters}')"
_NORMAL = f"regexp_replace(regexp_replace({_NORMAL}, '[\\x{{ad}}\\x{{200b}}\\x{{200c}}\\x{{200d}}\\x{{feff}}\\x{{2060}}]', '', 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')"


def _dehyphen(x: str) -> str:
    return f"regexp_replace({x}, '([\\p{{L}}\\p{{N}}_])[-‐‑]\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g')"


def _reflow(x: str) -> str:
    lines = f"list_filter(list_transform(string_split_regex(p, '\\r\\n|[\\n\\r\\v\\f]'), lambda y: {_strip('y')}), lambda y: y <> '')"
    return f"array_to_string(list_filter(list_transform(string_split_regex({x}, '\\n[ \\t]*\\n[ \\t\\n\\r\\f\\v]*'), lambda p: array_to_string({lines}, ' ')), lambda p: p <> ''), chr(10) || chr(10))"


def _merge(x: str) -> str:
    ends = "regexp_matches(rtrim(a, chr(32) || chr(10)), '[.!?][\"''’”)\\]]*$')"
    return f"coalesce(list_reduce(string_split({x}, chr(10) || chr(10)), lambda a, b: CASE WHEN {ends} THEN a || chr(10) || chr(10) || b ELSE rtrim(a) || ' ' || ltrim(b) END), '')"


# --- documents and cleaning ------------------------------------------------------------


@query("SELECT DISTINCT document_id, paper_id, source, nullif(trim(title), '') AS title, nullif(trim(author), '') AS author, page_count FROM papers")
def load_documents(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d)
    return p.select("document_id", "paper_id", "source", blank_to_null(F.col("title")).alias("title"), blank_to_null(F.col("author")).alias("author"), "page_count")


def _cleaned(f: Callable[[Column], Column]) -> Query:
    return lambda spark, d: texts(spark, d).select("document_id", f(F.col("content")).alias("content"))


for _name, _function, _sql in (
    ("clean_normalize", T.normalize_characters, _NORMAL),
    ("clean_dehyphenate", T.dehyphenate, _dehyphen("content")),
    ("clean_reflow", T.reflow, _reflow("content")),
    ("clean_spaces", T.collapse_spaces, "regexp_replace(content, '[ \\t]+', ' ', 'g')"),
    ("clean_reflow_only", T.reflow_only, _reflow(_dehyphen("content"))),
    ("clean_merge", lambda c: T.merge_continuations(T.reflow(c)), _merge("r")),
    ("clean_default", T.clean_text, f"regexp_replace({_merge('r')}, '[ \\t]+', ' ', 'g')"),
    ("strip_math", T.strip_math, r"regexp_replace(content, '\$\$.*?\$\$|\$[^$]*\$|\\begin\{.*?\}.*?\\end\{.*?\}|\\[a-zA-Z]+\s*|<[^>]{1,60}>', ' ', 'gs')"),
    ("normalize_alnum", T.normalize_alnum, "regexp_replace(lower(content), '[^a-z0-9]', '', 'g')"),
):
    QUERIES[_name] = _cleaned(_function)
    _source = {"clean_merge": f"(SELECT document_id, {_reflow('content')} AS r FROM papers_)", "clean_default": f"(SELECT document_id, {_reflow(_dehyphen(_NORMAL))} AS r FROM papers_)"}.get(_name, "papers_")
    _value = f"CASE WHEN r IS NULL THEN NULL ELSE {_sql} END" if _name in ("clean_merge", "clean_default") else _sql
    SQL[_name] = f"WITH {_PAPERS} SELECT document_id, {_value} AS content FROM {_source}"


@query(
    "WITH p AS (SELECT DISTINCT document_id, content, page_starts FROM papers WHERE content IS NOT NULL AND len(page_starts) > 0 AND page_starts[1] = 0) "
    "SELECT document_id, CAST(len(content) AS INT) AS num_chars, CAST(len(page_starts) AS INT) AS page_count, array_to_string(page_starts, ',') AS starts FROM p"
)
def page_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Papers cut at their page starts and joined again."""
    p = papers(spark, d).filter("content is not null and size(page_starts) > 0 and page_starts[0] = 0")
    end = F.coalesce(F.try_element_at("page_starts", F.col("i") + 2), F.length("content"))
    parts = p.select("document_id", "content", "page_starts", F.posexplode("page_starts").alias("i", "a")).select("document_id", F.col("i").alias("page_no"), F.substring("content", F.col("a") + 1, end - F.col("a")).alias("text"))
    joined = pages.join_pages(parts, separator="")
    return joined.select("document_id", F.length("content").alias("num_chars"), "page_count", F.array_join(F.col("page_starts").cast("array<string>"), ",").alias("starts"))


@query(
    f"WITH {_CHUNKS}, p AS (SELECT DISTINCT document_id, page_starts FROM papers), "
    "j AS (SELECT chunk_id, page_starts, start_char, greatest(end_char - 1, start_char) AS last FROM chunks_ JOIN p USING (document_id)) "
    "SELECT chunk_id, CASE WHEN len(page_starts) > 0 THEN CAST(len(list_filter(page_starts, lambda s: s <= start_char)) AS INT) END AS page_number, "
    "CASE WHEN len(page_starts) > 0 THEN CAST(len(list_filter(page_starts, lambda s: s <= last)) AS INT) END AS end_page FROM j"
)
def chunk_page_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d).select("document_id", "page_starts")
    c = chunks(spark, d).select("chunk_id", "document_id", "start_char", "end_char").join(p, "document_id")
    last = F.greatest(F.col("end_char") - 1, F.col("start_char"))
    return c.select("chunk_id", pages.page_of(F.col("page_starts"), F.col("start_char")).alias("page_number"), pages.page_of(F.col("page_starts"), last).alias("end_page"))


# --- tokens and chunkers ---------------------------------------------------------------


@query(f"SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '{PIECE}')), 0) AS INT) AS tokens FROM documents")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.token_totals(read_table(spark, d, "documents"), "doc_id", "text")


_PIECES = (
    f"WITH {_PAPERS}, w AS (SELECT document_id, content, regexp_extract_all(content, '{PIECE}') AS ps FROM papers_ WHERE content IS NOT NULL AND content <> ''), "
    "t AS (SELECT document_id, unnest(ps) AS piece, generate_subscripts(ps, 1) - 1 AS i FROM w), "
    "s AS (SELECT document_id, i, coalesce(sum(len(piece)) OVER (PARTITION BY document_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, sum(len(piece)) OVER (PARTITION BY document_id ORDER BY i) AS b FROM t), "
)


@query(_PIECES.rstrip().rstrip(",") + " SELECT document_id, CAST(i AS INT) AS token, CAST(a AS INT) AS start_char FROM s")
def token_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where every token of a paper starts; the position after the last one is left out."""
    starts = texts(spark, d).filter("content <> ''").select("document_id", token_starts(F.col("content")).alias("starts"))
    rows = starts.select("document_id", F.size("starts").alias("n"), F.posexplode("starts").alias("token", "start_char"))
    return rows.filter("token < n - 1").select("document_id", "token", "start_char")


def _window_sql(size: int, step: int) -> str:
    return _PIECES + (
        f"n AS (SELECT document_id, content, len(ps) AS n, CAST(ceil(greatest(len(ps) - {size}, 0) / {step}) AS INT) + 1 AS k FROM w), "
        f"x AS (SELECT document_id, content, n, unnest(range(k)) AS chunk FROM n), "
        f"z AS (SELECT x.document_id, x.content, x.chunk, CAST(f.a AS INT) AS start_char, CAST(l.b AS INT) AS end_char, CAST(least(x.chunk * {step} + {size}, n) - x.chunk * {step} AS INT) AS num_tokens FROM x "
        f"JOIN s f ON f.document_id = x.document_id AND f.i = x.chunk * {step} JOIN s l ON l.document_id = x.document_id AND l.i = least(x.chunk * {step} + {size}, n) - 1) "
        "SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY chunk) - 1 AS INT) AS chunk_index, start_char, end_char, num_tokens, md5(substr(content, start_char + 1, end_char - start_char)) AS digest FROM z "
        "WHERE regexp_matches(substr(content, start_char + 1, end_char - start_char), '[^ \\t\\r\\n\\f]')"
    )


def _chunked(spark: SparkSession, d: str, spec: str, embedder: Callable | None = None) -> DataFrame:
    rows = C.chunk_documents(texts(spark, d), spec, embedder, "hashing" if embedder else None)
    return rows.select("document_id", "chunk_index", "start_char", "end_char", "num_tokens", F.md5("content").alias("digest"))


@query(_window_sql(512, 384))
def chunk_fixed_size(spark: SparkSession, d: str) -> DataFrame:
    return _chunked(spark, d, "fixed_size:512:25%")


@query(_window_sql(128, 64))
def chunk_sliding_window(spark: SparkSession, d: str) -> DataFrame:
    return _chunked(spark, d, "sliding_window:128:0.5")


# The SQL of the greedy chunkers: for every unit of a document where its run would end
# (last) and where the next begins (following), then the chain of runs from the first.
_RUNS = (
    "chain_ AS (SELECT document_id, p, last, following FROM runs_of_ WHERE p = 0 UNION ALL SELECT r.document_id, r.p, r.last, r.following FROM chain_ c JOIN runs_of_ r ON r.document_id = c.document_id AND r.p = c.following AND c.last < r.n), "
    "spans_ AS (SELECT c.document_id, f.a AS a, l.b AS b, l.upto + l.tokens - f.upto AS num_tokens FROM chain_ c JOIN units_ f ON f.document_id = c.document_id AND f.p = c.p JOIN units_ l ON l.document_id = c.document_id AND l.p = c.last - 1), "
    "cut_ AS (SELECT s.*, substr(content, CAST(a AS INT) + 1, CAST(b - a AS INT)) AS body FROM spans_ s JOIN papers_ USING (document_id)) "
    "SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY a) - 1 AS INT) AS chunk_index, CAST(a AS INT) AS start_char, CAST(b AS INT) AS end_char, CAST(num_tokens AS INT) AS num_tokens, md5(body) AS digest FROM cut_ WHERE regexp_matches(body, '[^ \\t\\r\\n\\f]')"
)


def _cut_by_tokens(size: int) -> str:
    """``units_`` from ``pieces_(document_id, a, piece)``: the pieces, those over ``size`` tokens in windows of so many."""
    upto = lambda e: f"coalesce(list_sum(list_transform(toks[1:{e}], lambda x: len(x))), 0)"
    return (
        f"tok_ AS (SELECT document_id, a, regexp_extract_all(piece, '{PIECE}') AS toks FROM pieces_), win_ AS (SELECT *, unnest(range(0, len(toks), {size})) AS i FROM tok_), "
        f"part_ AS (SELECT document_id, a + {upto('i')} AS a, a + {upto(f'i + {size}')} AS b, least({size}, len(toks) - i) AS tokens FROM win_), "
        "units_ AS (SELECT *, row_number() OVER w - 1 AS p, sum(tokens) OVER w - tokens AS upto, count(*) OVER (PARTITION BY document_id) AS n FROM part_ WINDOW w AS (PARTITION BY document_id ORDER BY a)), "
    )


def _full_runs(size: int) -> str:
    """``full_(document_id, p, last)``: as many units as ``size`` tokens hold, one at least."""
    return f"full_ AS (SELECT u.document_id, u.p, u.n, u.upto, u.p + greatest(1, count(v.p) FILTER (v.upto + v.tokens - u.upto <= {size})) AS last FROM units_ u JOIN units_ v ON v.document_id = u.document_id AND v.p >= u.p GROUP BY u.document_id, u.p, u.n, u.upto), "


_SENTENCE_SQL = C.SENTENCE.replace("'", "''")
_SENTENCES = (
    f"{_PAPERS}, cutup_ AS (SELECT document_id, regexp_extract_all(content, '{_SENTENCE_SQL}') AS ps FROM papers_ WHERE content <> ''), flat_ AS (SELECT document_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM cutup_), "
    "at_ AS (SELECT document_id, piece, sum(len(piece)) OVER (PARTITION BY document_id ORDER BY i) - len(piece) AS a FROM flat_), pieces_ AS (SELECT * FROM at_ WHERE regexp_matches(piece, '[^ \\t\\r\\n\\f]')), "
)


@query(
    f"WITH RECURSIVE {_SENTENCES}{_cut_by_tokens(C.sentence_cap(5))}{_full_runs(C.sentence_cap(5))}"
    f"runs_of_ AS (SELECT document_id, p, n, least(last, p + 5) AS last, greatest(p + 1, least(last, p + 5) - 1) AS following FROM full_), {_RUNS}"
)
def chunk_sentence(spark: SparkSession, d: str) -> DataFrame:
    return _chunked(spark, d, "sentence:5:1")


def _atoms_sql(size: int, separators: tuple[str, ...]) -> str:
    """``pieces_``: contents cut behind one separator after the other where they are over ``size`` tokens."""
    out = f"{_PAPERS}, level_0 AS (SELECT document_id, 0 AS a, content AS piece FROM papers_ WHERE content <> ''), "
    for i, sep in enumerate(separators):
        pattern = "(?s).*?" + sep.replace("\n", "\\n").replace(".", "\\.") + "|.+"
        out += f"cut_{i} AS (SELECT document_id, a AS base, CASE WHEN len(regexp_extract_all(piece, '{PIECE}')) > {size} THEN regexp_extract_all(piece, '{pattern}') ELSE [piece] END AS ps FROM level_{i}), "
        out += f"flat_{i} AS (SELECT document_id, base, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM cut_{i}), level_{i + 1} AS (SELECT document_id, sum(len(piece)) OVER (PARTITION BY document_id ORDER BY base, i) - len(piece) AS a, piece FROM flat_{i}), "
    return out + f"pieces_ AS (SELECT * FROM level_{len(separators)}), "


@query(
    f"WITH RECURSIVE {_atoms_sql(512, C.SEPARATORS)}{_cut_by_tokens(512)}{_full_runs(512)}"
    "ends_ AS (SELECT f.*, l.upto + l.tokens AS stop FROM full_ f JOIN units_ l ON l.document_id = f.document_id AND l.p = f.last - 1), "
    f"runs_of_ AS (SELECT e.document_id, e.p, e.n, e.last, e.last - count(v.p) FILTER (e.stop - v.upto <= 64) AS following FROM ends_ e LEFT JOIN units_ v ON v.document_id = e.document_id AND v.p > e.p AND v.p < e.last GROUP BY e.document_id, e.p, e.n, e.last), {_RUNS}"
)
def chunk_recursive(spark: SparkSession, d: str) -> DataFrame:
    return _chunked(spark, d, "recursive:512:64")


def _hashed(source: str, key: str, text: str) -> str:
    """``key, dim, x``: the nonzero numbers of the hashing embedder's vectors."""
    words = f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\r\\n\\f\\v]+')"
    return f"SELECT {key}, h % 64 AS dim, sum(CASE WHEN h >> 31 = 1 THEN 1 ELSE -1 END)::DOUBLE AS x FROM (SELECT {key}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM (SELECT {key}, unnest({words}) AS w FROM {source})) GROUP BY ALL"


@query(
    f"WITH RECURSIVE {_SENTENCES}{_cut_by_tokens(512)}{_full_runs(512)}"
    "body_ AS (SELECT document_id, p, substr(content, CAST(a AS INT) + 1, CAST(b - a AS INT)) AS body FROM units_ JOIN papers_ USING (document_id)), "
    f"vec_ AS ({_hashed('body_', 'document_id, p', 'body')}), len_ AS (SELECT document_id, p, sqrt(sum(x * x)) AS l FROM vec_ GROUP BY ALL), "
    "dot_ AS (SELECT v.document_id, v.p, sum(v.x * w.x) AS s FROM vec_ v JOIN vec_ w ON w.document_id = v.document_id AND w.p = v.p + 1 AND w.dim = v.dim GROUP BY ALL), "
    "gap_ AS (SELECT u.document_id, u.p, round(1 - greatest(-1, least(1, coalesce(s / nullif(l.l * m.l, 0), 0))), 9) AS gap FROM units_ u LEFT JOIN dot_ d ON d.document_id = u.document_id AND d.p = u.p LEFT JOIN len_ l ON l.document_id = u.document_id AND l.p = u.p LEFT JOIN len_ m ON m.document_id = u.document_id AND m.p = u.p + 1 WHERE u.p + 1 < u.n), "
    "thr_ AS (SELECT document_id, CASE WHEN max(gap) > min(gap) THEN quantile_cont(gap, 0.9) END AS thr FROM gap_ GROUP BY ALL), "
    "stop_ AS (SELECT f.*, min(CASE WHEN gap >= thr THEN f.p + 1 END) OVER (PARTITION BY f.document_id ORDER BY f.p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM full_ f LEFT JOIN gap_ g ON g.document_id = f.document_id AND g.p = f.p LEFT JOIN thr_ t ON t.document_id = f.document_id), "
    f"runs_of_ AS (SELECT document_id, p, n, least(last, coalesce(stop, n)) AS last, least(last, coalesce(stop, n)) AS following FROM stop_), {_RUNS}"
)
def chunk_semantic(spark: SparkSession, d: str) -> DataFrame:
    return _chunked(spark, d, "semantic:512:90", V.get_embedder("hashing"))


@query(
    f"WITH {_PAPERS}, w AS (SELECT document_id, regexp_extract_all(content, '{_SENTENCE_SQL}') AS ps FROM papers_ WHERE content <> ''), "
    "t AS (SELECT document_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS pos FROM w) "
    "SELECT document_id, CAST(pos - 1 AS INT) AS pos, piece AS sentence FROM t WHERE regexp_matches(piece, '[^ \\t\\r\\n\\f]')"
)
def sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = texts(spark, d).filter("content is not null").select("document_id", F.posexplode(C.sentence_pieces(F.col("content"))).alias("pos", "sentence"))
    return rows.filter(F.col("sentence").rlike("[^ \t\r\n\f]"))


@query(
    f"WITH {_CHUNKS} SELECT document_id, count(*) AS chunks, round(avg(num_tokens), 6) AS mean_tokens FROM chunks_ GROUP BY document_id"
)
def chunk_stats_by_doc(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_stats(chunks(spark, d)).withColumn("mean_tokens", F.round("mean_tokens", 6))


@query(
    f"WITH {_CHUNKS} SELECT chunker, count(*) AS chunks, min(num_tokens) AS min_tokens, list_sort(list(num_tokens))[count(*) // 2 + 1] AS p50_tokens, max(num_tokens) AS max_tokens, round(avg(num_tokens), 6) AS mean_tokens, round(avg(num_chars), 6) AS mean_chars FROM chunks_ WHERE num_tokens IS NOT NULL GROUP BY chunker"
)
def chunk_summary(spark: SparkSession, d: str) -> DataFrame:
    s = C.chunk_summary(chunks(spark, d))
    return s.select("chunker", "chunks", "min_tokens", "p50_tokens", "max_tokens", F.round("mean_tokens", 6).alias("mean_tokens"), F.round("mean_chars", 6).alias("mean_chars"))


@query(
    f"WITH {_PAPERS}, {_CHUNKS}, j AS (SELECT c.content AS x, CASE WHEN end_char > start_char THEN substr(p.content, start_char + 1, end_char - start_char) ELSE '' END AS y FROM chunks_ c LEFT JOIN papers_ p USING (document_id)) "
    "SELECT count(*) AS chunks, CAST(count_if(NOT coalesce(x = y, false)) AS BIGINT) AS broken FROM j"
)
def verify_offsets(spark: SparkSession, d: str) -> DataFrame:
    return C.verify_offsets(texts(spark, d), chunk_texts(spark, d))


# --- vectors ---------------------------------------------------------------------------


@query(f"WITH {_VECTORS}, n AS (SELECT chunk_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS l FROM vectors_) SELECT chunk_id, round(l, 4) AS length, round(CASE WHEN l > 0 THEN embedding[1]::DOUBLE / l ELSE 0 END, 4) + 0 AS first FROM n")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return v.select("chunk_id", F.round(norm(F.col("embedding")), 4).alias("length"), (F.round(F.element_at(unit(F.col("embedding")), 1), 4) + 0.0).alias("first"))


_ADJACENT = (
    f"{_VECTORS}, u AS (SELECT string_split(chunk_id, ':')[1] AS doc, chunk_index, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM vectors_), "
    "a AS (SELECT doc, chunk_index, v, l, lead(v) OVER w AS v2, lead(l) OVER w AS l2 FROM u WINDOW w AS (PARTITION BY doc ORDER BY chunk_index)), "
    "adjacent_ AS (SELECT doc, chunk_index, 1 - greatest(-1, least(1, CASE WHEN l > 0 AND l2 > 0 THEN list_dot_product(v, v2) / l / l2 ELSE 0 END)) AS distance FROM a WHERE v2 IS NOT NULL)"
)


def _adjacent(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).withColumn("doc", F.split("chunk_id", ":")[0])
    return C.adjacent_distances(v, "doc", "chunk_index", "embedding")


@query(f"WITH {_ADJACENT} SELECT doc, chunk_index, round(distance, 6) AS distance FROM adjacent_")
def adjacent_distance(spark: SparkSession, d: str) -> DataFrame:
    return _adjacent(spark, d).withColumn("distance", F.round("distance", 6))


@query(f"WITH {_ADJACENT} SELECT doc, count(*) AS pairs, CASE WHEN max(round(distance, 9)) > min(round(distance, 9)) THEN round(quantile_cont(distance, 0.9), 5) END AS threshold FROM adjacent_ GROUP BY doc")
def seam_threshold(spark: SparkSession, d: str) -> DataFrame:
    rows, r = _adjacent(spark, d), F.round("distance", 9)
    cut = F.when(F.max(r) > F.min(r), F.round(F.percentile("distance", F.lit(0.9)), 5))
    return rows.groupBy("doc").agg(F.count(F.lit(1)).alias("pairs"), cut.alias("threshold"))


@query(
    "SELECT count(*) AS vectors, count(*) FILTER (embedding IS NULL) AS missing, count(*) FILTER (len(embedding) = 0) AS empty, count(DISTINCT len(embedding)) FILTER (len(embedding) > 0) AS widths, CAST(min(len(embedding)) AS INT) AS least_width, CAST(max(len(embedding)) AS INT) AS most_width FROM chunk_vectors"
)
def vector_table_checks(spark: SparkSession, d: str) -> DataFrame:
    return V.vector_checks(read_table(spark, d, "chunk_vectors"))


@query(
    "WITH v AS (SELECT DISTINCT chunk_id FROM chunk_vectors), c AS (SELECT DISTINCT chunk_id FROM chunks) SELECT count(v.chunk_id) AS vectors, count(c.chunk_id) AS chunks, count(*) FILTER (c.chunk_id IS NULL) AS without_chunk, count(*) FILTER (v.chunk_id IS NULL) AS without_vector FROM v FULL JOIN c ON v.chunk_id = c.chunk_id"
)
def index_integrity(spark: SparkSession, d: str) -> DataFrame:
    return V.index_integrity(read_table(spark, d, "chunk_vectors"), read_table(spark, d, "chunks"))


@query(
    "WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings), "
    "s AS (SELECT q.vec_id AS query_id, r.vec_id, round(list_dot_product(q.v, r.v) / q.l / r.l, 6) AS score FROM u q, u r WHERE q.vec_id % 20 = 0), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM k WHERE rank <= 10"
)
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "embeddings")
    q = rows.filter(every_twentieth(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "embedding")
    return V.dense_topk(rows, q, 10, "vec_id", unique=True)


@query(
    f"WITH {_VECTORS}, r AS (SELECT chunk_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM vectors_), "
    "s AS (SELECT q.chunk_id AS query_id, r.chunk_id, round(CASE WHEN q.l > 0 AND r.l > 0 THEN list_dot_product(q.v, r.v) / q.l / r.l ELSE 0 END, 6) AS score FROM r q, r WHERE CAST(right(q.chunk_id, 4) AS INT) % 20 = 0), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) SELECT query_id, CAST(rank AS INT) AS rank, chunk_id, score FROM k WHERE rank <= 5"
)
def chunk_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    q = rows.filter(every_twentieth(F.right("chunk_id", F.lit(4)).cast("int"))).select(F.col("chunk_id").alias("query_id"), "embedding")
    return V.dense_topk(rows, q, 5, unique=True)


@query(f"WITH {_CHUNKS}, e AS ({_hashed('chunks_', 'chunk_id', 'content')}) SELECT chunk_id, 64 AS width, round(coalesce(sqrt(sum(x * x)), 0), 4) AS length FROM chunks_ LEFT JOIN e USING (chunk_id) GROUP BY ALL")
def embed_hash(spark: SparkSession, d: str) -> DataFrame:
    v = V.embed_column(F.col("content"), V.get_embedder("hashing"))
    return chunk_texts(spark, d).select("chunk_id", v.alias("v")).select("chunk_id", F.size("v").alias("width"), F.round(norm(F.col("v")), 4).alias("length"))


# --- lexical search and fusion ---------------------------------------------------------


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_terms('text')}) AS term FROM documents) GROUP BY ALL")
def bm25_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = lexical.term_rows(read_table(spark, d, "documents"), "doc_id", "text", stem=False)
    return rows.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


@query()
def bm25_tokens_stemmed(spark: SparkSession, d: str) -> DataFrame:
    terms = lexical.term_rows(read_table(spark, d, "documents"), "doc_id", "text", stem=False).select("term").distinct()
    return terms.select("term", porter_stem("term").alias("stem"))


def _index_sql(group: str) -> str:
    """The tables of BM25 indexes, one for each value of ``group``."""
    return (
        f"{_CHUNKS}, t AS (SELECT {group} AS chunker, chunk_id, {_terms('content')} AS ts FROM chunks_), o AS (SELECT chunker, chunk_id, unnest(CASE WHEN len(ts) > 0 THEN ts ELSE ['<empty>'] END) AS term FROM t), "
        "tf AS (SELECT chunker, chunk_id, term, count(*) AS tf FROM o GROUP BY ALL), dl AS (SELECT chunker, chunk_id, sum(tf) AS dl FROM tf GROUP BY ALL), size AS (SELECT chunker, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY ALL), "
        "df AS (SELECT chunker, term, count(*) AS df FROM tf GROUP BY ALL), raw AS (SELECT chunker, term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS w, avgdl FROM df JOIN size USING (chunker)), "
        "mean AS (SELECT chunker, avg(w) AS mean FROM raw GROUP BY ALL), idf AS (SELECT chunker, term, df, CASE WHEN w < 0 THEN 0.25 * mean ELSE w END AS idf, avgdl FROM raw JOIN mean USING (chunker))"
    )


_INDEX = _index_sql("coalesce(chunker, '')")


@query(f"WITH {_INDEX} SELECT chunker, term, df, round(idf, 6) AS idf FROM idf WHERE term <> '<empty>'")
def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    w = lexical.fit(by_chunker(spark, d), stem=False, group="chunker").weights
    return w.select("chunker", "term", "df", F.round("idf", 6).alias("idf"))


@query(
    f"WITH {_INDEX}, {_ASKED}, q AS (SELECT query_id, term, count(*) AS m FROM (SELECT query_id, unnest({_terms('query')}) AS term FROM asked_) GROUP BY ALL), "
    "s AS (SELECT query_id, chunker, chunk_id, round(sum(m * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN idf USING (term) JOIN tf USING (chunker, term) JOIN dl USING (chunker, chunk_id) GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunker ORDER BY score DESC, chunk_id) AS rank FROM s) SELECT query_id, chunker, CAST(rank AS INT) AS rank, chunk_id, score FROM r WHERE rank <= 5 AND score > 0"
)
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best chunks of every chunker, each with an index of its own."""
    return lexical.search(lexical.fit(by_chunker(spark, d), stem=False, group="chunker"), asked(spark, d), 5)


@query()
def bm25_topk_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """The best chunks of every chunker, each with an index of its own."""
    return lexical.search(lexical.fit(by_chunker(spark, d), stem=True, group="chunker"), asked(spark, d), 5)


@query(
    f"WITH {_SCORED}, b AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM scored_ WINDOW w AS (PARTITION BY query_id, retriever_type)) SELECT query_id, retriever_type, chunk_id, round(CASE WHEN hi = lo THEN 1 ELSE (score - lo) / (hi - lo) END, 6) AS normalized FROM b"
)
def minmax_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = fusion.minmax(scored(spark, d), ["query_id", "retriever_type"])
    return rows.select("query_id", "retriever_type", "chunk_id", F.round("normalized", 6).alias("normalized"))


_SIDES = (
    f"{_RANKED}, pool AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM ranked_ WHERE rank <= 20 AND retriever_type IN ('dense', 'bm25') WINDOW w AS (PARTITION BY query_id, retriever_type)), "
    "norm AS (SELECT *, CASE WHEN hi = lo THEN 1 ELSE (score - lo) / (hi - lo) END AS x FROM pool)"
)


def _fused_sql(score: str) -> str:
    return (
        f"WITH {_SIDES}, f AS (SELECT query_id, chunk_id, round({score}, 6) AS score FROM norm GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f) "
        "SELECT query_id, CAST(rank AS INT) AS rank, chunk_id, score FROM r WHERE rank <= 5 AND score > 0"
    )


@query(_fused_sql("0.3 * coalesce(sum(x) FILTER (retriever_type = 'dense'), 0) + 0.7 * coalesce(sum(x) FILTER (retriever_type = 'bm25'), 0)"))
def hybrid_weighted_topk(spark: SparkSession, d: str) -> DataFrame:
    depth = fusion.pool_depth(5)
    return fusion.weighted(top_scored(spark, d, depth, "dense"), top_scored(spark, d, depth, "bm25"), 5, alpha=0.3)


@query(_fused_sql("sum(1.0::DOUBLE / (60 + rank))"))
def hybrid_rrf_topk(spark: SparkSession, d: str) -> DataFrame:
    depth = fusion.pool_depth(5)
    return fusion.reciprocal_rank([top_scored(spark, d, depth, "dense"), top_scored(spark, d, depth, "bm25")], 5)


_LEXICAL = "s AS (SELECT query_id, chunk_id, round(sum(m * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN idf USING (term) JOIN tf USING (chunker, term) JOIN dl USING (chunker, chunk_id) GROUP BY ALL)"


@query(
    f"WITH {_index_sql(repr(''))}, {_ASKED}, q AS (SELECT query_id, term, count(*) AS m FROM (SELECT query_id, unnest({_terms('query')}) AS term FROM asked_) GROUP BY ALL), {_LEXICAL}, "
    "sparse AS (SELECT query_id, chunk_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 20), "
    f"qe AS ({_hashed('asked_', 'query_id', 'query')}), ce AS ({_hashed('chunks_', 'chunk_id', 'content')}), ql AS (SELECT query_id, sqrt(sum(x * x)) AS l FROM qe GROUP BY ALL), cl AS (SELECT chunk_id, sqrt(sum(x * x)) AS l FROM ce GROUP BY ALL), "
    "dots AS (SELECT query_id, chunk_id, sum(qe.x * ce.x) AS s FROM qe JOIN ce USING (dim) GROUP BY ALL), "
    "cosines AS (SELECT a.query_id, c.chunk_id, round(coalesce(dots.s / nullif(ql.l * cl.l, 0), 0), 6) AS score FROM (SELECT query_id FROM asked_ WHERE regexp_matches(query, '[^ \\t\\r\\n\\f]')) a CROSS JOIN (SELECT chunk_id FROM chunks_) c LEFT JOIN dots ON dots.query_id = a.query_id AND dots.chunk_id = c.chunk_id LEFT JOIN ql ON ql.query_id = a.query_id LEFT JOIN cl ON cl.chunk_id = c.chunk_id), "
    "dense AS (SELECT * FROM cosines QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 20), "
    "sides AS (SELECT 'd' AS side, * FROM dense UNION ALL SELECT 's' AS side, * FROM sparse WHERE score > 0), "
    "scaled AS (SELECT query_id, chunk_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS x FROM sides WINDOW w AS (PARTITION BY query_id, side)), "
    "f AS (SELECT query_id, chunk_id, round(0.5 * sum(x), 6) AS score FROM scaled GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f) SELECT query_id, CAST(rank AS INT) AS rank, chunk_id, score FROM r WHERE rank <= 5 AND score > 0"
)
def hybrid_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and queries embedded, searched by vectors and by terms, and fused."""
    embedder, rows = V.get_embedder("hashing"), chunk_texts(spark, d).select("chunk_id", "content")
    built = pipeline.Index(rows, rows.select("chunk_id", V.embed_column(F.col("content"), embedder).alias("embedding")), lexical.fit(rows, stem=False), embedder)
    return pipeline.retrieve(built, asked(spark, d), "hybrid:0.5:weighted", 5).drop("retriever_type")


@query(f"WITH {_INDEX} SELECT chunker, count(*) AS postings, count(DISTINCT term) AS terms, CAST(sum(tf) AS BIGINT) AS occurrences FROM tf WHERE term <> '<empty>' GROUP BY ALL")
def bm25_stored(spark: SparkSession, d: str) -> DataFrame:
    """An index written and read again."""
    path = f"{shared_dir(spark)}/bm25-{uuid.uuid4().hex}"
    lexical.write_index(lexical.fit(by_chunker(spark, d), stem=False, group="chunker"), path)
    p = lexical.read_index(spark, path).postings
    return p.groupBy("chunker").agg(F.count(F.lit(1)).alias("postings"), F.count_distinct("term").alias("terms"), F.sum("tf").alias("occurrences"))


@query(
    f"WITH {_RANKED} SELECT query_id, CAST(rank AS INT) AS rank, max(chunk_id) FILTER (retriever_type = 'dense') AS dense, max(chunk_id) FILTER (retriever_type = 'bm25') AS bm25, max(chunk_id) FILTER (retriever_type = 'hybrid') AS hybrid FROM ranked_ WHERE rank <= 5 AND retriever_type IN ('dense', 'bm25', 'hybrid') GROUP BY query_id, rank"
)
def retriever_compare(spark: SparkSession, d: str) -> DataFrame:
    return fusion.compare({k: top_scored(spark, d, 5, k) for k in ("dense", "bm25", "hybrid")})


@query(f"WITH {_SCORED} SELECT query_id, chunk_id, round(CASE WHEN score < -60 THEN 0 WHEN score > 60 THEN 1 ELSE 1 / (1 + exp(-score)) END, 6) AS probability FROM scored_ WHERE retriever_type = 'bm25'")
def sigmoid_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).filter("retriever_type = 'bm25'")
    return rows.select("query_id", "chunk_id", F.round(sigmoid(F.col("score")), 6).alias("probability"))


@query(
    f"WITH {_RANKED}, {_CHUNKS}, q AS (SELECT DISTINCT query_id, list_distinct({_terms('query')}) AS qt FROM queries WHERE query IS NOT NULL), "
    f"p AS (SELECT r.query_id, r.chunk_id, r.rank, coalesce(qt, []) AS qt, {_terms('c.content')} AS ct FROM ranked_ r LEFT JOIN q USING (query_id) LEFT JOIN chunks_ c USING (chunk_id) WHERE r.retriever_type = 'hybrid' AND r.rank <= 20), "
    "h AS (SELECT query_id, chunk_id, rank, len(qt) AS n, len(list_intersect(qt, coalesce(ct, []))) AS hit FROM p), "
    "s AS (SELECT *, round(1 / (1 + exp(-(hit - (n - hit) * 0.5::DOUBLE))), 6) AS score FROM h), "
    "z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, chunk_id) AS new FROM s) "
    "SELECT query_id, CAST(new AS INT) AS rank, chunk_id, score, CAST(rank AS INT) AS original_rank FROM z WHERE new <= 5"
)
def rerank_overlap(spark: SparkSession, d: str) -> DataFrame:
    first = top_scored(spark, d, rerank.rerank_depth(5), "hybrid").select("query_id", "rank", "chunk_id", "score")
    return rerank.rerank(first, read_table(spark, d, "queries"), chunks(spark, d), 5)


# --- answers ---------------------------------------------------------------------------


def _passages(spark: SparkSession, d: str, k: int) -> DataFrame:
    """The first chunks of every query by the hybrid ranking, with their texts."""
    top = top_scored(spark, d, k, "hybrid").select("query_id", "rank", "chunk_id", "score")
    return top.join(chunks(spark, d).select("chunk_id", "source", "page_number", "content"), "chunk_id")


_PASSAGES = f"{_RANKED}, {_CHUNKS}, passages_ AS (SELECT r.query_id, CAST(r.rank AS INT) AS rank, r.chunk_id, r.score, c.source, c.page_number, c.content FROM ranked_ r JOIN chunks_ c USING (chunk_id) WHERE r.retriever_type = 'hybrid' AND r.rank <= 3)"
_LABEL = "'[' || rank || '] ' || source || coalesce(' p' || page_number, '')"


@query(f"WITH {_CHUNKS} SELECT chunk_id, '[1] ' || source || coalesce(' p' || page_number, '') AS label, {_snippet('content', 300, '...')} AS snippet FROM chunks_")
def passage_snippets(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_texts(spark, d)
    return c.select("chunk_id", T.passage_label(F.lit(1), F.col("source"), F.col("page_number")).alias("label"), T.snippet(F.col("content"), 300, "...").alias("snippet"))


@query(f"WITH {_PASSAGES} SELECT query_id, string_agg(coalesce({_LABEL} || chr(10) || {_snippet('content', 5000, ' ...')}, ''), chr(10) || chr(10) ORDER BY rank) AS context FROM passages_ GROUP BY query_id")
def build_context(spark: SparkSession, d: str) -> DataFrame:
    return A.build_context(_passages(spark, d, 3))


_ANSWERS = "answers_ AS (SELECT query_id, min(answer) AS answer FROM relevance WHERE answer IS NOT NULL GROUP BY query_id)"
_MARK = (
    f"{_ANSWERS}, g AS (SELECT query_id, unnest(regexp_extract_all(answer, '\\[\\s*(\\d+(?:\\s*[,;-]\\s*\\d+)*)\\s*\\]', 1)) AS g FROM answers_), p AS (SELECT query_id, string_split_regex(unnest(string_split_regex(g, '\\s*[,;]\\s*')), '\\s*-\\s*') AS e FROM g), "
    "n AS (SELECT query_id, TRY_CAST(e[1] AS INT) AS lo, TRY_CAST(e[2] AS INT) AS hi, e FROM p), "
    "marks_ AS (SELECT DISTINCT query_id, marker FROM (SELECT query_id, unnest(CASE WHEN len(e) = 2 AND hi > lo AND hi - lo <= 10 AND hi <= 100 THEN range(lo, hi + 1) ELSE list_transform(e, lambda x: TRY_CAST(x AS BIGINT)) END) AS marker FROM n) WHERE marker IS NOT NULL)"
)


def _gold_answers(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "relevance").filter("answer is not null").groupBy("query_id").agg(F.min("answer").alias("answer"))


@query(f"WITH {_MARK} SELECT query_id, CAST(marker AS INT) AS marker FROM marks_")
def parse_markers(spark: SparkSession, d: str) -> DataFrame:
    return _gold_answers(spark, d).select("query_id", F.explode(A.parse_markers(F.col("answer"))).alias("marker"))


@query(f"WITH {_MARK} SELECT query_id, CAST(marker AS INT) AS marker FROM marks_ WHERE marker < 1 OR marker > 3")
def unresolved_markers(spark: SparkSession, d: str) -> DataFrame:
    marks = A.parse_markers(F.col("answer"))
    return _gold_answers(spark, d).select("query_id", F.explode(A.unresolved_markers(marks, F.lit(3))).alias("marker"))


@query(f"WITH {_PASSAGES}, {_MARK} SELECT query_id, CAST(marker AS INT) AS marker, chunk_id, source, page_number, {_snippet('content', 300, '...')} AS text_snippet, score AS relevance_score FROM marks_ JOIN passages_ USING (query_id) WHERE rank = marker")
def citations(spark: SparkSession, d: str) -> DataFrame:
    return A.citations(_gold_answers(spark, d), _passages(spark, d, 3)).drop("position")


@query(
    f"WITH {_RANKED}, n AS (SELECT query_id, count(*) AS n FROM ranked_ WHERE retriever_type = 'hybrid' AND rank <= 3 GROUP BY ALL), {_ANSWERS}, "
    "a AS (SELECT query_id, coalesce(answer, 'insufficient_context') AS raw FROM (SELECT DISTINCT query_id FROM queries) LEFT JOIN answers_ USING (query_id)) "
    f"SELECT query_id, CASE WHEN n IS NULL THEN '{A.NO_CONTEXT}' WHEN starts_with(upper(trim(raw)), '{A.ABSTAIN_WORD}') THEN '{A.ABSTAINED}' ELSE raw END AS answer, CASE WHEN n IS NULL OR starts_with(upper(trim(raw)), '{A.ABSTAIN_WORD}') THEN 0.0::DOUBLE END AS confidence FROM a LEFT JOIN n USING (query_id)"
)
def answer_status(spark: SparkSession, d: str) -> DataFrame:
    n = top_scored(spark, d, 3, "hybrid").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    rows = read_table(spark, d, "queries").select("query_id").distinct().join(_gold_answers(spark, d), "query_id", "left").join(n, "query_id", "left")
    return rows.select("query_id", A.answer_status(F.coalesce("answer", F.lit("insufficient_context")), F.col("n")).alias("s")).select("query_id", "s.*")


@query(f"WITH {_PASSAGES} SELECT query_id, string_agg({_snippet('content', 120, '...')} || ' [' || rank || ']', ' ' ORDER BY rank) AS answer FROM passages_ WHERE rank <= 2 GROUP BY query_id")
def answer_extractive(spark: SparkSession, d: str) -> DataFrame:
    return A.extractive_answer(_passages(spark, d, 3))


USAGE_PRICES = [("small", 0.4, 0.1, 1.6), ("medium", 2.5, None, 10.0), ("large", 10.0, 2.5, 40.0)]
@query(
    f"WITH {_PASSAGES}, {_ANSWERS}, x AS (SELECT query_id, string_agg(coalesce({_LABEL} || chr(10) || {_snippet('content', 5000, ' ...')}, ''), chr(10) || chr(10) ORDER BY rank) AS context, string_agg({_snippet('content', 120, '...')} || ' [' || rank || ']', ' ' ORDER BY rank) FILTER (rank <= 2) AS answer FROM passages_ GROUP BY query_id), "
    "q AS (SELECT DISTINCT query_id, query FROM queries) SELECT query_id, 'Question:' || chr(10) || coalesce(query, '') || chr(10) || chr(10) || 'Passages:' || chr(10) || coalesce(context, '(no passages were retrieved)') || chr(10) || chr(10) || 'Answer:' || chr(10) || coalesce(x.answer, '') || chr(10) || "
    f"coalesce(chr(10) || 'Reference answer:' || chr(10) || a.answer || chr(10), '') || chr(10) || 'Give JSON with {', '.join(A.JUDGED)} from 1 to 5 and a rationale.' AS prompt FROM q LEFT JOIN x USING (query_id) LEFT JOIN answers_ a USING (query_id)"
)
def judge_prompts(spark: SparkSession, d: str) -> DataFrame:
    passages = _passages(spark, d, 3)
    asked_ = read_table(spark, d, "queries").select("query_id", "query").dropDuplicates(["query_id"])
    rows = asked_.join(A.extractive_answer(passages), "query_id", "left")
    return A.judge_prompts(rows, A.build_context(passages), _gold_answers(spark, d).withColumnRenamed("answer", "reference"))


_PRICES = "prices_(model, pin, pcached, pout) AS (VALUES " + ", ".join(f"('{m}', {i}::DOUBLE, {'NULL' if c is None else c}::DOUBLE, {o}::DOUBLE)" for m, i, c, o in USAGE_PRICES) + ")"


@query(
    f"WITH {_PRICES}, u AS (SELECT doc_id, CASE kind WHEN 'answer' THEN 'small' WHEN 'rationale' THEN 'large' WHEN 'excerpt' THEN 'medium' ELSE 'unlisted' END AS model, coalesce(len(text), 0) AS i, coalesce(len(text), 0) // 2 AS c, 100 AS o FROM documents) "
    "SELECT doc_id, u.model, round((i * pin + c * coalesce(pcached, pin) + o * pout) / 1e6, 9) AS cost_usd FROM u LEFT JOIN prices_ p ON p.model = u.model"
)
def llm_cost(spark: SparkSession, d: str) -> DataFrame:
    n = F.coalesce(F.length("text"), F.lit(0))
    model = F.when(F.col("kind") == "answer", "small").when(F.col("kind") == "rationale", "large").when(F.col("kind") == "excerpt", "medium").otherwise("unlisted")
    usage = read_table(spark, d, "documents").select("doc_id", model.alias("model"), n.alias("input_tokens"), F.floor(n / 2).alias("cached_tokens"), F.lit(100).alias("output_tokens"))
    prices = spark.createDataFrame(USAGE_PRICES, "model STRING, input_per_1m DOUBLE, cached_input_per_1m DOUBLE, output_per_1m DOUBLE")
    return A.cost(usage, prices).select("doc_id", "model", F.round("cost_usd", 9).alias("cost_usd"))


def _judge_raw(spark: SparkSession, d: str) -> DataFrame:
    """Judge outputs made from the lengths of queries: some marks out of range, some no JSON."""
    q = read_table(spark, d, "queries").dropDuplicates(["query_id"])
    n = F.coalesce(F.length("query"), F.lit(0))
    marks = F.struct(*[(n % m).alias(name) for name, m in zip(A.JUDGED, (6, 5, 7, 6))], F.lit("r").alias("rationale"))
    return q.select("query_id", F.when(n % 11 == 0, F.lit("no json")).otherwise(F.to_json(marks)).alias("raw"))


_JUDGED = (
    "j AS (SELECT query_id, n % 6 AS relevance, n % 5 AS accuracy, n % 7 AS completeness, n % 6 AS citation_quality FROM (SELECT DISTINCT query_id, CAST(coalesce(len(query), 0) AS INT) AS n FROM queries) WHERE n % 11 <> 0), "
    "judged_ AS (SELECT *, (relevance + accuracy + completeness + citation_quality) / 4.0::DOUBLE AS average FROM j WHERE relevance BETWEEN 1 AND 5 AND accuracy BETWEEN 1 AND 5 AND completeness BETWEEN 1 AND 5 AND citation_quality BETWEEN 1 AND 5)"
)


@query(f"WITH {_JUDGED} SELECT query_id, relevance, accuracy, completeness, citation_quality, average, (average - 1) / 4 AS confidence FROM judged_")
def judge_scores(spark: SparkSession, d: str) -> DataFrame:
    return A.judge_scores(_judge_raw(spark, d))


@query(
    f"WITH {_JUDGED} SELECT count(*) AS scored, round(avg(relevance), 6) AS relevance, round(avg(accuracy), 6) AS accuracy, round(avg(completeness), 6) AS completeness, round(avg(citation_quality), 6) AS citation_quality, round(avg(average), 6) AS average, coalesce(avg(citation_quality) < 3.5, false) AS citation_quality_is_low FROM judged_"
)
def judge_means(spark: SparkSession, d: str) -> DataFrame:
    return A.judge_means(A.judge_scores(_judge_raw(spark, d)))


# --- sections and relevance ------------------------------------------------------------


def _starts(spark: SparkSession, d: str) -> DataFrame:
    """Where the sections of every document start, by the chunks labelled with them."""
    c = chunks(spark, d).filter("end_char > start_char")
    n = papers(spark, d).filter("content is not null").select("document_id", F.length("content").alias("n"))
    rows = c.select("document_id", "paper_id", "start_char", F.explode("section_indices").alias("section_index"))
    starts = rows.groupBy("document_id", "paper_id", "section_index").agg(F.min("start_char").alias("start_char"), F.count(F.lit(1)).cast("int").alias("probe_hits"))
    return starts.join(n, "document_id")


_TILES = (
    f"{_CHUNKS}, {_PAPERS}, r AS (SELECT document_id, paper_id, start_char, unnest(section_indices) AS section_index FROM chunks_ WHERE end_char > start_char), "
    "b AS (SELECT document_id, r.paper_id, section_index, min(start_char) AS start_char, CAST(count(*) AS INT) AS probe_hits FROM r GROUP BY ALL), "
    "tiles_ AS (SELECT document_id, b.paper_id, section_index, start_char, CAST(coalesce(lead(start_char) OVER (PARTITION BY document_id ORDER BY start_char, section_index), len(content)) AS INT) AS end_char, probe_hits FROM b JOIN papers_ p USING (document_id) WHERE content IS NOT NULL)"
)


@query(f"WITH {_TILES} SELECT * FROM tiles_")
def section_tiling(spark: SparkSession, d: str) -> DataFrame:
    return relevance.tile_sections(_starts(spark, d))


_OVERLAP = f"{_TILES}, overlap_ AS (SELECT c.chunk_id, c.paper_id, list_sort(list(DISTINCT t.section_index) FILTER (t.section_index IS NOT NULL)) AS found FROM chunks_ c LEFT JOIN tiles_ t ON t.document_id = c.document_id AND c.start_char < t.end_char AND c.end_char > t.start_char GROUP BY ALL)"


@query(f"WITH {_OVERLAP} SELECT chunk_id, coalesce(array_to_string(found, ','), '') AS sections FROM overlap_")
def chunk_section_overlap(spark: SparkSession, d: str) -> DataFrame:
    spans = relevance.tile_sections(_starts(spark, d))
    rows = relevance.assign_sections(chunks(spark, d), spans)
    return rows.select("chunk_id", F.array_join(F.col("section_indices").cast("array<string>"), ",").alias("sections"))


def _paragraph_sections(spark: SparkSession, d: str) -> DataFrame:
    """Every paragraph of a paper as a section of it."""
    p = texts(spark, d).filter("content is not null")
    return p.select("paper_id", F.posexplode(F.split("content", "\n\n")).alias("section_index", "text"))


_PROSE = r"regexp_replace(lower(regexp_replace(text, '\$\$.*?\$\$|\$[^$]*\$|\\begin\{.*?\}.*?\\end\{.*?\}|\\[a-zA-Z]+\s*|<[^>]{1,60}>', ' ', 'gs')), '[^a-z0-9]', '', 'g')"


# Sections one after the other: from the cursor, the first probe found says where a section
# begins, and the cursor moves behind that. Fallback probes are shorter, at the first offsets.
_FOUND = (
    "list_filter(list_transform({probes}, lambda o: [o, strpos(substr(flat, cursor + 1), substr(p, CAST(o AS INT) + 1, {width})) - 1]), lambda x: x[2] >= 0)"
)


@query(
    f"WITH RECURSIVE {_PAPERS}, doc_ AS (SELECT document_id, paper_id, content, regexp_replace(lower(content), '[^a-z0-9]', '', 'g') AS flat, list_filter(range(len(content)), lambda i: regexp_matches(lower(content[i + 1]), '^[a-z0-9]')) AS spots FROM papers_ WHERE content IS NOT NULL), "
    f"sec_ AS (SELECT paper_id, i - 1 AS i, {_PROSE} AS p FROM (SELECT paper_id, unnest(ps) AS text, generate_subscripts(ps, 1) AS i FROM (SELECT paper_id, string_split(content, chr(10) || chr(10)) AS ps FROM papers_ WHERE content IS NOT NULL))), "
    "probed_ AS (SELECT *, CASE WHEN len(p) >= 40 THEN range(0, len(p) - 39, greatest(1, (len(p) - 40) // 12)) ELSE []::BIGINT[] END AS wide, range(0, least(4, greatest(len(p) - 23, 0))) AS near FROM sec_), "
    "walk_ AS (SELECT document_id, CAST(-1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS cursor, CAST(NULL AS BIGINT) AS place, CAST(0 AS BIGINT) AS hits FROM doc_ UNION ALL "
    "SELECT document_id, i, CASE WHEN place IS NULL THEN cursor ELSE place + 1 END, place, hits FROM (SELECT *, CASE WHEN spot < len(spots) THEN spot END AS place FROM (SELECT *, CASE WHEN len(w) > 0 THEN greatest(cursor, cursor + w[1][2] - w[1][1]) WHEN len(s) > 0 THEN greatest(cursor, cursor + s[1][2] - s[1][1]) END AS spot, CASE WHEN len(w) > 0 THEN len(w) ELSE 1 END AS hits FROM "
    f"(SELECT d.document_id, q.i, cursor, spots, {_FOUND.format(probes='wide', width=40)} AS w, {_FOUND.format(probes='near', width=24)} AS s FROM walk_ JOIN doc_ d USING (document_id) JOIN probed_ q ON q.paper_id = d.paper_id AND q.i = walk_.i + 1)))), "
    "hit_ AS (SELECT document_id, paper_id, CAST(i AS INT) AS section_index, CAST(spots[place + 1] AS INT) AS start_char, len(content) AS n, CAST(hits AS INT) AS probe_hits FROM walk_ JOIN doc_ USING (document_id) WHERE place IS NOT NULL) "
    "SELECT document_id, paper_id, section_index, start_char, CAST(coalesce(lead(start_char) OVER (PARTITION BY document_id ORDER BY start_char, section_index), n) AS INT) AS end_char, probe_hits FROM hit_"
)
def locate_sections(spark: SparkSession, d: str) -> DataFrame:
    return relevance.locate_sections(texts(spark, d), _paragraph_sections(spark, d))




@query(
    f"WITH {_PAPERS}, a AS (SELECT paper_id, string_split(content, chr(10) || chr(10)) AS ps FROM papers_ WHERE content IS NOT NULL), s AS (SELECT paper_id, unnest(ps) AS text, CAST(generate_subscripts(ps, 1) - 1 AS INT) AS section_index FROM a), "
    f"z AS (SELECT paper_id, section_index, {_PROSE} AS p FROM s), o AS (SELECT paper_id, section_index, p, unnest(CASE WHEN len(p) >= 40 THEN range(0, len(p) - 39, greatest(1, (len(p) - 40) // 12)) WHEN len(p) > 0 THEN [0] ELSE [] END) AS offset_ FROM z) "
    'SELECT paper_id, section_index, CAST(offset_ AS INT) AS "offset", substr(p, offset_ + 1, 40) AS probe FROM o'
)
def probes(spark: SparkSession, d: str) -> DataFrame:
    return relevance.section_probes(_paragraph_sections(spark, d))


@query(
    f"WITH {_TILES}, o AS (SELECT chunk_id, paper_id, section_indices AS x FROM chunks_), secs AS (SELECT DISTINCT doc_id AS paper_id, section_id FROM qrels), p AS (SELECT DISTINCT paper_id FROM papers), "
    "q AS (SELECT (SELECT count(*) FROM p) AS papers, (SELECT count(*) FROM p WHERE paper_id NOT IN (SELECT paper_id FROM secs WHERE paper_id IS NOT NULL)) AS missing, (SELECT count(*) FROM secs WHERE paper_id IN (SELECT paper_id FROM p)) AS sections_total, (SELECT count(*) FROM tiles_) AS sections_located, (SELECT count(*) FROM tiles_ WHERE probe_hits <= 2) AS sections_weak, "
    "(SELECT count(*) FROM (SELECT DISTINCT paper_id, unnest(x) FROM o)) AS sections_with_chunks, (SELECT count(*) FROM o) AS chunks_total, (SELECT count(*) FROM o WHERE len(x) > 0) AS chunks_labelled, (SELECT count(*) FROM o WHERE len(x) > 1) AS chunks_multi) "
    "SELECT *, round(coalesce(sections_located / nullif(sections_total, 0), 0), 6) AS located_ratio, round(coalesce(chunks_labelled / nullif(chunks_total, 0), 0), 6) AS labelled_ratio FROM q"
)
def alignment_report(spark: SparkSession, d: str) -> DataFrame:
    gold = read_table(spark, d, "qrels").select(F.col("doc_id").alias("paper_id"), F.col("section_id").alias("section_index")).distinct()
    row = relevance.alignment_report(papers(spark, d), gold, relevance.tile_sections(_starts(spark, d)), chunks(spark, d))
    return row.withColumns({c: F.round(c, 6) for c in ("located_ratio", "labelled_ratio")})


_BY_SECTION = "by_section_ AS (SELECT DISTINCT paper_id AS doc_id, section_id, chunk_id FROM (SELECT paper_id, chunk_id, unnest(section_indices) AS section_id FROM chunks) WHERE paper_id IS NOT NULL AND section_id IS NOT NULL AND chunk_id IS NOT NULL), judged_ AS (SELECT DISTINCT query_id, doc_id, section_id FROM qrels WHERE doc_id IN (SELECT doc_id FROM by_section_))"


@query(f"WITH {_BY_SECTION} SELECT * FROM by_section_")
def chunks_by_section(spark: SparkSession, d: str) -> DataFrame:
    return relevance.chunks_by_section(chunks(spark, d))


@query(f"WITH {_BY_SECTION}, {_ANSWERS}, q AS (SELECT DISTINCT query_id, query FROM queries) SELECT j.query_id, coalesce(query, '') AS query, j.doc_id, j.section_id, chunk_id, answer FROM judged_ j JOIN by_section_ USING (doc_id, section_id) LEFT JOIN q ON q.query_id = j.query_id LEFT JOIN answers_ a ON a.query_id = j.query_id")
def build_relevance(spark: SparkSession, d: str) -> DataFrame:
    return relevance.build_relevance(read_table(spark, d, "qrels"), chunks(spark, d), read_table(spark, d, "queries"), _gold_answers(spark, d))


@query(f"WITH {_BY_SECTION} SELECT query_id, doc_id, section_id FROM judged_ ANTI JOIN by_section_ USING (doc_id, section_id)")
def unscoreable(spark: SparkSession, d: str) -> DataFrame:
    return relevance.unscoreable(read_table(spark, d, "qrels"), chunks(spark, d))


@query(
    f"WITH {_BY_SECTION}, s AS (SELECT DISTINCT doc_id, section_id FROM by_section_), j AS (SELECT judged_.*, s.doc_id IS NOT NULL AS hit FROM judged_ LEFT JOIN s ON s.doc_id = judged_.doc_id AND s.section_id = judged_.section_id) "
    "SELECT (SELECT count(*) FROM (SELECT DISTINCT query_id, doc_id, section_id FROM qrels)) AS queries_total, count(*) AS queries_in_corpus, count(*) FILTER (hit) AS queries_scoreable, count(DISTINCT doc_id || '#' || section_id) FILTER (NOT hit) AS sections_without_chunks FROM j"
)
def relevance_report(spark: SparkSession, d: str) -> DataFrame:
    return relevance.relevance_report(read_table(spark, d, "qrels"), chunks(spark, d))


# --- metrics ---------------------------------------------------------------------------


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    rel = read_table(spark, d, "relevance").select("query_id", "chunk_id")
    return metrics.query_metrics(top_scored(spark, d, 10, "hybrid"), rel)


def _metric_sql() -> str:
    cols = ["query_id", "round(coalesce(1.0::DOUBLE / min(rank), 0), 6) AS mrr"]
    for k in metrics.KS:
        hits = f"count(*) FILTER (rank <= {k})"
        ideal = f"list_sum(list_transform(range(1, least(count(*), {k}) + 1), lambda i: 1 / log2(i + 1)))"
        cols += [f"CAST({hits} > 0 AS DOUBLE) AS hit_rate_at_{k}", f"round({hits} / {k}, 6) AS precision_at_{k}", f"round({hits} / count(*), 6) AS coverage_at_{k}", f"round(coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= {k}), 0) / {ideal}, 6) AS ndcg_at_{k}"]
    return f"{_RANKED}, rel AS (SELECT DISTINCT query_id, chunk_id FROM relevance WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL), top AS (SELECT query_id, chunk_id, rank FROM ranked_ WHERE retriever_type = 'hybrid' AND rank <= 10), f AS (SELECT rel.query_id, top.rank FROM rel LEFT JOIN top ON top.query_id = rel.query_id AND top.chunk_id = rel.chunk_id), metrics_ AS (SELECT {', '.join(cols)} FROM f GROUP BY query_id)"


@query(f"WITH {_metric_sql()} SELECT * FROM metrics_")
def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d)


@query(f"WITH {_metric_sql()} UNPIVOT metrics_ ON COLUMNS(* EXCLUDE query_id) INTO NAME metric VALUE value")
def ir_metrics_long(spark: SparkSession, d: str) -> DataFrame:
    return metrics.long_metrics(_metrics(spark, d))


@query(f"WITH {_metric_sql()}, l AS (UNPIVOT metrics_ ON COLUMNS(* EXCLUDE query_id) INTO NAME metric VALUE value) SELECT metric, round(avg(value), 6) AS mean, count(*) AS num_queries FROM l GROUP BY metric")
def ir_means(spark: SparkSession, d: str) -> DataFrame:
    return metrics.mean_metrics(_metrics(spark, d))


@query(f"WITH {_metric_sql()}, ids AS (SELECT query_id, string_agg(chunk_id, ',' ORDER BY rank) AS ranked FROM top GROUP BY query_id) SELECT m.query_id, mrr, ndcg_at_5, coalesce(ranked, '') AS ranked FROM metrics_ m LEFT JOIN ids ON ids.query_id = m.query_id")
def evaluation_rows(spark: SparkSession, d: str) -> DataFrame:
    rel = read_table(spark, d, "relevance").select("query_id", "chunk_id")
    rows = metrics.evaluation_rows(top_scored(spark, d, 10, "hybrid"), rel)
    return rows.select("query_id", "mrr", "ndcg_at_5", F.array_join("ranked", ",").alias("ranked"))


@query(f"WITH {_metric_sql()}, l AS (SELECT DISTINCT metric FROM (UNPIVOT metrics_ ON COLUMNS(* EXCLUDE query_id) INTO NAME metric VALUE value)), n AS (SELECT replace(metric, '_at_', '@') AS metric FROM l), p AS (SELECT metric, split_part(metric, '@', 1) AS name FROM n) SELECT metric, CASE name WHEN 'mrr' THEN 'MRR' WHEN 'ndcg' THEN 'NDCG' ELSE array_to_string(list_transform(string_split(name, '_'), lambda w: upper(w[1]) || w[2:]), ' ') END || substr(metric, len(name) + 1) AS heading FROM p")
def pretty_metrics(spark: SparkSession, d: str) -> DataFrame:
    names = metrics.long_metrics(_metrics(spark, d)).select(F.replace("metric", F.lit("_at_"), F.lit("@")).alias("metric")).distinct()
    return names.select("metric", metrics.pretty(F.col("metric")).alias("heading"))


@query("SELECT doc_id AS paper_id, count(*) AS queries FROM qrels WHERE doc_id IN (SELECT paper_id FROM papers) AND doc_id IN (SELECT paper_id FROM chunks) GROUP BY doc_id")
def eligible_docs(spark: SparkSession, d: str) -> DataFrame:
    judged = read_table(spark, d, "qrels").withColumnRenamed("doc_id", "paper_id")
    return metrics.eligible(papers(spark, d), read_table(spark, d, "chunks"), key="paper_id", counted=judged)


@query("SELECT paper_id FROM (SELECT DISTINCT paper_id FROM papers) ORDER BY md5('7:' || paper_id), paper_id LIMIT 60")
def sample_docs(spark: SparkSession, d: str) -> DataFrame:
    return metrics.sample_keys(papers(spark, d), "paper_id", 60)


@query("WITH w AS (SELECT DISTINCT doc_id AS paper_id FROM qrels), p AS (SELECT DISTINCT paper_id FROM papers) SELECT coalesce(w.paper_id, p.paper_id) AS paper_id, CASE WHEN p.paper_id IS NULL THEN 'copied' WHEN w.paper_id IS NULL THEN 'removed' ELSE 'kept' END AS change FROM w FULL JOIN p ON w.paper_id = p.paper_id")
def working_set_diff(spark: SparkSession, d: str) -> DataFrame:
    wanted = read_table(spark, d, "qrels").select(F.col("doc_id").alias("paper_id"))
    return metrics.set_changes(wanted, papers(spark, d), "paper_id")


# --- configurations and runs -----------------------------------------------------------


@query("SELECT DISTINCT chunker, embedder, trim(regexp_replace(replace(chunker, '%', 'pct'), '[^A-Za-z0-9_.-]+', '_', 'g'), '_') || coalesce('__' || trim(regexp_replace(replace(embedder, '%', 'pct'), '[^A-Za-z0-9_.-]+', '_', 'g'), '_'), '') AS slug FROM chunks")
def config_slugs(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "chunks").select("chunker", "embedder").distinct()
    return c.select("chunker", "embedder", T.config_slug(F.col("chunker"), F.col("embedder")).alias("slug"))


@query("SELECT c.chunker, e.embedder, r.retriever FROM (SELECT DISTINCT chunker FROM chunks) c, (SELECT DISTINCT embedder FROM chunks WHERE embedder IS NOT NULL) e, (SELECT DISTINCT lower(trim(retriever_type)) AS retriever FROM rankings) r")
def grid_expand(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "chunks")
    r = read_table(spark, d, "rankings").select(F.lower(F.trim("retriever_type")).alias("retriever")).distinct()
    return X.expand_axes({"chunker": c.select("chunker").distinct(), "embedder": c.select("embedder").filter("embedder is not null").distinct(), "retriever": r})


@query("WITH " + runs_sql() + " SELECT chunker || '__' || embedder AS index_id, count(DISTINCT retriever) AS cells, string_agg(DISTINCT retriever, ',' ORDER BY retriever) AS retrievers FROM runs_ GROUP BY ALL")
def grid_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = runs_table(spark, d).groupBy(F.concat_ws("__", "chunker", "embedder").alias("index_id"))
    return rows.agg(F.count_distinct("retriever").alias("cells"), F.array_join(F.array_sort(F.collect_set("retriever")), ",").alias("retrievers"))


_VALID = runs_sql() + ", valid_ AS (SELECT * FROM runs_ WHERE cardinality(means) > 0)"
_DERIVED = (
    _VALID + ", derived_ AS (SELECT *, CASE WHEN split_part(retriever, ':', 1) = 'hybrid' THEN TRY_CAST(split_part(retriever, ':', 2) AS DOUBLE) END AS alpha, coalesce(nullif(split_part(retriever, ':', 3), ''), 'weighted') AS fusion, "
    "chunker || ' | ' || embedder || ' | ' || retriever AS label, CAST(try_strptime(regexp_extract(path, '(\\d{8}_\\d{6})[^/]*$', 1), '%Y%m%d_%H%M%S') AS TIMESTAMP) AS ts FROM valid_), "
    "latest_ AS (SELECT * FROM derived_ QUALIFY row_number() OVER (PARTITION BY experiment, config_id ORDER BY ts DESC NULLS LAST, path DESC) = 1), "
    "metric_ AS (SELECT path, label, fusion, alpha, chunker, embedder, retriever, unnest(map_keys(means)) AS metric, unnest(map_values(means)) AS value FROM latest_)"
)


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return X.latest(X.derive(X.valid(runs_table(spark, d)))).persist()  # a row a configuration, read several times


@query(f"WITH {_VALID} SELECT path, config_id, num_queries FROM valid_")
def runs_valid(spark: SparkSession, d: str) -> DataFrame:
    return X.valid(runs_table(spark, d)).select("path", "config_id", "num_queries")


@query(f"WITH {_DERIVED} SELECT path, alpha, fusion, label, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM derived_")
def runs_derived(spark: SparkSession, d: str) -> DataFrame:
    return X.derive(X.valid(runs_table(spark, d))).select("path", "alpha", "fusion", "label", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query(f"WITH {_DERIVED} SELECT experiment, config_id, path FROM latest_")
def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("experiment", "config_id", "path")


@query(f"WITH {_DERIVED} SELECT experiment, count(DISTINCT alpha) AS alphas FROM latest_ WHERE experiment <> '' AND alpha IS NOT NULL GROUP BY ALL HAVING count(DISTINCT alpha) > 1")
def sweeps(spark: SparkSession, d: str) -> DataFrame:
    return X.sweeps(_runs(spark, d))


@query(f"WITH {_DERIVED} SELECT metric FROM metric_ GROUP BY ALL HAVING count(DISTINCT path) = (SELECT count(DISTINCT path) FROM latest_)")
def available_metrics(spark: SparkSession, d: str) -> DataFrame:
    return X.common_metrics(_runs(spark, d))


@query(f"WITH {_DERIVED}, a AS (UNPIVOT (SELECT path, chunker, embedder, retriever FROM latest_) ON chunker, embedder, retriever INTO NAME axis VALUE axis_value) SELECT axis, count(DISTINCT axis_value) AS choices FROM a GROUP BY ALL HAVING count(DISTINCT axis_value) > 1")
def varying_axes(spark: SparkSession, d: str) -> DataFrame:
    return X.varying_axes(_runs(spark, d))


@query(
    f"WITH {_DERIVED}, b AS (SELECT label, means['ndcg@5'] AS value, ts, path FROM latest_ WHERE means['ndcg@5'] IS NOT NULL), lo AS (SELECT 'baseline' AS role, label, value FROM b ORDER BY value, ts NULLS LAST, path LIMIT 1), hi AS (SELECT 'best' AS role, label, value FROM b ORDER BY value DESC, ts NULLS LAST, path LIMIT 1) SELECT * FROM lo UNION ALL SELECT * FROM hi"
)
def baseline_vs_best(spark: SparkSession, d: str) -> DataFrame:
    return X.baseline_and_best(_runs(spark, d), "ndcg@5")


_GRID = _DERIVED + ", grid_ AS (SELECT * FROM latest_ WHERE experiment NOT IN (SELECT experiment FROM latest_ WHERE experiment <> '' AND alpha IS NOT NULL GROUP BY ALL HAVING count(DISTINCT alpha) > 1)), cell_ AS (SELECT label, chunker, embedder, retriever, unnest(map_keys(means)) AS metric, unnest(map_values(means)) AS value FROM grid_)"
_HEAT = ", ".join(f"'{m}'" for m in X.HEATMAP)


@query(f"WITH {_GRID}, h AS (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM cell_ WHERE metric IN ({_HEAT}) WINDOW w AS (PARTITION BY metric)) SELECT label, metric, value, round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0.5 END, 6) AS shade FROM h")
def heatmap(spark: SparkSession, d: str) -> DataFrame:
    return X.heatmap(X.without_sweeps(_runs(spark, d)))


@query(f"WITH {_GRID} SELECT label, " + ", ".join(f"max(value) FILTER (metric = '{m}') AS {m.replace('@', '_at_')}" for m in X.HEATMAP) + " FROM cell_ GROUP BY label")
def heatmap_wide(spark: SparkSession, d: str) -> DataFrame:
    return X.heatmap_wide(X.without_sweeps(_runs(spark, d)))


@query(f"WITH {_GRID}, a AS (UNPIVOT (SELECT chunker, embedder, retriever, value FROM cell_ WHERE metric = 'ndcg@5') ON chunker, embedder, retriever INTO NAME axis VALUE axis_value), m AS (SELECT axis, axis_value, round(avg(value), 6) AS mean FROM a GROUP BY ALL) SELECT axis, axis_value, mean, round(max(mean) OVER (PARTITION BY axis) - min(mean) OVER (PARTITION BY axis), 6) AS spread FROM m")
def dimension_impact(spark: SparkSession, d: str) -> DataFrame:
    return X.axis_impact(X.without_sweeps(_runs(spark, d)))


@query(f"WITH {_GRID}, a AS (SELECT metric, value FROM cell_ WHERE label = 'fixed_size:128:25% | minilm | dense'), b AS (SELECT metric, value FROM cell_ WHERE label = 'fixed_size:128:25% | mpnet | hybrid:0.5') SELECT metric, a.value AS before, b.value AS after, round(b.value - a.value, 6) AS delta FROM a JOIN b USING (metric)")
def before_after(spark: SparkSession, d: str) -> DataFrame:
    rows = X.without_sweeps(_runs(spark, d))
    return X.before_after(rows.filter("label = 'fixed_size:128:25% | minilm | dense'"), rows.filter("label = 'fixed_size:128:25% | mpnet | hybrid:0.5'"))


@query(f"WITH {_JUDGED} SELECT substr(query_id, len(query_id)) AS label, round(avg(relevance), 6) AS relevance, round(avg(accuracy), 6) AS accuracy, round(avg(completeness), 6) AS completeness, round(avg(citation_quality), 6) AS citation_quality FROM judged_ GROUP BY ALL")
def radar(spark: SparkSession, d: str) -> DataFrame:
    s = A.judge_scores(_judge_raw(spark, d)).withColumn("label", F.right("query_id", F.lit(1)))
    return X.radar(s, A.JUDGED)


@query("SELECT event_type, count(*) AS samples, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95, round(log10(quantile_cont(value, 0.5)), 6) AS log10_p50 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return X.latency_summary(read_table(spark, d, "events"), "event_type", "value")


@query(
    f"WITH {_DERIVED}, c AS (SELECT chunker, embedder, count(DISTINCT alpha) AS n FROM latest_ WHERE alpha IS NOT NULL GROUP BY ALL HAVING n > 1 ORDER BY n DESC, chunker, embedder LIMIT 1), "
    "p AS (SELECT fusion, alpha, metric, value FROM metric_ JOIN c USING (chunker, embedder) WHERE alpha IS NOT NULL AND metric IN ('ndcg@5', 'hit_rate@5', 'mrr')) SELECT *, row_number() OVER (PARTITION BY fusion, metric ORDER BY value DESC, alpha) = 1 AS peak FROM p"
)
def alpha_sweep(spark: SparkSession, d: str) -> DataFrame:
    return X.alpha_sweep(_runs(spark, d))


# --- events and the star schema --------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return ingest.tumbling(read_table(spark, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT w AS window_start, count(*) AS events FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY ALL")
def events_sliding(spark: SparkSession, d: str) -> DataFrame:
    return ingest.sliding(read_table(spark, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS cut FROM events WHERE user_id IS NOT NULL), s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g) "
    "SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events FROM s GROUP BY user_id, n"
)
def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = ingest.sessions(read_table(spark, d, "events"))
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem GROUP BY ALL")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return rows.agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("count_order"))


@query("SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def revenue_rollup(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders").join(read_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(read_table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))

