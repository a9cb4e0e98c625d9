"""Vector tables and exact search: a stated query set against all rows, in blocks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import Registry
from ..shared import file_system, stage

#: Numbers of a block of query vectors sent to the workers at once (64 MB of doubles).
BLOCK_NUMBERS = 8_000_000
#: Rows of a partition that meet the queries at once, and scores that a worker holds at once (4 MB of floats).
PIECE_ROWS, TILE_SCORES = 2048, 1_048_576


_WORD = re.compile("[^ \t\r\n\f\v]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@lru_cache(maxsize=200_000)
def _word_number(word: str) -> int:
    return int.from_bytes(hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()[:4])


def hashing_embedder(width: int = 64) -> Callable[[list[str]], np.ndarray]:
    """The offline embedder: signed counts of hashed words. A model may take its place.

    Words lie between ASCII blanks, ASCII letters in lower case; the first 32 bits of
    a word's MD5 give its place, and the first of them its sign.
    """

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width), dtype=np.float32)
        for i, t in enumerate(texts):
            h = np.fromiter((_word_number(w) for w in _WORD.findall(t.translate(_LOWER))), np.int64)
            np.add.at(out[i], h % width, np.where(h >> 31, 1.0, -1.0))
        return out

    return embed


#: Short names of public models.
MODELS = {"minilm": "sentence-transformers/all-MiniLM-L6-v2", "mpnet": "sentence-transformers/all-mpnet-base-v2"}


def sentence_model(name: str, batch: int = 64) -> Callable[[list[str]], np.ndarray]:
    """An embedder by a sentence-transformers model, loaded once in each worker; vectors as the model gives them."""

    def embed(texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty((0, 0), dtype=np.float32)
        return np.asarray(_loaded_model(MODELS.get(name, name)).encode(texts, batch_size=batch, normalize_embeddings=False, show_progress_bar=False), dtype=np.float32)

    return embed


@lru_cache(maxsize=1)
def _loaded_model(name: str):
    try:
        from sentence_transformers import SentenceTransformer
    except ImportError as e:
        raise RuntimeError(f"the embedder {name!r} needs the package sentence-transformers on every worker; 'hashing' needs none") from e
    return SentenceTransformer(name)


EMBEDDERS: Registry = Registry("embedder", {"hashing": hashing_embedder, **{n: partial(sentence_model, n) for n in MODELS}})


def get_embedder(name: str) -> Callable[[list[str]], np.ndarray]:
    """An embedder by name. A model with other vectors for queries has them as its attribute ``queries``."""
    return EMBEDDERS.named(name)()


def embed_queries(text: Column, embedder: Callable[[list[str]], np.ndarray]) -> Column:
    """Vectors of queries: by the embedder's own function for them where it has one."""
    return embed_column(text, getattr(embedder, "queries", embedder))


def embed_column(text: Column, embedder: Callable[[list[str]], np.ndarray]) -> Column:
    """Vectors of a text column, one for each row, raw as the embedder gives them."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        found = embedder(texts.fillna("").tolist())
        if len(found) != len(texts):
            raise ValueError(f"the embedder gave {len(found)} vectors for {len(texts)} texts")
        return pd.Series(list(np.asarray(found, dtype=np.float32)))

    return vectors(text)


def vector_checks(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: rows, missing vectors, empty ones, and the number of widths."""
    size = F.size(vector)
    return vectors.agg(
        F.count(F.lit(1)).alias("vectors"),
        F.count_if(F.col(vector).isNull()).alias("missing"),
        F.count_if(size == 0).alias("empty"),
        F.count_distinct(F.when(size > 0, size)).alias("widths"),
        F.min(F.when(size > 0, size)).alias("least_width"),
        F.max(size).alias("most_width"),
    )


def index_integrity(vectors: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row: distinct ids on both sides, and those that only one side has."""
    a, b = vectors.select(key).distinct(), chunks.select(key).distinct()
    both = a.withColumn("v", F.lit(1)).join(b.withColumn("c", F.lit(1)), key, "full_outer")
    return both.agg(F.count("v").alias("vectors"), F.count("c").alias("chunks"), F.count_if(F.col("c").isNull()).alias("without_chunk"), F.count_if(F.col("v").isNull()).alias("without_vector"))


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "chunk_id", vector: str = "embedding", query_id: str = "query_id", query_vector: str = "embedding", unique: bool = False) -> DataFrame:
    """``query_id, rank, id_col, score``: for each query the ``k`` rows of highest cosine.

    Scores are rounded to 6 decimals; ties go to the smaller id. Zero vectors score 0;
    null vectors take no part; a wrong width raises. ``k`` below 1 gives no rows. An
    id with several rows is met once; where ids are known to be ``unique``, the
    shuffle that sees to it is saved. Queries go to the workers in blocks of bounded
    size and meet the rows there in tiles of bounded size; every partition of rows
    keeps its own best, so rows are never shuffled.
    """
    spark = vectors.sparkSession
    kinds = queries.schema[query_id].dataType.simpleString(), vectors.schema[id_col].dataType.simpleString()
    schema = f"`{query_id}` {kinds[0]}, `{id_col}` {kinds[1]}, score double"
    rows = vectors.select(id_col, vector).filter(F.col(vector).isNotNull())
    rows = rows if unique else rows.dropDuplicates([id_col])
    found = spark.createDataFrame([], schema)
    # Query vectors may come from a model: they are made once.
    asked = stage(queries.select(query_id, query_vector).filter(F.col(query_vector).isNotNull()).dropDuplicates([query_id]))
    width, total = asked.select(F.max(F.size(query_vector)), F.count(F.lit(1))).first()
    if k < 1 or not width:
        return found.select(query_id, F.lit(1).alias("rank"), id_col, "score")
    per_block = max(1, BLOCK_NUMBERS // width)
    blocks = max(1, -(-total // per_block))
    for b in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b)
        table = part.toArrow()
        if not table.num_rows:
            continue
        matrix = _matrix(table.column(1), width)
        if pa.types.is_float32(table.schema.field(1).type.value_type):
            matrix = matrix.astype(np.float32)
        shared = spark.sparkContext.broadcast((table.column(0).combine_chunks(), matrix))

        def search(batches, shared=shared):
            ids, q = shared.value
            for who, names, scores in _nearest(batches, q, k):
                yield pa.record_batch([ids.take(pa.array(who)), names, pa.array(scores)], names=[query_id, id_col, "score"])

        found = found.unionByName(rows.mapInArrow(search, schema))
    best = Window.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(query_id, "rank", id_col, "score")


def _nearest(batches, queries: np.ndarray, k: int):
    """Of batches of ids and vectors, the ``k`` best rows for each query: numbers of queries, ids, scores.

    Tiles of queries and rows are scored in floats; what comes within their error of a query's
    ``k`` best so far is scored again in doubles. Besides the queries and their best, memory is
    bounded by the tile, whatever the number of queries and the size of a batch.
    """
    width = queries.shape[1]
    # A dot product of unit vectors in floats is off by ``width`` roundings at most; 1e-6 is for the rounding of scores.
    off = (width + 8) * 2.0**-24
    scores, places, kept = np.empty((len(queries), 0)), np.empty((len(queries), 0), dtype=np.int64), None
    piece = max(1, min(PIECE_ROWS, BLOCK_NUMBERS // width))
    step = max(1, TILE_SCORES // max(piece, width))
    for batch in (b.slice(at, piece) for b in batches for at in range(0, b.num_rows, piece)):
        rows = _unit(_matrix(batch.column(1), width))
        rough = rows.astype(np.float32)
        # The ids of the best and of the piece in one order: their places compare as they do.
        names = batch.column(0) if kept is None else pa.concat_arrays([kept, batch.column(0)])
        order = pc.array_sort_indices(names, null_placement="at_start").to_numpy()
        names, place = names.take(pa.array(order)), np.argsort(order)
        places, own = np.where(places < 0, -1, place[places]), place[len(place) - len(rows) :]
        if more := min(k - scores.shape[1], len(rows)):
            scores, places = (np.pad(x, ((0, 0), (0, more)), constant_values=c) for x, c in ((scores, -np.inf), (places, -1)))
        most = scores.shape[1]
        for a in range(0, len(queries), step):
            q = _unit(queries[a : a + step].astype(np.float64))
            s = q.astype(np.float32) @ rough.T
            edge = scores[a : a + step, -1]
            if len(rows) > most and np.isneginf(edge).any():
                edge = np.fmax(edge, np.partition(s, len(rows) - most, axis=1)[:, len(rows) - most] - off)
            hits = np.flatnonzero(~(s < (edge - off - 1e-6).astype(np.float32)[:, None]))
            if len(hits):
                who, row = np.divmod(hits, len(rows))
                x = np.einsum("ij,ij->i", q[who], rows[row]) if len(hits) * width <= TILE_SCORES else (q @ rows.T).ravel()[hits]
                _merge_best(scores[a : a + step], places[a : a + step], who, np.round(x, 6), own[row])
        used = np.unique(places[places >= 0])
        kept, places = names.take(pa.array(used)), np.where(places < 0, -1, np.searchsorted(used, places))
    for a in range(0, len(queries) if kept is not None else 0, step):
        who, rank = np.nonzero(places[a : a + step] >= 0)
        yield who + a, kept.take(pa.array(places[a + who, rank])), scores[a + who, rank]


def _merge_best(scores: np.ndarray, places: np.ndarray, who: np.ndarray, new_scores: np.ndarray, new_places: np.ndarray) -> None:
    """Put what is among the best of its query, by score and then place, into ``scores`` and ``places``."""
    k = scores.shape[1]
    better = ~(new_scores < scores[who, -1])
    who, new_scores, new_places = who[better], new_scores[better], new_places[better]
    live = np.unique(who)
    w = np.concatenate([np.repeat(live, k), who])
    s, p = np.concatenate([scores[live].ravel(), new_scores]), np.concatenate([places[live].ravel(), new_places])
    # NaN, the score of an infinite vector, is above all numbers, as in Spark and SQL.
    order = np.lexsort((p, np.where(np.isnan(s), -np.inf, -s), w))
    # Each of ``live`` has the k entries that it had, at least.
    best = order[np.searchsorted(w[order], live)[:, None] + np.arange(k)]
    scores[live], places[live] = s[best], p[best]


def _matrix(column, width: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(whole) and not pc.all(pc.equal(pc.list_value_length(whole), width)).as_py():
        raise ValueError(f"vectors must have width {width}")
    values = whole.flatten()
    return np.asarray(values.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(whole), width)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def add_vectors(path: str, chunks: DataFrame) -> int:
    """Append ``chunks(chunk_id, chunk_index, content, embedding)`` to a vector table; returns how many.

    A missing vector, or a width other than that of the table, is an error; no rows change nothing.
    """
    spark = chunks.sparkSession
    row = vector_checks(chunks).first()
    if not row.vectors:
        return 0
    files, target = file_system(spark, path)
    widths = {row.least_width, row.most_width} | ({vector_checks(spark.read.parquet(path)).first().most_width} if files.exists(target) else set())
    if row.missing or row.empty or len(widths) > 1:
        raise ValueError(f"{row.missing + row.empty} of {row.vectors} vectors are missing; widths {sorted(map(str, widths))}")
    chunks.write.mode("append").parquet(path)
    return row.vectors


STORES: Registry = Registry("vector store", {"exact": dense_topk, "faiss": dense_topk})


def get_store(name: str) -> Callable[..., DataFrame]:
    """The search function of a vector store by name. All are exact; ``faiss`` is kept as a name for written configurations."""
    return STORES.named(name)
