"""The most similar vectors of every vector, by multi-index hashing.

Vectors get binary codes from learned rotations (iterative quantization of the
principal axes). A code is split into substrings, each with its index. Two codes
within the Hamming radius ``substrings * (probe + 1) - 1`` agree in some substring up
to ``probe`` bits, so visiting the cells within ``probe`` bits of one's own in every
index retrieves them all. Codes that meet in a cell are compared: only those within a
wider radius, beyond which a pair hardly reaches the least similarity, are ranked, by
the exact cosines of their vectors, and every pair once, in the first of the indexes in
which it meets. A row sends on at most its ``k`` best of a cell. Rows of equal direction
are one class throughout; full cells are cut into blocks and met block by block.
"""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._cluster import arrow_map, hot_keys, key_runs, parts_for, small, stage


def fit_codes(sample: np.ndarray, bits: int, rounds: int = 40, seed: int = 7) -> np.ndarray:
    """A ``(width, bits)`` matrix; the signs of ``x @ matrix`` are the code of ``x``.

    Each rotation covers as many bits as the vectors have axes; further bits come
    from further rotations, of other starting points.
    """
    width = sample.shape[1]
    _, axes = np.linalg.eigh(sample.T @ sample)
    axes = axes[:, ::-1]
    parts = []
    for k, start in enumerate(range(0, bits, width)):
        n = min(width, bits - start)
        base = axes[:, :n] if n == width or k == 0 else axes @ np.linalg.qr(np.random.default_rng(seed + 100 + k).standard_normal((width, n)))[0]
        y = sample @ base
        turn = np.linalg.qr(np.random.default_rng(seed + k).standard_normal((n, n)))[0]
        for _ in range(rounds):
            a, _, b = np.linalg.svd(np.where(y @ turn > 0, 1.0, -1.0).T @ y)
            turn = (a @ b).T
        parts.append(base @ turn)
    return np.concatenate(parts, axis=1)


#: Bits of a code that are compared in a cell.
CODE_BITS = 128


def index_plan(rows: int, target: int = 4096) -> tuple[int, int, int]:
    """Bits of a substring, bits to probe, and number of substrings, for ``rows`` codes.

    Cells shall hold about ``target`` rows. Short substrings are met exactly in a few
    indexes; longer ones, which more rows need, in more indexes, or within a bit or two
    in fewer, so that a pair at cosine 0.80 shares a cell about as often in all plans.
    """
    bits = int(np.clip(np.ceil(np.log2(max(rows, 1) / target)), 5, 24))
    return (bits, 0, {5: 9, 6: 12, 7: 14, 8: 17, 9: 21, 10: 27}[bits]) if bits <= 10 else (bits, 1, 8) if bits <= 14 else (bits, 2, 6)


def code_radius(least: float, bits: int = CODE_BITS, spread: float = 2.0) -> int:
    """The Hamming radius that a pair at cosine ``least`` exceeds only by ``spread`` standard deviations, were bits independent."""
    differ = math.acos(max(-1.0, min(1.0, least))) / math.pi
    return math.ceil(bits * differ + spread * math.sqrt(bits * differ * (1.0 - differ)))


def substrings(codes: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """``(rows, tables)``: the numbers that the substrings of packed codes stand for."""
    flat = np.unpackbits(codes, axis=1, count=tables * bits)
    return flat.reshape(len(codes), tables, bits).astype(np.int32) @ (1 << np.arange(bits, dtype=np.int32))


def first_meeting(own: np.ndarray, others: np.ndarray, table: int, cell: int, probe: int) -> np.ndarray:
    """Whether pairs of codes, as substrings, meet in ``cell`` of ``table`` first.

    Both visit the cells with up to ``probe`` of their zero bits set, so they meet in a
    table where each lacks no more bits of the other, first where both are joined.
    """
    lacks = np.bitwise_count(others & ~own)
    meets = (lacks <= probe) & (np.bitwise_count(own & ~others) <= probe)
    return (np.argmax(meets, axis=1) == table) & (own[:, table] | others[:, table] == cell)


def _read_vectors(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(column.length() if hasattr(column, "length") else len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def best_in_cell(vectors: np.ndarray, codes: np.ndarray, subs: np.ndarray, own: np.ndarray, others: np.ndarray, k: int, least: float, radius: int, table: int, cell: int, probe: int, block: int = 512):
    """Of each row of ``own`` its ``k`` best in ``others``: row, other row, rounded cosine.

    Rows must be in order of their ids; ties go to the earlier one. Pairs beyond
    ``radius`` and those that meet in another index before aren't ranked.
    """
    words = np.ascontiguousarray(codes).view(np.uint64)
    found = []
    for at in range(0, len(own), block):
        part = own[at : at + block]
        apart = np.zeros((len(part), len(others)), dtype=np.uint16)
        for w in range(CODE_BITS // 64):
            apart += np.bitwise_count(words[part, w][:, None] ^ words[others, w][None, :])
        r, c = np.nonzero(apart <= radius)
        i, j = part[r], others[c]
        good = i != j
        i, j = i[good], j[good]
        exact = []
        for x in range(0, len(i), 65536):
            a, b = i[x : x + 65536], j[x : x + 65536]
            new = first_meeting(subs[a], subs[b], table, cell, probe)
            cosine = np.full(len(a), -2.0)
            cosine[new] = np.round(np.einsum("ij,ij->i", vectors[a[new]], vectors[b[new]]), 6)
            exact.append(cosine)
        if not exact:
            continue
        cosine = np.concatenate(exact)
        keep = cosine >= least
        i, j, cosine = i[keep], j[keep], cosine[keep]
        order = np.lexsort((j, -cosine, i))
        i, j, cosine = i[order], j[order], cosine[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
        found.append((i[keep], j[keep], cosine[keep]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _direction_classes(df: DataFrame, id_col: str, vector_col: str, width: int) -> tuple[DataFrame, DataFrame]:
    """``(members: key, id)`` and ``(classes: key, rep, size, vector)`` of the live vectors."""
    vectors = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull() & (F.size("v") == width) & F.forall("v", lambda x: x.isNotNull()))
    once = vectors.groupBy("id").agg(F.min("v").alias("v"))
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            live = np.flatnonzero(np.isfinite(flat).all(axis=1) & (flat != 0).any(axis=1))
            if not len(live):
                return None
            v = flat[live]
            v = v / np.abs(v).max(axis=1, keepdims=True)
            unit = v / np.linalg.norm(v, axis=1, keepdims=True)
            keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in np.rint(unit * 1e5).astype(np.int32)]
            raw = [x.tobytes() for x in flat[live].astype(np.float32)]
            return pa.record_batch([batch.column(0).take(pa.array(live)), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], names=["id", "key", "vector"])

        return one

    keyed = stage(arrow_map(once, make, f"id {kind}, key binary, vector binary"))
    classes = keyed.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"), F.min_by("vector", "id").alias("vector"))
    return keyed.select("key", "id"), stage(classes)


def similar_pairs(
    df: DataFrame,
    id_col: str = "chunk_id",
    vector_col: str = "embedding",
    k: int = 5,
    least: float = 0.80,
    width: int = 96,
    plan: tuple[int, int, int] | None = None,
    sample_rows: int = 20_000,
    cell_rows: int = 8192,
    hot_rows: int = 100_000,
) -> DataFrame:
    """For every live vector its ``k`` most similar others: ``id, other, similarity``.

    Live are vectors of ``width`` numbers, all finite, not all zero; others take no
    part. An id counts once (with its least vector, should it have several). The
    similarity is the cosine rounded to 6 decimals, ties go to the smaller id, and
    neighbours below ``least`` don't count, so a row may have fewer than ``k`` or none.

    ``plan`` sets the index (see ``index_plan``). The rotations are fitted on ``sample_rows`` vectors at most, picked by hash; every
    vector is indexed. Neighbours within the radius of the codes are found for
    certain; others if they share a cell. See the README for the measured recall.
    """
    spark = df.sparkSession
    members, classes = _direction_classes(df, id_col, vector_col, width)
    kind = df.schema[id_col].dataType.simpleString()
    total = classes.count()
    empty = spark.createDataFrame([], f"id {kind}, other {kind}, similarity double")
    if not total:
        return empty
    by_hash = F.xxhash64("key")
    picked = classes.filter(F.pmod(by_hash, F.lit(total)) < 2 * sample_rows).select("vector", by_hash.alias("h")).orderBy("h").limit(sample_rows).toArrow()
    sample = _unit(_read_vectors(picked.column(0)))
    bits, probe, tables = plan or index_plan(total)
    rotation = spark.sparkContext.broadcast(fit_codes(sample, max(CODE_BITS, tables * bits)))
    flips = [sum(1 << b for b in c) for n in range(probe + 1) for c in combinations(range(bits), n)]
    radius = code_radius(least)

    def make_codes():
        matrix = rotation.value

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            codes = np.packbits(_unit(_read_vectors(batch.column("vector"))) @ matrix > 0, axis=1)
            cells = substrings(codes, bits, tables) + (np.arange(tables, dtype=np.int32) << bits)
            return pa.record_batch([batch.column("rep"), batch.column("vector"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(list(cells), pa.list_(pa.int32()))], names=["rep", "vector", "code", "cells"])

        return one

    coded = arrow_map(classes.select("rep", "vector"), make_codes, f"rep {kind}, vector binary, code binary, cells array<int>")
    # A row lies in its own cell and visits those with some of its zero bits set: of
    # two cells that differ, both meet in each cell between them.
    at = F.explode(F.col("cells"))
    if probe:
        visited = F.flatten(F.transform("cells", lambda c: F.transform(F.filter(F.lit(flips), lambda f: c.bitwiseAND(f) == 0), lambda f: c.bitwiseOR(f))))
        at = F.explode(visited)
    rows = coded.select("rep", "vector", "code", at.alias("cell"))
    # Cells of several blocks: at most one for each cell_rows rows, so a small table.
    sizes = coded.select(at.alias("cell")).groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("blocks")).filter("blocks > 1")
    placed = rows.join(small(stage(sizes)), "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = placed.select("cell", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), "block", "rep", "vector", "code")

    def meet(batches):
        for met in key_runs(batches, ["cell", "x", "y"]):
            unit = _unit(_read_vectors(met.column("vector").combine_chunks()))
            codes = np.frombuffer(b"".join(met.column("code").to_pylist()), dtype=np.uint8).reshape(len(unit), -1)
            subs, codes = substrings(codes, bits, tables), codes[:, : CODE_BITS // 8]
            reps = met.column("rep").combine_chunks()
            cell, x, y = (met.column(c)[0].as_py() for c in ("cell", "x", "y"))
            block = met.column("block").to_numpy()
            one, two = np.flatnonzero(block == x), np.flatnonzero(block == y)
            for own, others in [(one, one)] if x == y else [(one, two), (two, one)]:
                r, c, sim = best_in_cell(unit, codes, subs, own, others, k, least, radius, cell >> bits, cell & ((1 << bits) - 1), probe)
                if len(r):
                    yield pa.record_batch([reps.take(pa.array(r)), reps.take(pa.array(c)), pa.array(sim)], names=["rep", "near", "similarity"])

    visits = total * tables * (1 + probe * bits // 2)
    ordered = units.repartition(parts_for(spark, visits, 50_000), "cell", "x", "y").sortWithinPartitions("cell", "x", "y", "rep")
    near = ordered.mapInArrow(meet, f"rep {kind}, near {kind}, similarity double")  # a pair is ranked once each way
    best = Window.partitionBy("rep").orderBy(F.desc("similarity"), "near")
    near = stage(near.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).drop("r"))

    # From classes to members: a class shows at most its k + 1 least ids.
    reps = classes.select("key", "rep", "size")
    least_ids = Window.partitionBy("key").orderBy("id")
    several = members.join(reps.filter("size > 1").select("key", "rep"), "key")
    shown = several.withColumn("r", F.row_number().over(least_ids)).filter(F.col("r") <= k + 1).select("rep", "id")
    shown = stage(shown.unionByName(reps.filter("size = 1").select("rep", F.col("rep").alias("id"))))
    around = near.join(shown.select(F.col("rep").alias("near"), "id"), "near").select("rep", "similarity", "id")
    siblings = shown.join(reps.filter("size > 1").select("rep"), "rep", "left_semi").select("rep", F.lit(1.0).alias("similarity"), "id")
    top = Window.partitionBy("rep").orderBy(F.desc("similarity"), "id")
    lists = around.unionByName(siblings).withColumn("r", F.row_number().over(top)).filter(F.col("r") <= k + 1)
    lists = lists.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("r", "id", "similarity"))).alias("near"))  # k + 1 entries
    hot = small(hot_keys(members, ["key"], hot_rows, "n"))
    salts = F.ceil(F.coalesce("n", F.lit(1)) / hot_rows).cast("int")
    lists = lists.join(reps.select("key", "rep"), "rep").join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select("key", "salt", "near")
    salted = members.join(hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int")).select("key", "salt", "id")
    own = salted.join(lists, ["key", "salt"]).select("id", F.slice(F.filter("near", lambda e: e["id"] != F.col("id")), 1, k).alias("near"))
    return _spread(own)


def _spread(own: DataFrame) -> DataFrame:
    flat = own.select(F.col("id").alias("self"), F.explode("near").alias("e"))
    return flat.select(F.col("self").alias("id"), F.col("e.id").alias("other"), F.col("e.similarity").alias("similarity"))


def neighbour_pairs(df: DataFrame, id_col: str = "chunk_id", **options) -> DataFrame:
    """``(id_col_a, id_col_b)``, smaller first: pairs of which one is a neighbour of the other."""
    found = similar_pairs(df, id_col, **options)
    return found.select(F.least("id", "other").alias(f"{id_col}_a"), F.greatest("id", "other").alias(f"{id_col}_b")).distinct()
