"""One ranking from scores of several kinds, by a random walk over the ranks.

From an item the walk picks one of the kinds of score, each as likely as another,
and jumps to an item that this kind ranks strictly higher, all alike likely. Where
none is higher, and with probability ``1 - damping`` at any step, it starts anew
at any item. Items are ordered by how often the walk is there. Only ranks enter, so
no unit, offset or spread of a score matters. An item that a kind doesn't rank
stands below all that it does.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._cluster import key_runs, parts_for, release, small, stage
from .topn import valid_scores

#: A low damping keeps the walk near its first jumps: what counts is an item's place
#: in every kind of score, not the few items at the very top where long walks end.
DAMPING = 0.2
#: Rows of a group beyond which its walk is distributed: some 30 MB in a task, with its arrays 150.
HOT_ROWS = 300_000


def steps_needed(damping: float, tolerance: float = 1e-7) -> int:
    """Steps after which no probability changes by more than ``tolerance``, relatively."""
    return max(1, math.ceil(math.log(tolerance) / math.log(damping)))


def walk(kind: np.ndarray, item: np.ndarray, higher: np.ndarray, ranked: np.ndarray, sizes: np.ndarray, group: np.ndarray, kinds: np.ndarray, damping: float = DAMPING) -> np.ndarray:
    """Stationary probabilities, times the items of the group, of the walks in several groups at once.

    An entry says that ``item`` has ``higher`` items above it in ``kind``, and whether
    it is ``ranked`` there; every item has an entry for each kind of its group. ``sizes``
    are the ranked items of each kind; ``group`` and ``kinds``, by item, its group and how
    many kinds that has. All transitions of a step come from one running sum over ranks.
    """
    items = len(group)
    ends = np.cumsum(sizes + 1)
    slot = (ends - sizes - 1)[kind] + higher
    last = (ends - 1)[kind]
    top = higher == 0
    rate = np.where(top, 0.0, 1.0 / np.maximum(higher, 1))
    members = np.bincount(group)
    pi = np.ones(items)
    for _ in range(steps_needed(damping)):
        here = pi[item]
        upto = np.cumsum(np.bincount(slot, weights=here * rate, minlength=int(ends[-1])))
        # An item with h items above it is reached from all with more than h.
        new = np.bincount(item, weights=np.where(ranked, upto[last] - upto[slot], 0.0), minlength=items)
        restart = np.bincount(group[item], weights=np.where(top, here, 0.0), minlength=len(members))
        pi = (1.0 - damping) + damping * (new + (restart / members)[group]) / kinds
    return pi


def _codes(column) -> np.ndarray:
    return column.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _walk_table(table: pa.Table, group: str, kind: str, item: str, score: str, damping: float) -> pa.RecordBatch:
    """The walks in all groups of ``table``."""
    g, k, i = (_codes(table.column(c)) for c in (group, kind, item))
    s = table.column(score).to_numpy()
    _, first, i = np.unique(g * (i.max() + 1) + i, return_index=True, return_inverse=True)
    _, first_kind, k = np.unique(g * (k.max() + 1) + k, return_index=True, return_inverse=True)
    of_item, of_kind = g[first], g[first_kind]
    # Items strictly higher: where the block of equal scores begins within the kind.
    order = np.lexsort((-s, k))
    ks, ss = k[order], s[order]
    sizes = np.bincount(ks)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    fresh = np.concatenate([[True], (ks[1:] != ks[:-1]) | (ss[1:] != ss[:-1])])
    block = np.maximum.accumulate(np.where(fresh, np.arange(len(ks)), 0))
    higher = np.empty(len(ks), dtype=np.int64)
    higher[order] = block - begin[ks]
    # One entry for every item and kind of its group; below all where it isn't ranked.
    kinds_of, kinds_at = np.bincount(of_kind), np.concatenate([[0], np.cumsum(np.bincount(of_kind))[:-1]])
    kinds_in_order = np.argsort(of_kind, kind="stable")
    rank_of_kind = np.empty(len(of_kind), dtype=np.int64)
    rank_of_kind[kinds_in_order] = np.arange(len(of_kind)) - kinds_at[of_kind[kinds_in_order]]
    each = kinds_of[of_item]
    begin_item = np.concatenate([[0], np.cumsum(each)[:-1]])
    entry_item = np.repeat(np.arange(len(of_item)), each)
    within = np.arange(len(entry_item)) - begin_item[entry_item]
    entry_kind = kinds_in_order[kinds_at[of_item[entry_item]] + within]
    entry_higher, ranked = sizes[entry_kind].copy(), np.zeros(len(entry_item), dtype=bool)
    at = begin_item[i] + rank_of_kind[k]
    entry_higher[at], ranked[at] = higher, True
    pi = walk(entry_kind, entry_item, entry_higher, ranked, sizes, of_item, each, damping)
    rows = pa.array(first)
    return pa.record_batch([table.column(group).combine_chunks().take(rows), table.column(item).combine_chunks().take(rows), pa.array(pi)], names=[group, item, "weight"])


def _small(rows: DataFrame, total: int, group: str, kind: str, item: str, score: str, damping: float) -> DataFrame:
    """Probabilities within groups that one task may hold; groups are walked many at a time."""
    schema = f"`{group}` {rows.schema[group].dataType.simpleString()}, `{item}` {rows.schema[item].dataType.simpleString()}, weight double"

    def run(batches):
        for table in key_runs(batches, [group], 50_000):
            yield _walk_table(table, group, kind, item, score, damping)

    return rows.repartition(parts_for(rows.sparkSession, total, 100_000), group).sortWithinPartitions(group).mapInArrow(run, schema)


def _large(rows: DataFrame, group: str, kind: str, item: str, score: str, damping: float, width: int) -> DataFrame:
    """The same for groups of any size: every running sum is made in buckets of ranks.

    A step moves each row twice: to the bucket of its rank, where what lies behind is
    summed, and back to its item. What the buckets sum up to is a small table.
    """
    blocks = rows.groupBy(group, kind, F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("c"))
    # Items of one score form a block; h counts the items strictly higher.
    placed = stage(blocks.repartitionByRange(group, kind, F.desc("s")).withColumn("part", F.spark_partition_id()))
    sums = placed.groupBy(group, kind, "part").agg(F.sum("c").alias("all"))
    offset = F.coalesce(F.sum("all").over(Window.partitionBy(group, kind).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.coalesce(F.sum("c").over(Window.partitionBy(group, kind, "part").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.withColumn("inner", inner).join(sums.withColumn("offset", offset).drop("all"), [group, kind, "part"])
    starts = starts.select(group, kind, "s", (F.col("inner") + F.col("offset")).alias("h"))
    ranked = rows.join(starts, (rows[group] == starts[group]) & (rows[kind] == starts[kind]) & (rows[score] == starts["s"]))
    ranked = ranked.select(rows[group].alias("g"), rows[item].alias("i"), F.struct(rows[kind].alias("k"), "h").alias("p"))
    sizes = rows.groupBy(F.col(group).alias("g"), F.col(kind).alias("k")).agg(F.count(F.lit(1)).alias("m"))
    kinds = sizes.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("k", "m"))).alias("sizes"))  # one entry a kind
    have = ranked.groupBy("g", "i").agg(F.map_from_entries(F.collect_list("p")).alias("have"))
    total = have.groupBy("g").agg(F.count(F.lit(1)).cast("double").alias("n"))
    info = small(stage(kinds.join(total, "g")))  # one row a large group
    places = F.transform(F.map_entries("sizes"), lambda e: F.struct(e.key.alias("k"), F.coalesce(F.try_element_at("have", e.key), e.value).alias("h"), F.map_contains_key("have", e.key).alias("in")))
    state = stage(have.join(info, "g").select("g", "i", "n", F.lit(1.0).alias("pi"), places.alias("places")))
    behind = Window.partitionBy("g", "k", "b").orderBy(F.desc("h")).rangeBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("g", "k").orderBy(F.col("b").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(steps_needed(damping)):
        # Items that a kind doesn't rank stand in one block at its end, which may be most
        # rows: nothing flows there, and what flows from it enters as a sum, under no bucket.
        flat = state.select("g", "i", "n", "pi", F.inline("places")).withColumn("b", F.when(F.col("in"), F.floor(F.col("h") / width)))
        flat = flat.withColumn("f", F.when(F.col("h") > 0, F.col("pi") / F.col("h")).otherwise(0.0))
        sums = flat.groupBy("g", "k", "b").agg(F.sum("f").alias("all"), F.sum(F.when(F.col("h") == 0, F.col("pi")).otherwise(0.0)).alias("top"))
        sums = sums.select("g", "k", "b", F.coalesce(F.sum("all").over(later), F.lit(0.0)).alias("beyond"), F.sum("top").over(Window.partitionBy("g")).alias("restart"))
        buckets = stage(sums.filter("b is not null"))
        moved = flat.filter("in").withColumn("near", F.coalesce(F.sum("f").over(behind), F.lit(0.0))).join(small(buckets), ["g", "k", "b"])
        moved = moved.select("g", "i", "n", "k", "h", "in", (F.col("near") + F.col("beyond")).alias("r"), "restart")
        moved = moved.unionByName(flat.filter("not in").select("g", "i", "n", "k", "h", "in", F.lit(0.0).alias("r"), F.lit(None).cast("double").alias("restart")))
        moved = moved.groupBy("g", "i").agg(F.first("n").alias("n"), F.sum("r").alias("new"), F.max("restart").alias("restart"), F.array_sort(F.collect_list(F.struct("k", "h", "in"))).alias("places"))
        pi = F.lit(1.0 - damping) + F.lit(damping) * (F.col("new") + F.col("restart") / F.col("n")) / F.size("places")
        done, state = state, stage(moved.select("g", "i", "n", pi.alias("pi"), "places"))
        release(done)
        release(buckets)
    return state.select(F.col("g").alias(group), F.col("i").alias(item), F.col("pi").alias("weight"))


def rank_walk(
    df: DataFrame,
    group_col: str = "query_id",
    kind_col: str = "retriever_type",
    item_col: str = "chunk_id",
    score_col: str = "score",
    damping: float = DAMPING,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``group_col, item_col, weight``: for each group one weight per item, high first.

    ``df`` has one row per group, kind and item; of repeated ones the highest score
    counts. Rows with a null in any of the four columns or a NaN score take no part.
    Groups of more than ``hot_rows`` rows are walked by distributed running sums,
    others within one task; the results are the same.
    """
    rows = df.select(group_col, kind_col, item_col, F.col(score_col).cast("double").alias(score_col)).na.drop().filter(~F.isnan(score_col))
    rows = stage(rows.groupBy(group_col, kind_col, item_col).agg(F.max(score_col).alias(score_col)))
    counts = stage(rows.groupBy(group_col).agg(F.count(F.lit(1)).alias("n")))
    return _walk_all(rows, counts, (group_col, kind_col, item_col, score_col), damping, hot_rows)


def _walk_all(rows: DataFrame, counts: DataFrame, names: tuple[str, str, str, str], damping: float, hot_rows: int) -> DataFrame:
    """The walks in the groups of ``counts``, which has their rows as ``n``."""
    group = names[0]
    light = counts.filter(F.col("n") <= hot_rows)
    hot = counts.filter(F.col("n") > hot_rows).select(group)
    total, groups = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > hot_rows)).first()
    done = _small(rows.join(light.select(group), group, "left_semi"), total, *names, damping)
    if not groups:
        return done
    return done.unionByName(_large(rows.join(small(hot), group, "left_semi"), *names, damping, hot_rows))


def fused_top(rankings: DataFrame, n: int = 3, kinds: tuple[str, ...] = ("dense", "bm25", "hybrid"), damping: float = DAMPING, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``query_id, chunk_id, weight, rank``: the ``n`` chunks that come first when all kinds count equally.

    Only queries with finite scores of every kind take part. Ties by chunk id.
    """
    valid = valid_scores(rankings).filter(F.col("query_id").isNotNull() & F.col("chunk_id").isNotNull() & F.col("retriever_type").isin(*kinds))
    rows = stage(valid.groupBy("query_id", "retriever_type", "chunk_id").agg(F.max("score").alias("score")))
    counts = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), *[F.max(F.col("retriever_type") == k).alias(f"has{i}") for i, k in enumerate(kinds)])
    complete = stage(counts.filter(" and ".join(f"has{i}" for i in range(len(kinds)))).select("query_id", "n"))
    weights = _walk_all(rows, complete, ("query_id", "retriever_type", "chunk_id", "score"), damping, hot_rows)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("weight", 9)), "chunk_id")
    return weights.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
