"""Filling containers of fixed capacity, under limits in several dimensions at once.

An example uses tokens, one segment, and loss-bearing tokens; a container limits the
sum of each. The dot-product heuristic fills one container at a time: of all
examples that fit, it takes the one whose demand, weighed by what the container has
left, is largest. Examples are dealt into shards that one task can hold; what the
containers of a shard leave emptiest is dealt again into fewer shards.
"""

from __future__ import annotations

import base64
import importlib.util
import math
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cluster import arrow_map, key_runs, parts_for, small, stage

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def read_tokenizer(path: str) -> tuple[str, dict[bytes, int]]:
    """Pattern and ranks of a rank file; its pattern stands in the package beside the file."""
    spec = importlib.util.spec_from_file_location("tokenizer_files", Path(path).parent / "__init__.py")
    files = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(files)
    with open(path, "rb") as f:
        return files.PATTERN, {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


_ENCODINGS: dict[str, object] = {}


def _encoding(name: str, held):
    """The tokenizer of a broadcast pattern and ranks, built once in each worker."""
    if name not in _ENCODINGS:
        import tiktoken

        pattern, ranks = held.value
        _ENCODINGS.clear()
        _ENCODINGS[name] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[name]


def token_counts(df: DataFrame, id_col: str, text_col: str, path: str = TOKENIZER, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, tokens`` and the columns ``keep``: the tokens of each text; 0 for null and empty texts.

    The driver reads the tokenizer at ``path`` and sends it to the workers.
    """
    held, name = df.sparkSession.sparkContext.broadcast(read_tokenizer(path)), uuid.uuid4().hex
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (id_col, *keep))

    def make():
        encode = _encoding(name, held).encode_ordinary

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(text_col).to_pylist()]
            return pa.record_batch([*(batch.column(c) for c in (id_col, *keep)), pa.array(sizes, pa.int64())], names=[id_col, *keep, "tokens"])

        return one

    return arrow_map(df.select(id_col, *keep, text_col), make, f"{kinds}, tokens bigint")


def fill(demand: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The container, from 0, of each row of ``demand`` under ``limits`` (a float per dimension).

    Every single row must fit. Rows of equal demand form a type, so a step costs as
    many operations as there are types left, not rows.
    """
    types, kind, count = np.unique(demand, axis=0, return_inverse=True, return_counts=True)
    kind = kind.reshape(-1)
    slots = np.argsort(kind, kind="stable")
    taken = np.concatenate([[0], np.cumsum(count)[:-1]])
    share = types / limits
    # A dimension matters as much as all rows together press on it.
    weight = (share * count[:, None]).sum(axis=0)
    weight = weight / max(weight.sum(), 1e-12)
    left = count.copy()
    out = np.empty(len(demand), dtype=np.int64)
    alive = np.arange(len(types))
    bin_at, remaining = 0, int(count.sum())
    while remaining:
        room = np.ones(len(limits))
        first = True
        while True:
            own = share[alive]
            score = own @ (weight * room)
            score[(own > room + 1e-12).any(axis=1) | (left[alive] == 0)] = -1.0
            best = int(np.argmax(score)) if len(score) else -1
            if best < 0 or score[best] < 0:
                break
            t = alive[best]
            out[slots[taken[t]]] = bin_at
            taken[t] += 1
            left[t] -= 1
            remaining -= 1
            room = room - share[t]
            first = False
        if first:
            raise ValueError("a row exceeds the limits")
        bin_at += 1
        if (left[alive] == 0).mean() > 0.25:
            alive = alive[left[alive] > 0]
    return out


def pack(
    examples: DataFrame,
    containers: DataFrame,
    shard_rows: int = 8192,
    rounds: int = 2,
    full: float = 0.97,
    loss_cuts: bool = True,
    apart: tuple[str, ...] = (),
) -> DataFrame:
    """Assign every example to a container of every kind.

    ``examples``: ``doc_id, tokens, loss_tokens``. Rows equal in id, counts and the columns
    ``apart`` count once; rows with a null id all count. ``containers``:
    ``window_id, capacity_tokens, max_segments, max_loss_tokens``. Returns
    ``window_id, container_id, doc_id, token_start, token_end, loss_tokens``.

    An example stays whole unless it exceeds the capacity (or, with ``loss_cuts``,
    the limit of loss-bearing tokens) itself; then it is cut into pieces as large as
    allowed and a remainder. Without ``loss_cuts`` a piece that bears more loss than
    the limit takes all of it: it shares its container only with pieces that bear
    none. Examples without tokens need no room: they come out with a null
    container. A null or negative count means none. Containers less than ``full``
    after a round are emptied and their examples dealt anew, but for the last round.
    """
    windows = containers.select("window_id", "capacity_tokens", "max_segments", "max_loss_tokens").filter("capacity_tokens > 0 and max_segments > 0 and max_loss_tokens > 0").distinct()
    windows = small(stage(windows))
    size = F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("bigint")
    items = examples.select("doc_id", *apart, size.alias("tokens"), F.least(F.greatest(F.coalesce("loss_tokens", F.lit(0)), F.lit(0)).cast("bigint"), size).alias("loss"))
    # The salt deals rows of one id to different shards.
    named = items.filter("doc_id is not null").distinct().withColumn("salt", F.xxhash64("tokens", "loss", *apart))
    items = named.unionByName(items.filter("doc_id is null").withColumn("salt", F.monotonically_increasing_id())).drop(*apart)
    # One row per example and kind of container, as the result has; kinds are broadcast if few.
    every = items.crossJoin(windows)
    # The tokens of a piece: the capacity, or as many as bear the loss allowed.
    dense = F.lit(loss_cuts) & (F.col("loss") * F.col("capacity_tokens") > F.col("max_loss_tokens") * F.col("tokens"))
    step = F.when(dense, F.floor(F.col("max_loss_tokens") * F.col("tokens") / F.col("loss"))).otherwise(F.col("capacity_tokens")).cast("bigint")
    cut = every.withColumn("step", step).withColumn("token_start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("tokens") - 1, F.lit(0)), F.col("step"))))
    cut = cut.withColumn("token_end", F.least(F.col("token_start") + F.col("step"), F.col("tokens")))
    borne = lambda at: F.floor(F.col("loss") * F.col(at) / F.greatest(F.col("tokens"), F.lit(1))).cast("bigint")
    parts = cut.select("window_id", "capacity_tokens", "max_segments", "max_loss_tokens", "doc_id", "salt", "token_start", "token_end", (borne("token_end") - borne("token_start")).alias("loss"))
    parts = stage(parts)
    none = parts.filter("token_end = token_start").select("window_id", F.lit(None).cast("string").alias("container_id"), "doc_id", "token_start", "token_end", F.col("loss").alias("loss_tokens"))
    schema = parts.select("window_id", F.lit("").alias("container_id"), "doc_id", "token_start", "token_end", F.col("loss").alias("loss_tokens"), F.lit(0.0).alias("used"), "capacity_tokens", "max_segments", "max_loss_tokens", "salt").schema

    def run(batches, label=""):
        for table in key_runs(batches, ["window_id", "shard"]):
            col = {c: table.column(c).to_numpy() for c in ("token_start", "token_end", "loss")}
            cap, seg, most = (table.column(c)[0].as_py() for c in ("capacity_tokens", "max_segments", "max_loss_tokens"))
            tokens = col["token_end"] - col["token_start"]
            demand = np.stack([tokens, np.ones(len(tokens), tokens.dtype), np.minimum(col["loss"], most)], axis=1).astype(np.float64)
            at = fill(demand, np.array([cap, seg, most], dtype=np.float64))
            used = (np.bincount(at, weights=tokens) / cap)[at]
            name = f"{label}-{table.column('shard')[0].as_py()}-"
            yield from pa.table(
                [table.column("window_id"), pa.array([f"{name}{i}" for i in at]), table.column("doc_id"), table.column("token_start"), table.column("token_end"), table.column("loss"), pa.array(used), *(table.column(c) for c in ("capacity_tokens", "max_segments", "max_loss_tokens", "salt"))],
                names=schema.names,
            ).to_batches()

    done, rest = [none], parts.filter("token_end > token_start")
    for r in range(rounds):
        counts = small(stage(rest.groupBy("window_id").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))))
        sharded = rest.join(counts, "window_id").withColumn("shard", F.pmod(F.xxhash64("doc_id", "salt", "token_start", F.lit(r)), "shards").cast("int"))
        ordered = sharded.repartition(parts_for(rest.sparkSession, rest.count(), 2 * shard_rows), "window_id", "shard").sortWithinPartitions("window_id", "shard", "doc_id", "token_start", "salt")
        packed = stage(ordered.mapInArrow(lambda b, label=f"r{r}": run(b, label), schema))
        final = packed if r == rounds - 1 else packed.filter(F.col("used") >= full)
        done.append(final.select("window_id", "container_id", "doc_id", "token_start", "token_end", "loss_tokens"))
        rest = packed.filter(F.col("used") < full).withColumnRenamed("loss_tokens", "loss").drop("container_id", "used")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(
    documents: DataFrame,
    windows: DataFrame,
    tokenizer: str = TOKENIZER,
    loss_kinds: tuple[str, ...] = ("answer", "rationale"),
    tokens_per_segment: int = 32,
    loss_share: float = 0.75,
    **options,
) -> DataFrame:
    """``pack`` for texts: all tokens of the kinds in ``loss_kinds`` bear loss, others none.

    A window takes ``capacity_tokens / tokens_per_segment`` segments (8 at least) and
    ``loss_share`` of its capacity in loss-bearing tokens. Only a text longer than the
    window is cut. Different texts under one id, and all texts with a null id, count.
    """
    sizes = stage(token_counts(documents.withColumn("digest", F.unhex(F.sha2("text", 256))), "doc_id", "text", tokenizer, keep=("kind", "digest")))
    bears = F.coalesce(F.col("kind").isin(*loss_kinds), F.lit(False))
    examples = sizes.select("doc_id", "digest", "tokens", F.when(bears, F.col("tokens")).otherwise(0).alias("loss_tokens"))
    return pack(examples, window_limits(windows, tokens_per_segment, loss_share), loss_cuts=False, apart=("digest",), **options)


def window_limits(windows: DataFrame, tokens_per_segment: int = 32, loss_share: float = 0.75) -> DataFrame:
    """``windows`` as kinds of containers, with their limits on segments and loss-bearing tokens."""
    capacity = F.col("capacity_tokens")
    return windows.select("window_id", "capacity_tokens", F.greatest(F.lit(8), F.floor(capacity / tokens_per_segment)).cast("int").alias("max_segments"), F.greatest(F.lit(1), F.floor(capacity * loss_share)).cast("int").alias("max_loss_tokens"))


def packing_sums(packed: DataFrame, limits: DataFrame, full: float = 0.95) -> DataFrame:
    """A row for each kind of container that has examples: what was packed, and what is wrong with it.

    ``window_id, documents``, the containers over a limit (``overfull``), the documents
    whose pieces don't follow on one another from token 0 (``broken``), those in several
    pieces though they fit a container (``cut``), and whether containers are ``filled`` to
    the share ``full`` on average. A single piece may bear more loss than allowed.
    """
    rows = packed.join(small(limits), "window_id")
    size = F.col("token_end") - F.col("token_start")
    used = rows.filter("container_id is not null").groupBy("window_id", "container_id").agg(
        F.sum(size).alias("n"), F.count(F.lit(1)).alias("s"), F.sum("loss_tokens").alias("l"), F.count_if(F.col("loss_tokens") > 0).alias("bear"),
        F.first("capacity_tokens").alias("capacity"), F.first("max_segments").alias("segments"), F.first("max_loss_tokens").alias("loss"),
    )
    over = (F.col("n") > F.col("capacity")) | (F.col("s") > F.col("segments")) | ((F.col("l") > F.col("loss")) & (F.col("bear") > 1))
    boxes = used.groupBy("window_id").agg(F.count_if(over).alias("overfull"), (F.sum("n") >= full * F.sum("capacity")).alias("filled"))
    pieces = rows.filter("doc_id is not null").groupBy("window_id", "doc_id").agg(F.max("token_end").alias("n"), F.sum(size).alias("held"), F.min("token_start").alias("a"), F.count(F.lit(1)).alias("c"), F.first("capacity_tokens").alias("capacity"))
    docs = pieces.groupBy("window_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("held") != F.col("n")) | (F.col("a") > 0)).alias("broken"), F.count_if((F.col("c") > 1) & (F.col("n") <= F.col("capacity"))).alias("cut"))
    return docs.join(boxes, "window_id").select("window_id", "documents", "overfull", "broken", "cut", "filled")


def expected_containers(tokens: int, capacity: int) -> int:
    """The least number of containers that ``tokens`` could fill."""
    return math.ceil(tokens / capacity)
