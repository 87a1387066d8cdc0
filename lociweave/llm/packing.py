"""Vector bin packing of texts into containers of fixed capacity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, partitions_for

BLOCK_ITEMS = 8000
#: Copies of one item that are numbered at a time.
COPIES = 10_000
MOST_PACKS = 1000


def pack(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container number of each item. sizes: items x dimensions, none above `limits`; limits: by dimension.

    Containers are filled one after the other. Of the kinds of item (rows of equal sizes) that still fit, the next is the
    one with the largest dot product of its sizes with the room left, both as shares of the limits and weighted by how
    much all items together need of each dimension; of equal ones the first kind in descending order of sizes.
    """
    kinds, of = np.unique(-sizes, axis=0, return_inverse=True)
    kinds, of = -kinds, of.ravel()
    if (kinds > limits).any():
        raise ValueError("an item is above the limits")
    queue = np.argsort(of, kind="stable")
    left = np.bincount(of, minlength=len(kinds))
    at = np.cumsum(left) - left
    share = kinds / limits
    weight = share.T @ left
    scored = share * (weight / max(weight.sum(), 1e-12))
    out = np.empty(len(sizes), np.int64)
    # Kinds lie in descending order of the first size, so those whose first size still fits are a tail of the arrays.
    first, rest, live = -kinds[:, 0], kinds[:, 1:].T.copy(), len(kinds)
    container = 0
    while live:
        room, empty = limits.astype(float), True
        while True:
            tail = int(np.searchsorted(first, -room[0]))
            score = scored[tail:] @ (room / limits)
            for size, most in zip(rest, room[1:]):
                score[size[tail:] > most] = -1
            score[left[tail:] == 0] = -1
            if not len(score) or score[k := int(score.argmax())] < 0:
                break
            k += tail
            out[queue[at[k]]] = container
            at[k] += 1
            left[k] -= 1
            live -= left[k] == 0
            room -= kinds[k]
            empty = False
        container += not empty
        if live < 0.7 * len(left):
            keep = left > 0
            kinds, scored, first, rest, left, at = kinds[keep], scored[keep], first[keep], rest[:, keep].copy(), left[keep], at[keep]
    return out


def packed(
    items: DataFrame,
    item: list[str],
    tokens: str,
    packs: DataFrame,
    *,
    pack_name: str = "pack_name",
    capacity: str = "capacity_tokens",
    loss_tokens: str | None = None,
    tokens_per_segment: int = 16,
    loss_share: float = 1.0,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """Containers for all items, for every capacity in `packs`.

    An item (the columns `item`) weighs three things: its tokens, one segment, and its loss-bearing tokens (the column
    `loss_tokens`, or else all its tokens but the first, which nothing predicts). A container holds at most the
    capacity in tokens, capacity / `tokens_per_segment` segments (at least four) and `loss_share` of the capacity in
    loss-bearing tokens. Only an item of more tokens than the capacity is split: into pieces of just the capacity, each
    with a container of its own, and a rest that is packed like an item; its loss-bearing tokens are shared out by length.

    Gives pack_name, container (bigint), the item's columns, piece, first_token (from 0), n_tokens, loss_tokens. Items are
    dealt at random into blocks of about `block_items`, so that a block is a fair sample of lengths; each block is packed
    by itself with the dot-product heuristic and a container number carries its block's. A block leaves no more than its
    last containers part full. An item's block follows from its columns, its weights and the number of its copy alone, so
    the containers are the same however the input is partitioned.

    Defined results: items without tokens (null or empty texts) take no room and come out once for each pack with a null
    container; a null capacity or one below 1 gives nothing; repeated items are packed as often as they come; packs of
    the same name and capacity count once. An item or piece whose loss-bearing tokens alone are above their limit isn't
    split for them: it is its container's only item, and every other container keeps all three limits.
    """
    spark = items.sparkSession
    names = [f"i{k}" for k in range(len(item))]
    loss = F.col(f"`{loss_tokens}`") if loss_tokens else F.greatest(F.col(f"`{tokens}`") - 1, F.lit(0))
    weighed = items.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(item, names)), F.greatest(F.coalesce(F.col(f"`{tokens}`"), F.lit(0)), F.lit(0)).cast("bigint").alias("tokens"), F.greatest(F.coalesce(loss, F.lit(0)), F.lit(0)).cast("bigint").alias("loss"))
    # Copies are counted, with partial counts before the exchange, and numbered: a hot item spreads over the blocks.
    rows = cut(weighed.groupBy(*names, "tokens", "loss").agg(F.count("*").alias("copies")))
    blocks = max(1, -(-(rows.agg(F.sum("copies")).first()[0] or 0) // block_items))
    settings = packs.select(F.col(f"`{pack_name}`").cast("string").alias("pack"), F.col(f"`{capacity}`").cast("bigint").alias("cap")).where("cap >= 1").distinct().orderBy("pack", "cap").limit(MOST_PACKS + 1).collect()
    if len(settings) > MOST_PACKS:
        raise ValueError(f"more than {MOST_PACKS} packs")
    each = F.array(*(F.struct(F.lit(x.pack).cast("string").alias("pack"), F.lit(x.cap).cast("bigint").alias("cap"), F.lit(i * blocks).cast("bigint").alias("at")) for i, x in enumerate(settings))) if settings else F.expr("cast(array() as array<struct<pack: string, cap: bigint, at: bigint>>)")
    tens = rows.withColumn("ten", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")))
    single = tens.withColumn("copy", F.explode(F.expr(f"sequence(ten * {COPIES}, least(copies, (ten + 1) * {COPIES}) - 1)")))
    dealt = single.withColumn("block", F.pmod(F.xxhash64(*names, "tokens", "loss", "copy"), F.lit(blocks)))
    dealt = dealt.withColumn("pack", F.explode(each)).select(*names, "tokens", "loss", "block", "pack.*").withColumn("at", F.col("at") + F.col("block"))
    # One task a block, as far as the session is wide: packing a block costs far more than its bytes suggest, so neither
    # chance nor size shall put blocks together.
    tasks = max(1, min(blocks * len(settings), max(partitions_for(spark), spark.sparkContext.defaultParallelism)))
    dealt = dealt.repartitionById(tasks, F.pmod(F.col("at"), F.lit(tasks)).cast("int"))
    dealt = dealt.sortWithinPartitions("at", F.desc("tokens"), F.desc("loss"), *names)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(["pack string, container bigint", *(f"{n} {types[n]}" for n in names), "piece bigint, first_token bigint, n_tokens bigint, loss_tokens bigint"])

    def solve(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        cap, block = batch.column("cap")[0].as_py(), batch.column("block")[0].as_py()
        n, lost = batch.column("tokens").to_numpy(), batch.column("loss").to_numpy()
        pieces = np.maximum(-(-n // cap), 1)
        of = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(n[of] - piece * cap, cap)
        # Loss-bearing tokens up to a piece's end less those up to its start, so that the pieces' add up to the item's.
        upto = lambda t: (lost[of] * (t / np.maximum(n[of], 1))).astype(np.int64)
        loss_size = np.where(pieces[of] > 1, np.where(piece + 1 == pieces[of], lost[of], upto((piece + 1) * cap)) - upto(piece * cap), lost[of])
        limits = np.array([cap, max(4, cap // tokens_per_segment), max(1, int(cap * loss_share))])
        container = np.full(len(of), -1, np.int64)
        alone = (size > 0) & ((size == cap) | (loss_size > limits[2]))
        free = np.flatnonzero((size > 0) & ~alone)
        used = 0
        if len(free):
            container[free] = pack(np.stack([size, np.ones(len(of), np.int64), loss_size], axis=1)[free], limits)
            used = int(container[free].max()) + 1
        container[alone] = used + np.arange(int(alone.sum()))
        taken = pa.array(of)
        number = pa.array((container * blocks) + block, mask=container < 0)
        kept = [batch.column(k).take(taken) for k in names]
        return pa.RecordBatch.from_arrays([batch.column("pack").take(taken), number, *kept, pa.array(piece), pa.array(piece * cap), pa.array(size), pa.array(loss_size)], names=["pack", "container", *names, "piece", "first_token", "n_tokens", "loss_tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column("at").to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for a, b in zip(starts, starts[1:]):
                if at[a] != now and held:
                    yield solve(held)
                    held = []
                now = at[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield solve(held)

    out = dealt.mapInArrow(run, schema)
    return out.select(F.col("pack").alias(pack_name), "container", *(F.col(n).alias(c) for n, c in zip(names, item)), "piece", "first_token", "n_tokens", "loss_tokens")
