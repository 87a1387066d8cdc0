"""Periods and gaps of overlapping, nested or gapped integer intervals, by a two-level merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_BITS = 16
BUFFER_ROWS = 400_000
PIECES = 1 << 20


def _merge(keys: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers (of one row a period), firsts and lasts of the covered periods of each key."""
    order = np.lexsort((first, *keys))
    first, last = first[order], last[order]
    new_key = np.zeros(len(order), bool)
    new_key[:1] = True
    for k in keys:
        k = k[order]
        new_key[1:] |= k[1:] != k[:-1]
    # A running maximum that starts again with each key: lasts are shifted apart by the key's number.
    rank = np.cumsum(new_key) - 1
    low = int(last.min())
    span = int(last.max()) - low + 2
    if span * (int(rank[-1]) + 1) < 2**62:
        reach = np.maximum.accumulate(last - low + rank * span) - rank * span + low
    else:
        starts = np.flatnonzero(new_key)
        reach = np.concatenate([np.maximum.accumulate(x) for x in np.split(last, starts[1:])])
    opens = new_key.copy()
    opens[1:] |= first[1:] > reach[:-1] + 1
    at = np.flatnonzero(opens)
    ends = np.append(at[1:], len(order)) - 1
    return order[at], first[at], reach[ends]


def _premerge(n_keys: int, shard_bits: int, buffer_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            columns = [t.column(i).combine_chunks() for i in range(n_keys)]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            codes = [c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
            row, first, last = _merge(codes, t.column(n_keys).to_numpy().astype(np.int64), t.column(n_keys + 1).to_numpy().astype(np.int64))
            # Clip the merged periods at shard boundaries, so many pieces at a time.
            shard_of_first = first >> shard_bits
            upto = np.cumsum((last >> shard_bits) - shard_of_first + 1)
            for lo in range(0, int(upto[-1]), PIECES):
                piece = np.arange(lo, min(lo + PIECES, int(upto[-1])))
                of = np.searchsorted(upto, piece, side="right")
                shard = shard_of_first[of] + piece - np.where(of > 0, upto[of - 1], 0)
                a = np.maximum(first[of], shard << shard_bits)
                b = np.minimum(last[of], ((shard + 1) << shard_bits) - 1)
                taken = pa.array(row[of])
                yield pa.RecordBatch.from_arrays([*(c.take(taken) for c in columns), pa.array(shard), pa.array(a), pa.array(b)], names=[*(f"k{i}" for i in range(n_keys)), "shard", "a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= buffer_rows:
                yield from flush()
                held, rows = [], 0
        if held:
            yield from flush()

    return run


def periods_and_gaps(
    df: DataFrame,
    entity: list[str],
    first: str,
    last: str,
    *,
    names: tuple[str, str, str] = ("kind", "first_position", "last_position"),
    shard_bits: int = SHARD_BITS,
    buffer_rows: int = BUFFER_ROWS,
) -> DataFrame:
    """Covered periods of each entity and the gaps between neighbouring ones.

    `first` and `last` are integer columns, both inclusive. The result has the entity's columns and `names`: the kind
    (`period` or `gap`), its first and its last point as bigint. Intervals that overlap or touch make one period.

    Level 1 merges each input partition's rows by entity in bounded buffers before anything is shuffled and clips the
    merged periods into shards of 2^shard_bits points, so that one entity's work spreads over as many tasks as it has
    shards, and a shard holds at most 2^(shard_bits-1) periods from each buffer. Level 2 merges within a shard; only the
    first and last period of a shard can touch or face a neighbouring shard, so only these are brought together by
    entity (two rows a shard) to stitch coverage across boundaries and to find the gaps between shards. A period makes
    one piece a shard, so shard_bits should suit the unit: about a thousand times a usual interval's length.

    Defined results: a null `first` or `last`, or last < first, covers nothing; null entity values form an entity of
    their own; repeated rows change nothing; an empty table gives no rows; other columns are ignored and may have any name.
    """
    keys = [f"k{i}" for i in range(len(entity))]
    start, end = F.col(f"`{first}`").cast("bigint"), F.col(f"`{last}`").cast("bigint")
    rows = df.select(*(F.col(f"`{e}`").alias(k) for e, k in zip(entity, keys)), start.alias("a"), end.alias("b")).where("b >= a")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "shard bigint, a bigint, b bigint"])
    local = rows.mapInArrow(_premerge(len(keys), shard_bits, buffer_rows), schema)

    by_shard = Window.partitionBy(*keys, "shard")
    sorted_ = by_shard.orderBy("a", "b")
    before = F.max("b").over(sorted_.rowsBetween(Window.unboundedPreceding, -1))
    islands = (
        local.withColumn("opens", before.isNull() | (F.col("a") > before + 1))
        .withColumn("start", F.last(F.when(F.col("opens"), F.col("a")), ignorenulls=True).over(sorted_.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("end", F.max("b").over(sorted_.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("closes", F.coalesce(F.lead("opens").over(sorted_), F.lit(True)))
        .where("closes")
        .select(*keys, "shard", F.col("start").alias("a"), F.col("end").alias("b"))
    )
    in_order = by_shard.orderBy("a")
    faced = islands.withColumn("next", F.lead("a").over(in_order)).withColumn("edge", F.col("next").isNull() | F.lag("a").over(in_order).isNull())
    # Inner periods keep their shard's number, edge periods of all shards of an entity meet under a null.
    met = faced.withColumn("salt", F.when(~F.col("edge"), F.col("shard")))
    stitch = Window.partitionBy(*keys, "salt").orderBy("a")
    stitched = (
        met.withColumn("opens", F.coalesce(F.col("a") > F.lag("b").over(stitch) + 1, F.lit(True)))
        .withColumn("after", F.lead("a").over(stitch))
        .withColumn("start", F.last(F.when(F.col("opens"), F.col("a")), ignorenulls=True).over(stitch.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("closes", F.col("after").isNull() | (F.col("after") > F.col("b") + 1))
        .withColumn("faces", F.coalesce(F.col("next"), F.when(F.col("edge"), F.col("after"))))
    )
    kind, low, high = names
    found = F.array(
        F.when(F.col("closes"), F.struct(F.lit("period").alias("kind"), F.col("start").alias("a"), F.col("b").alias("b"))),
        F.when(F.col("faces") > F.col("b") + 1, F.struct(F.lit("gap").alias("kind"), (F.col("b") + 1).alias("a"), (F.col("faces") - 1).alias("b"))),
    )
    out = stitched.select(*keys, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x"))
    return out.select(*(F.col(k).alias(e) for k, e in zip(keys, entity)), F.col("x.kind").alias(kind), F.col("x.a").alias(low), F.col("x.b").alias(high))
