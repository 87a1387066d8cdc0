"""Running totals and row numbers over ordered groups without a single-partition window."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, partitions_for

PART, LOCAL, OFFSET, TOTAL = "__part", "__local", "__offset", "__total"


def differs(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two arrays differ; nulls equal nulls."""
    unlike = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return unlike | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))


def _local_totals(n_keys: int, weight: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i) for i in range(n_keys)]
            opens = np.zeros(batch.num_rows, bool)
            for k in keys:
                opens[1:] |= differs(k[1:], k[:-1])
            head = [k[0].as_py() for k in keys]
            sums = np.cumsum(batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64))
            if last is not None and head == last:
                sums += carried
            at = np.flatnonzero(opens)
            base = np.zeros(batch.num_rows, np.int64)
            if len(at):
                base[at] = np.diff(np.concatenate([[0], sums[at - 1]]))
                base = np.cumsum(base)
            sums -= base
            last, carried = [k[-1].as_py() for k in keys], int(sums[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums)], names=[*batch.schema.names, LOCAL])

    return run


def running_total(df: DataFrame, group: list[str], order: list[str | Column], weight: str, *, name: str = "running", total: str | None = None, partitions: int | None = None) -> DataFrame:
    """`df` with the inclusive running total of the bigint column `weight` in each group, in `order` (nulls last).

    A full distributed sort: one range exchange on (group, order), so that a hot group spreads over as many partitions
    as it needs; totals of each partition and group (partitions + groups rows in all) give the offset at which each
    partition continues a group; the running count inside a partition needs no further exchange. Range bounds are
    sampled, so the sorted rows are written once and both passes read the same partitions.

    `total` names a further column with the group's whole total. A null weight counts nothing, null keys group
    together, and rows tied in `order` follow one another in some order. An empty table gives no rows.
    """
    spark = df.sparkSession
    order = [F.col(f"`{o}`") if isinstance(o, str) else o for o in order]
    keys = [F.col(f"`{g}`") for g in group]
    by = [k.asc_nulls_last() for k in keys] + [o.asc_nulls_last() if "NULLS" not in str(o) else o for o in order]
    rest = [c for c in df.columns if c not in group and c != weight]
    rows = df.withColumn(weight, F.coalesce(F.col(f"`{weight}`").cast("bigint"), F.lit(0).cast("bigint")))
    rows = rows.repartitionByRange(partitions or partitions_for(spark), *by).sortWithinPartitions(*by)
    rows = cut(rows.select(*keys, *(F.col(f"`{c}`") for c in rest), F.col(f"`{weight}`"), F.spark_partition_id().alias(PART)))

    at = Window.partitionBy(*keys)
    totals = rows.groupBy(PART, *keys).agg(F.sum(f"`{weight}`").alias(LOCAL))
    before = F.coalesce(F.sum(LOCAL).over(at.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    named = [k.alias(f"__g{i}") for i, k in enumerate(keys)]
    schema = T.StructType([*rows.schema.fields, T.StructField(LOCAL, T.LongType())])
    local = rows.mapInArrow(_local_totals(len(group), len(group) + len(rest)), schema)

    def same_group(other: DataFrame) -> list[Column]:
        return [local[g].eqNullSafe(other[f"__g{i}"]) for i, g in enumerate(group)]

    # Only a partition's first group can go on from another partition: at most one row a partition.
    carried = F.broadcast(totals.select(PART, *named, before.alias(OFFSET)).where(F.col(OFFSET) != 0))
    out = local.join(carried, reduce(and_, [local[PART] == carried[PART], *same_group(carried)]), "left")
    columns = [*(local[c] for c in df.columns), (local[LOCAL] + F.coalesce(carried[OFFSET], F.lit(0))).alias(name)]
    if total and not group:
        columns.append(F.lit(totals.agg(F.sum(LOCAL)).first()[0]).cast("bigint").alias(total))
    elif total:
        # One row a group; the engine broadcasts it or not, as its size has it.
        sums = totals.groupBy(*named).agg(F.sum(LOCAL).alias(TOTAL))
        out = out.join(sums, reduce(and_, same_group(sums)))
        columns.append(sums[TOTAL].alias(total))
    return out.select(*columns)


def numbered(df: DataFrame, group: list[str], order: list[str | Column], *, name: str = "row_number", partitions: int | None = None) -> DataFrame:
    """`df` with 1-based row numbers of each group (of the whole table, if `group` is empty) in `order`; see running_total."""
    out = running_total(df.withColumn("__one", F.lit(1).cast("bigint")), group, order, "__one", name=name, partitions=partitions)
    return out.drop("__one")


def located(places: DataFrame, targets: DataFrame, group: list[str], at: str, rank: str, carry: list[str]) -> DataFrame:
    """`targets` with `carry` of the last row of `places` in the same group whose `at` is at most the target's `rank`.

    One sweep over both, no pairs: places and targets of a group are ordered together and each target takes what it passed last.
    """
    kept = [c for c in targets.columns if c not in group and c != rank]
    blank = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    a = places.select(*group, F.col(at).alias("__at"), F.lit(0).alias("__kind"), *carry, *(blank(targets, c) for c in kept))
    b = targets.select(*group, F.col(rank).alias("__at"), F.lit(1).alias("__kind"), *(blank(places, c) for c in carry), *kept)
    sweep = Window.partitionBy(*group).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).select(*group, "__at", "__kind", *kept, *(F.last(c, ignorenulls=True).over(sweep).alias(c) for c in carry))
    return out.where("__kind = 1").select(*group, F.col("__at").alias(rank), *kept, *carry)
