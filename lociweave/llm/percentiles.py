"""Exact percentiles per group over very large columns, with parts that combine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.running import running_total


def summarize(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The sorted multiset of each group in run-length form: the group's columns, `value`, `n` (its count).

    This is a part that combines without loss: the parts of separate files or days add up to the part of the whole.
    Equal values are counted before the exchange, so a hot group with few distinct values costs little; one with as many
    distinct values as rows spreads over all partitions, since values belong to the exchange's key.
    Whole numbers are kept as bigints, so large ones stay apart; decimals and floats become doubles. Nulls and NaNs count
    nothing; null group values form a group of their own.
    """
    whole = df.select(F.col(f"`{value}`")).schema[0].dataType.typeName() in ("byte", "short", "integer", "long")
    v = F.col(f"`{value}`").cast("bigint" if whole else "double")
    rows = df.select(*(F.col(f"`{g}`") for g in group), v.alias("__value")).where(v.isNotNull() if whole else v.isNotNull() & ~F.isnan(v))
    return rows.groupBy(*(F.col(f"`{g}`") for g in group), "__value").agg(F.count("*").alias("__n")).withColumnsRenamed({"__value": "value", "__n": "n"})


def combine(parts: list[DataFrame], group: list[str]) -> DataFrame:
    """One part from several. Parts of whole numbers and of doubles don't mix without loss and are refused."""
    if len({p.schema["value"].dataType.typeName() for p in parts}) > 1:
        raise ValueError("parts hold values of different types")
    return reduce(DataFrame.unionByName, parts).groupBy(*group, "value").agg(F.sum("n").alias("n"))


def percentiles(part: DataFrame, group: list[str], points: list[float], *, partitions: int | None = None) -> DataFrame:
    """The exact percentiles at `points` (0 to 1) of each group of a part, and `n`, its number of values.

    Full distributed sort of (group, value): counts by partition and group give the offset of each partition in its
    groups, so every run of equal values knows its ranks. A percentile p of n values lies at rank p*(n-1) (from 0); the
    order statistics on either side are found by rank and interpolated. The rank error is zero.

    Gives the group's columns, `n`, and three arrays in the order of `points`: `values` (double), and the order statistics
    on either side, `low` and `high`, in the part's own type; where a percentile lies on one, both are it. A group of one
    value has that value at every point; ties are plain; an empty part gives no rows. A group column may not be called
    value or n.
    """
    if bad := [p for p in points if not 0 <= p <= 1]:
        raise ValueError(f"points outside 0 to 1: {bad}")
    ranked = running_total(part, group, ["value"], "n", name="__upto", total="__all", partitions=partitions)
    first = F.col("__upto") - F.col("n")
    rank = lambda p, n: F.lit(float(p)) * (n - 1)
    aims = []
    for i, p in enumerate(points):
        low = F.floor(rank(p, F.col("__all")))
        for side, at in enumerate((low, F.ceil(rank(p, F.col("__all"))))):
            aims.append(F.when((at >= first) & (at < F.col("__upto")), F.lit(2 * i + side)))
    keys = [F.col(f"`{g}`") for g in group]
    hits = ranked.select(*keys, "value", F.col("__all").alias("n"), F.explode(F.filter(F.array(*aims), lambda x: x.isNotNull())).alias("aim"))
    by = hits.groupBy(*keys).agg(F.first("n").alias("n"), *(F.max(F.when(F.col("aim") == a, F.col("value"))).alias(f"__{a}") for a in range(2 * len(points))))
    low, high = ([F.col(f"__{2 * i + side}") for i in range(len(points))] for side in (0, 1))
    share = [rank(p, F.col("n")) - F.floor(rank(p, F.col("n"))) for p in points]
    values = [a.cast("double") * (1 - w) + b.cast("double") * w for a, b, w in zip(low, high, share)]
    return by.select(*keys, "n", F.array(*values).alias("values"), F.array(*low).alias("low"), F.array(*high).alias("high"))
