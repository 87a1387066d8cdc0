"""Interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .intervals import periods_and_gaps


def interval_join(points: DataFrame, intervals: DataFrame, key: list[str], at: str, low: str, high: str, *, bin_width: int = 1 << 14, how: str = "inner") -> DataFrame:
    """Rows of `points` with each interval (low and high inclusive) of the same key that holds their `at`.

    `left_semi` and `left_anti` need no pairs: intervals are first merged into periods (a two-level merge, whatever their
    overlap), so a point meets one period at most. The other kinds give every match: both sides meet on (key, bin), an
    interval appears once in each bin it touches, a point in its own, so every match is found exactly once, nothing is
    paired beyond a bin, and a hot bin is split by the engine like any skewed join.

    `how`: inner, left (keeps unmatched points), full (also unmatched intervals, whose points' columns but the key are
    null), left_semi, left_anti. Null ends or keys match nothing. Columns of `intervals` besides the key follow those of
    `points`; names may not clash.
    """
    if how not in ("inner", "left", "full", "left_semi", "left_anti"):
        raise ValueError(f"unsupported interval join: {how}")
    if how in ("left_semi", "left_anti"):
        proper = intervals.where(F.col(low) <= F.col(high))
        for k in key:
            proper = proper.where(F.col(k).isNotNull())
        intervals = periods_and_gaps(proper, key, low, high, names=("__kind", low, high)).where("__kind = 'period'").drop("__kind")
    bin_of = lambda c: F.floor(F.col(c) / bin_width)
    a = points.withColumn("__bin", bin_of(at))
    marked = intervals.withColumn("__id", F.monotonically_increasing_id()) if how == "full" else intervals
    marked = cut(marked) if how == "full" else marked
    b = marked.where(F.col(low) <= F.col(high)).withColumn("__bin", F.explode(F.sequence(bin_of(low), bin_of(high))))
    left, right = a.alias("l"), b.alias("r")
    on = F.col("l.__bin") == F.col("r.__bin")
    for k in key:
        on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    on = on & (F.col(f"l.{at}") >= F.col(f"r.{low}")) & (F.col(f"l.{at}") <= F.col(f"r.{high}"))
    joined = left.join(right, on, "left" if how == "full" else how)
    rest = [c for c in intervals.columns if c not in key]
    kept = [F.col(f"l.{c}") for c in points.columns]
    if how in ("left_semi", "left_anti"):
        return joined.select(*kept)
    if how != "full":
        return joined.select(*kept, *(F.col(f"r.{c}") for c in rest))
    met = left.join(right, on, "inner").select(F.col("r.__id")).distinct()
    alone = marked.join(met, "__id", "left_anti")
    types = dict(points.dtypes)
    unmatched = alone.select(*((F.col(c) if c in key else F.lit(None)).cast(types[c]).alias(c) for c in points.columns), *rest)
    return joined.select(*kept, *(F.col(f"r.{c}") for c in rest)).unionByName(unmatched)
