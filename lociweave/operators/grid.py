"""Irregular readings onto a regular grid, missing periods filled by iterative singular-spectrum imputation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, partitions_for

#: Periods of a block, and of its neighbours on either side that it is imputed with; periods that one of the next coarser
#: series takes together.
BLOCK, HALO, COARSE = 512, 64, 64
#: A block with fewer readings than this takes what the coarser series say about its gaps.
ENOUGH = 4
#: Most periods of a source; one whose last reading lies beyond is refused by name.
MOST_PERIODS = 100_000_000


def impute(values: np.ndarray, window: int = 24, rank: int = 3, tolerance: float = 1e-4, free_rounds: int = 100, ridge: float = 0.005) -> np.ndarray:
    """`values` with its NaNs filled by iterative singular-spectrum imputation.

    From a linear start, the Hankel matrix of lagged windows is cut down to its first `rank` singular vectors and its
    diagonal means replace the missing entries, again and again until none moves by `tolerance` (in standard deviations).
    Fills are drawn to the trend by the share `ridge`, and after `free_rounds` rounds the singular vectors stay as they
    are: embedding, projection and diagonal means are then projections in one weighted norm, each round brings the
    entries nearer by at least `ridge`, and the loop ends by itself. A series too short to embed, or with no more readings
    than its line has parameters, is its own fixed point and keeps the linear start.
    """
    known = ~np.isnan(values)
    if known.all() or not known.any():
        return values
    at, n = np.arange(len(values)), len(values)
    x = np.interp(at, at[known], values[known])
    low, scale = x[known].mean(), x[known].std() or 1.0
    x = (x - low) / scale
    # The trend of a counter is taken out first, so that few singular vectors are enough for what is left.
    trend = np.polyval(np.polyfit(at[known], x[known], 1), at) if known.sum() > 1 else np.full(n, x[known][0])
    y, missing = x - trend, ~known
    length = max(1, min(window, n // 2))
    kept = max(1, min(rank, length - 1))
    weights = np.convolve(np.ones(length), np.ones(n - length + 1))
    if length == 1:
        return np.where(known, values, x * scale + low)
    hankel = np.lib.stride_tricks.sliding_window_view(y, length).T
    rounds, moved = 0, np.inf
    while moved >= tolerance:
        if rounds < free_rounds:
            _, vectors = np.linalg.eigh(hankel @ hankel.T)
            top = vectors[:, -kept:]
        rows = top.T @ hankel
        smooth = sum(np.convolve(rows[i], top[:, i]) for i in range(kept)) / weights
        now = (1 - ridge) * smooth[missing]
        moved = np.abs(now - y[missing]).max()
        # The Hankel matrix is a view of y.
        y[missing] = now
        rounds += 1
    return np.where(known, values, (y + trend) * scale + low)


NOWHERE = (np.nan, np.nan)


def _between(filled: np.ndarray, known: np.ndarray, before: tuple[float, float] = NOWHERE, after: tuple[float, float] = NOWHERE) -> np.ndarray:
    """Filled values kept between the known values on either side of their gap, and in the gap's direction.

    `before` and `after`: place and value of the nearest readings outside of the series' own block, NaN where there are none.
    """
    out, at = filled.copy(), np.flatnonzero(known).tolist()
    ends = [(i, out[i]) for i in at]
    if not np.isnan(before[0]) and (not at or before[0] < at[0]):
        ends = [(-1, before[1]), *ends]
    if not np.isnan(after[0]) and (not at or after[0] > at[-1]):
        ends.append((len(out), after[1]))
    for (i, x), (j, y) in zip(ends, ends[1:]):
        if j - i > 1:
            inner = np.clip(out[i + 1 : j], min(x, y), max(x, y))
            out[i + 1 : j] = np.maximum.accumulate(inner) if x <= y else np.minimum.accumulate(inner)
    if ends:
        out[: max(0, ends[0][0])] = np.minimum(out[: max(0, ends[0][0])], ends[0][1])
        out[ends[-1][0] + 1 :] = np.maximum(out[ends[-1][0] + 1 :], ends[-1][1])
    return out


def _coarse_points(points: list, step: int, first: int, last: int, window: int, rank: int) -> list[tuple[float, float]]:
    """(period, value) of a coarser series, imputed as a whole, from the period before `first` to the one after `last`."""
    at, value = np.array([p["p"] for p in points]), np.array([p["v"] for p in points], float)
    series = np.full(int(at[-1] - at[0]) + 1, np.nan)
    series[at - at[0]] = value
    filled = impute(series, window, rank)
    # A coarse period's value is that of its last reading, so it stands at that reading; filled ones are spaced evenly.
    ends = np.interp(np.arange(len(series)), at - at[0], [p["at"] for p in points])
    near = (ends >= first - 2 * step) & (ends <= last + 2 * step)
    return list(zip(ends[near].tolist(), filled[near].tolist()))


def _fill(block: int, halo: int, coarse: int, window: int, rank: int, counter: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            number, end = (batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(2))
            lists = batch.column(3)
            offsets, flat = lists.offsets.to_numpy(), lists.values
            p_all, n_all = flat.field("p").to_numpy(zero_copy_only=False), flat.field("n").to_numpy(zero_copy_only=False)
            v_all = flat.field("v").to_numpy(zero_copy_only=False).astype(float)
            sides = [[batch.column(4 + i).field(f).to_numpy(zero_copy_only=False).astype(float) for f in ("p", "v")] for i in range(2)]
            row, period, value, readings = [], [], [], []
            for i in range(batch.num_rows):
                first = int(number[i]) * block
                last = min(int(end[i]), first + block - 1)
                lo, hi = max(0, first - halo), min(int(end[i]), last + halo)
                p, v, n = (x[offsets[i] : offsets[i + 1]] for x in (p_all, v_all, n_all))
                series, seen = np.full(hi - lo + 1, np.nan), np.zeros(hi - lo + 1, np.int64)
                series[p - lo], seen[p - lo] = v, n
                known = ~np.isnan(series)
                own = slice(first - lo, last - lo + 1)
                if not known[own].all():
                    wide = batch.column(6)[i].as_py()
                    if wide is not None:
                        # Too few readings here: the coarser series' own and imputed values stand in between.
                        points = dict(_coarse_points(sorted(wide["xs"], key=lambda x: x["p"]), coarse ** wide["level"], lo, hi, window, rank))
                        points |= {int(q) + lo: series[q] for q in np.flatnonzero(known)} | {int(s[0][i]): s[1][i] for s in sides if not np.isnan(s[0][i])}
                        filled = np.interp(np.arange(lo, hi + 1), *zip(*sorted(points.items())))
                        filled = np.where(known, series, filled)
                    else:
                        filled = impute(series, window, rank)
                    if counter:
                        # Between the readings on either side, those outside of the block too.
                        outer = [(s[0][i] - lo, s[1][i]) for s in sides]
                        filled = _between(filled, known, *outer)
                    series = filled
                size = last - first + 1
                row.append(np.full(size, i))
                period.append(np.arange(first, last + 1))
                value.append(series[own])
                readings.append(seen[own])
            taken = pa.array(np.concatenate(row))
            value, readings = np.concatenate(value), np.concatenate(readings)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), pa.array(np.concatenate(period)), pa.array(value, mask=np.isnan(value)), pa.array(readings), pa.array(readings == 0)],
                names=["k0", "p", "v", "n", "filled"],
            )

    return run


def regular_grid(
    readings: DataFrame,
    source: list[str],
    at: str,
    value: str,
    period: int,
    *,
    names: tuple[str, str, str, str] = ("period_index", "value", "readings", "filled"),
    counter: bool = True,
    block: int = BLOCK,
    halo: int = HALO,
    coarse: int = COARSE,
    window: int = 24,
    rank: int = 3,
    most_periods: int = MOST_PERIODS,
) -> DataFrame:
    """One row for each period 0 to that of the last reading, of each source.

    `at` (an integer) divided by `period` gives the period of a reading. Gives the source's columns and `names`: the
    period (bigint), its last reading or the filled value (double), its number of readings, and whether it was filled.

    Readings are reduced to one a period before they are shuffled by source. A source's grid is cut into blocks of
    `block` periods with `halo` periods of their neighbours on either side; each block is imputed by itself (`impute`), so
    a source of any length spreads over many tasks and a task holds one block at a time. A block with fewer than ENOUGH
    valued readings within its halos is filled from a coarser series of its source, whose periods take `coarse`, or
    `coarse` squared and so on, together: the finest in which the block's stretch has enough readings, or else the
    coarsest. That series is imputed in the same way and the block's readings and the imputed points are joined up. With
    `counter`, filled values stay between those beside their gap.

    Defined results: readings with a null or negative time are left out; a null value is a reading, whose value is
    filled in without the mark; at equal times the greater value counts; repeated readings count as readings; null
    sources form a source of their own; a source without any value keeps nulls; an empty table gives no rows. A source
    whose last reading lies beyond `most_periods` periods is refused by name: it gives one row with its number of
    readings and null for the rest, and the other sources come out as ever.
    """
    spark = readings.sparkSession
    # One struct holds the source's columns: it is never null itself, so null sources join and group like any other.
    rows = readings.select(F.struct(*(F.col(f"`{s}`").alias(f"f{i}") for i, s in enumerate(source))).alias("k0"), F.col(f"`{at}`").cast("bigint").alias("t"), F.col(f"`{value}`").cast("double").alias("v")).where("t >= 0")
    seen = rows.groupBy("k0", F.expr(f"t div {int(period)}").alias("p")).agg(F.max(F.struct(F.col("v").isNotNull().alias("ok"), "t", "v")).alias("x"), F.count("*").alias("n")).select("k0", "p", F.col("x.v").alias("v"), "n")
    seen = cut(seen)
    ends = seen.groupBy("k0").agg(F.max("p").alias("end"), F.sum("n").alias("n"))
    refused = ends.where(f"end >= {most_periods}").select("k0", F.lit(None).cast("bigint").alias("p"), F.lit(None).cast("double").alias("v"), "n", F.lit(None).cast("boolean").alias("filled"))
    b = F.expr(f"p div {block}")
    near = F.array(b, F.when(F.col("p") - b * block < halo, b - 1), F.when((b + 1) * block - F.col("p") <= halo, b + 1))
    held = seen.withColumn("b", F.explode(F.filter(near, lambda x: x >= 0))).groupBy("k0", "b").agg(F.collect_list(F.struct("p", "v", "n")).alias("xs"), F.count("v").alias("valued"))
    # Block numbers in two steps, so that no array grows with a source's length.
    steps = ends.where(f"end < {most_periods}").select("k0", "end", F.explode(F.expr(f"sequence(0L, end div {block} div 1000)")).alias("step"))
    marks = steps.select("k0", F.explode(F.expr(f"sequence(step * 1000, least(end div {block}, step * 1000 + 999))")).alias("b"), "end")
    # The nearest values outside of each block: one short row a block meets its source's others.
    valued = seen.where("v IS NOT NULL").groupBy("k0", b.alias("b")).agg(F.min(F.struct("p", "v")).alias("head"), F.max(F.struct("p", "v")).alias("tail"))
    sides = marks.join(valued, ["k0", "b"], "left").select(
        "k0", "b", "end",
        F.last("tail", ignorenulls=True).over(Window.partitionBy("k0").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.last("head", ignorenulls=True).over(Window.partitionBy("k0").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)).alias("after"),
    )
    # A block costs far more than its bytes suggest: the width is given, so that small partitions aren't merged.
    sides = sides.repartition(max(partitions_for(spark), spark.sparkContext.defaultParallelism), "k0", "b")
    blocks = sides.join(held, ["k0", "b"], "left")
    none = F.expr("cast(array() as array<struct<p: bigint, v: double, n: bigint>>)")
    blocks = blocks.select("k0", "b", "end", F.coalesce("xs", none).alias("xs"), "before", "after", F.coalesce("valued", F.lit(0)).alias("valued"))
    # Coarser series, as many as the longest source needs for its whole length to lie in one block of the coarsest.
    longest = ends.where(f"end < {most_periods}").agg(F.max("end")).first()[0] or 0
    levels = [k for k in range(1, 64) if k == 1 or block * coarse ** (k - 1) <= longest]
    spans = [block * coarse**k for k in levels]
    fewer = [seen.where("v IS NOT NULL").groupBy("k0", F.lit(k).alias("level"), F.expr(f"p div {coarse**k}").alias("q")).agg(F.max(F.struct("p", "v")).alias("x")).select("k0", "level", F.expr(f"q div {block}").alias("wide"), F.struct(F.col("q").alias("p"), F.col("x.v").alias("v"), F.col("x.p").alias("at")).alias("x")) for k in levels]
    # A stretch of a coarser series is imputed with the stretches on either side.
    around = F.filter(F.array(F.col("wide") - 1, F.col("wide"), F.col("wide") + 1), lambda x: x >= 0)
    wide = reduce(DataFrame.unionByName, fewer).withColumn("wide", F.explode(around)).groupBy("k0", "level", "wide").agg(F.collect_list("x").alias("xs"))
    poor = blocks.where(f"valued < {ENOUGH}").select("k0", "b", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.expr(f"b * {block} div {n}").alias("wide")) for k, n in zip(levels, spans)))).alias("w")).select("k0", "b", "w.*")
    best = poor.join(wide, ["k0", "level", "wide"]).groupBy("k0", "b").agg(F.min_by(F.struct("level", "xs"), F.when(F.size("xs") >= ENOUGH, F.col("level")).otherwise(100 - F.col("level"))).alias("wide"))
    blocks = blocks.drop("valued").join(best, ["k0", "b"], "left")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"k0 {types['k0']}, p bigint, v double, n bigint, filled boolean"
    out = blocks.mapInArrow(_fill(block, halo, coarse, window, rank, counter), schema).unionByName(refused)
    return out.select(*(F.col(f"k0.f{i}").alias(s) for i, s in enumerate(source)), *(F.col(c).alias(n) for c, n in zip(("p", "v", "n", "filled"), names)))
