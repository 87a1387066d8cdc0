"""Recorded shadow probes judged again over a grid of settings, and what the grid teaches."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, partitions_for
from .throughput import SECOND, Check, ProbeSettings, Series, capped_at, decide, grouped_checks, passing_runs, stop_reason


#: Most settings that checks are judged under at once; each check is repeated for each of them.
MOST_SETTINGS = 10_000


@dataclass(frozen=True)
class Grid:
    batch_durations_ns: tuple[int, ...] = (SECOND // 2, SECOND, 2 * SECOND, 5 * SECOND)
    window_groups: tuple[int, ...] = (5, 10, 20, 40)
    precisions: tuple[float, ...] = (0.01, 0.02, 0.05)
    consecutive_checks: tuple[int, ...] = (1, 3, 5, 10)
    min_durations_ns: tuple[int, ...] = (10 * SECOND, 20 * SECOND, 60 * SECOND)


RECORD = ["run_id", "poll_period_ns", "batch_duration_ns", "precision", "consecutive_checks", "window_groups", "min_duration_ns", "max_duration_ns", "first_partition_end_ns"]
PAIR = "run_id string, batch_duration_ns bigint, window_groups bigint"
CHECKS = f"{PAIR}, check_index bigint, sample_index bigint, elapsed_ns bigint, warmup_end_ns bigint, steady_state_throughput double, relative_half_width double"
BASELINES = f"{PAIR}, steady_state_throughput double, relative_half_width double, warmup_end_ns bigint, window_end_ns bigint, capped_at_ns bigint"
REPLAYS = f"{PAIR}, precision double, consecutive_checks bigint, min_duration_ns bigint, would_stop_ns bigint, would_be_steady_state_throughput double, would_be_relative_half_width double, would_be_warmup_end_ns bigint, probe_stop_reason string"


def shadow_series(records: DataFrame, progress: DataFrame) -> DataFrame:
    """Progress of the shadow runs, each sample once, with the settings of its run (the latest record of a run counts).

    A sample sent again is dropped; of samples that don't move time forward the first stays.
    """
    latest = records.where("action = 'shadow'").groupBy("run_id").agg(F.max(F.struct("started_at", *RECORD[1:])).alias("x")).select("run_id", *(F.col(f"x.{c}").alias(c) for c in RECORD[1:]))
    samples = progress.where("elapsed_ns IS NOT NULL AND rows IS NOT NULL").groupBy("run_id", "elapsed_ns").agg(F.max("rows").alias("rows_total"))
    return samples.join(latest, "run_id")


def _settings(row) -> ProbeSettings:
    base = ProbeSettings()
    names = {"poll_period_ns": "poll_period_ns", "batch_duration_ns": "batch_duration_ns", "precision": "precision", "consecutive_checks": "consecutive_checks", "window_groups": "window_groups", "min_duration_ns": "min_duration_ns", "max_duration_ns": "max_duration_ns"}
    return replace(base, **{k: (float if k == "precision" else int)(row[c]) for k, c in names.items() if not pd.isna(row[c])})


def stop_table(found: list[Check], precisions: tuple[float, ...], consecutive: tuple[int, ...], least: tuple[int, ...], first_partition_end_ns: int | None) -> dict[tuple, Check | None]:
    """The stop under every combination of settings, from the running length of each precision's streaks."""
    kept = [c for c in found if first_partition_end_ns is None or c.elapsed_ns < first_partition_end_ns]
    elapsed = np.array([c.elapsed_ns for c in kept], np.int64)
    width = np.array([np.inf if c.warmup_end_ns is None or c.relative_half_width is None else c.relative_half_width for c in kept])
    out = {}
    for p in precisions:
        streak = passing_runs(width < p)
        for n in consecutive:
            for m in least:
                hit = np.flatnonzero((streak >= n) & (elapsed >= m))
                out[p, n, m] = kept[hit[0]] if len(hit) else None
    return out


def _judge(what: str, grid: Grid):
    names = [c.split()[0] for c in {"checks": CHECKS, "baselines": BASELINES, "replays": REPLAYS}[what].split(", ")]
    at = ("would_stop_ns", "elapsed_ns", "sample_index")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("elapsed_ns")
        series = Series(pdf["elapsed_ns"].to_numpy("int64"), pdf["rows_total"].to_numpy("int64"))
        head = pdf.iloc[0]
        run_id, settings = head["run_id"], _settings(head)
        end = None if pd.isna(head["first_partition_end_ns"]) else int(head["first_partition_end_ns"])
        cap, out = capped_at(settings, series), []
        for batch in grid.batch_durations_ns:
            if batch < settings.poll_period_ns:
                continue
            found = grouped_checks(batch, list(grid.window_groups), series) if what != "baselines" else {}
            for groups in grid.window_groups:
                key = (run_id, batch, groups)
                if what == "checks":
                    out += [(*key, i, c.sample_index, c.elapsed_ns, c.warmup_end_ns, c.steady_state_throughput, c.relative_half_width) for i, c in enumerate(found[groups])]
                elif what == "baselines":
                    d = decide(replace(settings, batch_duration_ns=batch, window_groups=groups), series, end)
                    out.append((*key, *((d.steady_state_throughput, d.relative_half_width, d.warmup_end_ns, d.window_end_ns) if d else (None,) * 4), cap))
                else:
                    for combination, c in stop_table(found[groups], grid.precisions, grid.consecutive_checks, grid.min_durations_ns, end).items():
                        would = (c.elapsed_ns, c.steady_state_throughput, c.relative_half_width, c.warmup_end_ns) if c else (None,) * 4
                        out.append((*key, *combination, *would, stop_reason(would[0], cap, end)))
        made = pd.DataFrame(out, columns=names)
        return made.astype({c: "Int64" for c in made.columns if c.endswith("_ns") or c in at})

    return run


def replay(series: DataFrame, what: str, grid: Grid | None = None) -> DataFrame:
    """The `checks`, `baselines` or `replays` of every run in `series` (see shadow_series) under every pair of the grid.

    The rule walks a run's samples in order, so a run is one group; runs spread over tasks. A pair whose batches are
    shorter than the run's polls is left out.
    """
    schema = {"checks": CHECKS, "baselines": BASELINES, "replays": REPLAYS}[what]
    # A given width: judging costs far more than the bytes suggest, so small partitions shall not be merged.
    spread = series.repartition(partitions_for(series.sparkSession), "run_id")
    return spread.groupBy("run_id").applyInPandas(_judge(what, grid or Grid()), schema)


def stops_over_checks(found: DataFrame, settings: DataFrame) -> DataFrame:
    """The stop of each run under each of a list of settings, from its tightness checks, with window functions only.

    `found`: run_id, check_index, elapsed_ns, warmup_end_ns, relative_half_width, first_partition_end_ns. `settings`: a
    list of precision, consecutive_checks, min_duration_ns, refused beyond MOST_SETTINGS. A check ends a streak if no check among the last
    `consecutive_checks` failed: the running greatest index of a failed check says so.
    """
    names = ("precision", "consecutive_checks", "min_duration_ns")
    wanted = settings.select(F.col(names[0]).cast("double"), *(F.col(c).cast("bigint") for c in names[1:])).distinct().limit(MOST_SETTINGS + 1).collect()
    if len(wanted) > MOST_SETTINGS:
        raise ValueError(f"more than {MOST_SETTINGS} settings")
    listed = F.array(*(F.struct(*(F.lit(v).cast(t).alias(n) for n, t, v in zip(names, ("double", "bigint", "bigint"), s))) for s in wanted)) if wanted else F.expr("cast(array() as array<struct<precision: double, consecutive_checks: bigint, min_duration_ns: bigint>>)")
    each = found.select("*", F.explode(listed).alias("s")).select("*", "s.*").drop("s")
    passes = F.col("warmup_end_ns").isNotNull() & (F.col("relative_half_width") < F.col("precision"))
    run = Window.partitionBy("run_id", "precision", "consecutive_checks", "min_duration_ns").orderBy("check_index").rowsBetween(Window.unboundedPreceding, 0)
    failed = F.coalesce(F.max(F.when(~F.coalesce(passes, F.lit(False)), F.col("check_index"))).over(run), F.lit(-1))
    stops = each.withColumn("streak", F.col("check_index") - failed)
    hit = (F.col("streak") >= F.col("consecutive_checks")) & (F.col("elapsed_ns") >= F.col("min_duration_ns")) & (F.col("first_partition_end_ns").isNull() | (F.col("elapsed_ns") < F.col("first_partition_end_ns")))
    return stops.groupBy("run_id", "precision", "consecutive_checks", "min_duration_ns").agg(F.min(F.when(hit, F.col("elapsed_ns"))).alias("would_stop_ns"))


def quotient(part: Column, whole: Column) -> Column:
    """part / whole as floating point has it, in any session: by nothing infinite, and NaN where both are nothing."""
    by_nothing = F.when(F.isnan(part) | (part == 0), F.lit(float("nan"))).when(part > 0, F.lit(float("inf"))).when(part < 0, F.lit(float("-inf")))
    return F.when(whole == 0, by_nothing).otherwise(part / whole)


def calibration(records: DataFrame) -> DataFrame:
    """Error and interval of each shadow run's would-be estimate against its estimate at the end; nulls where it never settled."""
    would, end, width = F.col("would_be_steady_state_throughput"), F.col("steady_state_throughput"), F.col("would_be_relative_half_width")
    runs = records.where("action = 'shadow'").select("run_id", "formulation", "threads", "would_stop_ns", "steady_state_throughput", "relative_half_width", "would_be_steady_state_throughput", "would_be_relative_half_width").distinct()
    settled = F.col("would_stop_ns").isNotNull()
    low, high = quotient(would * (1 - width), end) - 1, quotient(would * (1 + width), end) - 1
    return runs.select(
        "run_id", "formulation", "threads", settled.alias("settled"),
        F.when(settled, quotient(would, end) - 1).alias("error"), F.when(settled, low).alias("low"), F.when(settled, high).alias("high"),
        F.when(settled, (low <= 0) & (high >= 0)).alias("covers"), F.col("relative_half_width").alias("band"),
    )


SETTINGS = ["batch_duration_ns", "window_groups", "precision", "consecutive_checks", "min_duration_ns"]


def overview(replays: DataFrame, baselines: DataFrame) -> DataFrame:
    """Per settings combination: runs, steady stops, median stop, worst error, coverage, and whether it is Pareto-optimal."""
    ends = baselines.select("run_id", "batch_duration_ns", "window_groups", F.col("steady_state_throughput").alias("end"))
    steady = F.col("probe_stop_reason") == "steady"
    would, width = F.col("would_be_steady_state_throughput"), F.col("would_be_relative_half_width")
    rows = replays.join(ends, ["run_id", "batch_duration_ns", "window_groups"])
    combos = rows.groupBy(*SETTINGS).agg(
        F.count("*").alias("runs"),
        F.count_if(steady).alias("steady"),
        F.expr("percentile(CASE WHEN probe_stop_reason = 'steady' THEN would_stop_ns END, 0.5)").alias("median_stop_ns"),
        F.max(F.when(steady, F.abs(quotient(would, F.col("end")) - 1))).alias("worst_error"),
        F.count_if(steady & width.isNotNull() & (would * (1 - width) <= F.col("end")) & (F.col("end") <= would * (1 + width))).alias("covered"),
        F.count_if(steady & width.isNotNull()).alias("intervals"),
    )
    # One row a combination is kept, else the frontier would have every run judged again.
    return pareto(cut(combos), "median_stop_ns", "worst_error")


def pareto(rows: DataFrame, a: str, b: str, name: str = "pareto") -> DataFrame:
    """Mark rows that no other row matches or beats in both `a` and `b` while beating it in one; null in either is never optimal.

    Distinct pairs are sorted by a range exchange; the least `b` of all partitions before one, and a running least value
    inside it, find the frontier. Nothing is compared pairwise and no partition holds everything.
    """
    pairs = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("__a"), F.col(b).alias("__b")).distinct()
    ranged = cut(pairs.repartitionByRange(partitions_for(rows.sparkSession), "__a", "__b").select("__a", "__b", F.spark_partition_id().alias("__part")))
    inside = F.min("__b").over(Window.partitionBy("__part").orderBy("__a", "__b").rowsBetween(Window.unboundedPreceding, -1))
    # One row a partition.
    parts = ranged.groupBy("__part").agg(F.min("__b").alias("__least"))
    ahead = parts.select("__part", F.min("__least").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__ahead"))
    least = ranged.withColumn("__inside", inside).join(F.broadcast(ahead), "__part").withColumn("__before", F.least("__inside", "__ahead"))
    front = least.where(F.col("__before").isNull() | (F.col("__b") < F.col("__before"))).select("__a", "__b", F.lit(True).alias("__front"))
    marked = rows.join(front, (F.col(a) == F.col("__a")) & (F.col(b) == F.col("__b")), "left")
    return marked.select(*rows.columns, F.coalesce("__front", F.lit(False)).alias(name))
