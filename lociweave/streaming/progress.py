"""Progress samples as a stream: each run judged as its samples arrive, and rows a second by event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.throughput import ProbeSettings, Series, batch_ends, decide

JUDGED = "run_id string, stop_reason string, stopped_at_ns bigint, steady_state_throughput double, warmup_end_ns bigint, samples bigint"
STATE = "elapsed array<bigint>, rows_total array<bigint>, over boolean"


def judged(samples: DataFrame, settings: ProbeSettings | None = None) -> DataFrame:
    """The decision to stop each run, once, as soon as the samples of a streaming frame call for it.

    `samples`: run_id, elapsed_ns, rows_total. The state of a run holds its samples up to the decision, no more than a
    probe of the maximum duration takes; late or repeated samples that don't move time forward are dropped.
    """
    settings = settings or ProbeSettings()

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        elapsed, rows, over = state.get if state.exists else ([], [], False)
        elapsed, rows = list(elapsed), list(rows)
        new = pd.concat(list(batches)).sort_values(["elapsed_ns", "rows_total"])
        ends = batch_ends(np.array(elapsed, np.int64), settings.batch_duration_ns)
        begun = elapsed[int(ends[-1])] if len(ends) else elapsed[0] if elapsed else None
        for t, n in zip(new["elapsed_ns"].tolist(), new["rows_total"].tolist()):
            if over or (elapsed and t <= elapsed[-1]):
                continue
            elapsed.append(int(t))
            rows.append(int(n))
            begun = elapsed[0] if begun is None else begun
            # A run is steady at the end of a batch past the least duration, or capped; other samples decide nothing.
            ends_batch = t - begun >= max(1, settings.batch_duration_ns) and len(elapsed) > 1
            begun = elapsed[-1] if ends_batch else begun
            if not (ends_batch and t >= settings.min_duration_ns) and t < settings.max_duration_ns:
                continue
            found = decide(settings, Series(np.array(elapsed), np.array(rows)))
            if found:
                over = True
                yield pd.DataFrame([(key[0], found.stop_reason, int(t), found.steady_state_throughput, found.warmup_end_ns, len(elapsed))], columns=[c.split()[0] for c in JUDGED.split(", ")]).astype({"warmup_end_ns": "Int64"})
        state.update(([], [], True) if over else (elapsed, rows, False))

    return samples.groupBy("run_id").applyInPandasWithState(judge, JUDGED, STATE, "append", GroupStateTimeout.NoTimeout)


def event_rates(events: DataFrame, at: str = "ts", width: str = "1 minute", late: str = "10 minutes", key: str | None = None) -> DataFrame:
    """Events in windows of event time, per key; a stream may run late by `late`."""
    by = [F.window(F.col(at), width), *([F.col(key)] if key else [])]
    return events.withWatermark(at, late).groupBy(*by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *([key] if key else []), "n")
