import math

import numpy as np
import pandas as pd
import pytest

from lociweave.operators.replay import Grid, calibration, overview, pareto, replay, shadow_series, stops_over_checks
from lociweave.operators.throughput import SECOND, ProbeSettings, Series, batch_ends, capped_at, checks, decide, nearest, normalized, passing_runs, stop, stop_reason, t_975, warmup_cut, would_stop
from lociweave.queries.reference import tightness_checks

ONE = ProbeSettings(consecutive_checks=1, min_duration_ns=0)


def series(rates, poll_ms=100):
    """Samples every poll of a run with the given rate in each second."""
    per = 1000 // poll_ms
    elapsed = np.arange(len(rates) * per + 1, dtype=np.int64) * poll_ms * 10**6
    rows = np.concatenate([[0], np.cumsum(np.repeat(np.array(rates) / per, per))]).round().astype(np.int64)
    return Series(elapsed, rows)


def until(s, seconds):
    return s.upto(int(np.searchsorted(s.elapsed, seconds * SECOND, side="right")))


def first_decision(settings, s):
    for n in range(1, len(s) + 1):
        if d := decide(settings, s.upto(n)):
            return d
    return None


def test_ramp_then_steady():
    d = decide(ONE, series([100, 200, 300, 400] + [1000] * 16))
    assert (d.stop_reason, d.steady_state_throughput, d.warmup_end_ns, d.window_end_ns, d.window_rows, d.relative_half_width) == ("steady", 1000.0, 4 * SECOND, 20 * SECOND, 16000, 0.0)


def test_too_soon_to_tell():
    assert decide(ONE, series([100 * i for i in range(1, 13)] + [1300] * 8)) is None


def test_alternating_rates():
    s = series([500, 1500] * 10)
    assert decide(ONE, until(s, 10)) is None
    d = decide(ONE, s)
    assert (d.stop_reason, d.steady_state_throughput, d.warmup_end_ns, d.window_rows, d.relative_half_width) == ("steady", 1000.0, 0, 20000, 0.0)


def test_consecutive_checks():
    s, settings = series([100 * i for i in range(1, 13)] + [1300] * 14), ProbeSettings(consecutive_checks=3, min_duration_ns=0)
    assert decide(settings, until(s, 24)) is None and decide(settings, until(s, 25)) is None
    d = decide(settings, s)
    assert (d.stop_reason, d.steady_state_throughput, d.warmup_end_ns, d.window_rows) == ("steady", 1300.0, 12 * SECOND, 18200)


def test_minimum_duration_and_batch_ends():
    s, settings = series([1000] * 20), ProbeSettings(consecutive_checks=1, min_duration_ns=int(19.5 * SECOND))
    assert decide(settings, until(s, 19.5)) is None and decide(settings, s).stop_reason == "steady"


def test_capped():
    d = decide(ProbeSettings(max_duration_ns=20 * SECOND), series([100 * i for i in range(1, 21)]))
    assert (d.stop_reason, d.steady_state_throughput, d.warmup_end_ns, d.window_rows) == ("capped", 1050.0, None, 21000)
    assert d.relative_half_width == pytest.approx(0.4125507815555025, rel=1e-12)


def test_completed_window_closes_at_the_first_partition_end():
    d = decide(ONE, series([1000] * 10), 6 * SECOND)
    assert (d.stop_reason, d.window_end_ns, d.steady_state_throughput) == ("completed", 6 * SECOND, 1000.0)
    assert would_stop(ONE, series([1000] * 10), 6 * SECOND) is None and would_stop(ONE, series([1000] * 10)).stop_reason == "steady"
    assert decide(ONE, Series.of([])) is None


def test_small_parts():
    assert batch_ends(np.array([0, 0, 5, 9, 10, 30]), 10).tolist() == [4, 5]
    assert batch_ends(np.array([], np.int64), 10).tolist() == []
    assert warmup_cut(np.full(4, 1.0)) is None and warmup_cut(np.full(9, 1.0)) == 0
    assert nearest(np.array([0, 10, 20]), np.array([0, 5, 6, 15, 99])).tolist() == [0, 0, 1, 1, 2]
    assert t_975(1) == 12.7062 and t_975(30) == 2.0423 and t_975(1000) == pytest.approx(1.96234, abs=1e-4)
    assert normalized(1000.0, 50, 2) == pytest.approx(1956.0115027)
    assert capped_at(ProbeSettings(max_duration_ns=2 * SECOND), series([1, 1, 1])) == 2 * SECOND
    assert [stop_reason(*x) for x in ((5, None, 9), (5, 5, 5), (6, 5, 9), (None, 5, 5), (None, 5, None), (None, None, 5))] == ["steady", "steady", "capped", "completed", "capped", "completed"]


@pytest.mark.parametrize("seed", range(6))
def test_parts_of_the_rule_against_plain_loops(seed):
    r = np.random.default_rng(seed)
    rates = r.choice([r.normal(50, 9, 40), np.repeat(7.0, 40), np.arange(40.0)])[: r.integers(0, 41)]
    errors = [((rates[i:] - rates[i:].mean()) ** 2).sum() / (len(rates) - i) ** 2 for i in range(len(rates) - 4)]
    want = int(np.argmin(errors)) if errors else None
    assert warmup_cut(rates) == (want if want is not None and want <= len(rates) / 2 else None)
    elapsed, ends, at = np.cumsum(r.integers(-3, 9, 60)), [], 0
    for i in range(1, 60):
        if elapsed[i] - elapsed[at] >= 10:
            at = i
            ends.append(i)
    assert batch_ends(elapsed, 10).tolist() == ends
    passes, n = r.random(30) < 0.7, 0
    assert passing_runs(passes).tolist() == [n := n + 1 if p else 0 for p in passes]


@pytest.mark.parametrize("seed", range(4))
def test_stop_over_all_checks_is_the_first_decision(seed):
    r = np.random.default_rng(seed)
    s = series((1000 * (1 - np.exp(-np.arange(26) / 3)) + r.normal(0, 15, 26)).clip(1))
    for precision, consecutive in ((0.02, 1), (0.02, 3), (0.05, 2)):
        settings = ProbeSettings(precision=precision, consecutive_checks=consecutive, min_duration_ns=8 * SECOND)
        found, first = stop(settings, checks(settings, s)), first_decision(settings, s)
        assert (found and found.elapsed_ns) == (first and first.window_end_ns)
        if found:
            assert found.steady_state_throughput == first.steady_state_throughput


def frames(spark):
    runs, samples = [], []
    for run, rates in (("a", [1000] * 25), ("b", [100 * i for i in range(1, 26)]), ("p", [5] * 3)):
        runs.append((run, "shadow" if run != "p" else "probe", None, 100_000_000, 10**9, 0.02, 3, 10, 20 * SECOND, 300 * SECOND, 25 * SECOND))
        s = series(rates)
        samples += [(run, int(t), int(n)) for t, n in zip(s.elapsed, s.rows)]
    records = spark.createDataFrame(runs + runs[:1], "run_id string, action string, started_at timestamp, poll_period_ns bigint, batch_duration_ns bigint, precision double, consecutive_checks bigint, window_groups bigint, min_duration_ns bigint, max_duration_ns bigint, first_partition_end_ns bigint")
    return records, spark.createDataFrame(samples + samples[:7], "run_id string, elapsed_ns bigint, rows bigint")


def test_replay_tables(spark):
    records, progress = frames(spark)
    shadow = shadow_series(records, progress)
    stops = replay(shadow, "replays").toPandas()
    assert len(stops) == 2 * 576 and set(stops.run_id) == {"a", "b"}
    a = stops[(stops.run_id == "a") & (stops.batch_duration_ns == SECOND) & (stops.window_groups == 10) & (stops.precision == 0.02) & (stops.consecutive_checks == 3)]
    assert dict(zip(a.min_duration_ns, a.would_stop_ns.fillna(-1))) == {10 * SECOND: 10 * SECOND, 20 * SECOND: 20 * SECOND, 60 * SECOND: -1}
    assert set(stops[stops.run_id == "b"].probe_stop_reason) == {"completed"}
    base = replay(shadow, "baselines").toPandas()
    assert len(base) == 32 and set(base.window_end_ns) == {25 * SECOND} and base.capped_at_ns.isna().all()
    short = replay(shadow, "checks", Grid(batch_durations_ns=(10**7, SECOND), window_groups=(10,))).toPandas()
    assert len(short) == 50 and set(short.batch_duration_ns) == {SECOND}
    view = overview(replay(shadow, "replays"), replay(shadow, "baselines")).toPandas()
    assert len(view) == 576 and (view.runs == 2).all() and view[view.steady > 0].worst_error.max() == 0 and view.pareto.sum() >= 1


def test_stops_over_checks_match_the_rule(spark):
    r = np.random.default_rng(5)
    rows, want = [], {}
    for run in ("x", "y", "z"):
        s = series((1000 + r.normal(0, 40, 26)).clip(1))
        found = checks(ProbeSettings(), s)
        rows += [(run, i, c.elapsed_ns, c.warmup_end_ns, c.relative_half_width, 24 * SECOND) for i, c in enumerate(found)]
        for p, n, m in ((0.02, 1, 0), (0.03, 3, 10 * SECOND), (0.001, 1, 0)):
            c = stop(ProbeSettings(precision=p, consecutive_checks=n, min_duration_ns=m), found, 24 * SECOND)
            want[run, p, n, m] = c and c.elapsed_ns
    frame = spark.createDataFrame(rows, "run_id string, check_index bigint, elapsed_ns bigint, warmup_end_ns bigint, relative_half_width double, first_partition_end_ns bigint")
    settings = spark.createDataFrame([(0.02, 1, 0), (0.03, 3, 10 * SECOND), (0.001, 1, 0)], "precision double, consecutive_checks bigint, min_duration_ns bigint")
    assert {tuple(x)[:4]: x.would_stop_ns for x in stops_over_checks(frame, settings).collect()} == want


def test_calibration(spark):
    schema = "run_id string, action string, formulation string, threads bigint, would_stop_ns bigint, steady_state_throughput double, relative_half_width double, would_be_steady_state_throughput double, would_be_relative_half_width double"
    rows = [("a", "shadow", "union", 4, 9, 100.0, 0.1, 110.0, 0.2), ("b", "shadow", "union", 4, 9, 100.0, 0.1, 110.0, 0.01), ("c", "shadow", "union", 4, None, 100.0, 0.1, None, None), ("d", None, "union", 4, None, None, None, None, None)]
    got = {x.run_id: x for x in calibration(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].error == pytest.approx(0.1) and got["a"].covers and not got["b"].covers and got["c"].error is None and not got["c"].settled


def test_a_rate_of_nothing_at_the_end_is_an_infinite_error(spark):
    """Runs that stand still at their end; the session fails on a division by zero."""
    setting = (SECOND, 10, 0.02, 3, 10 * SECOND)
    stops = [(run, *setting, "steady", SECOND * 20, would, 0.1) for run, would in (("moved", 10.0), ("good", 10.0))]
    stops += [("idle", SECOND, 10, 0.05, 3, 10 * SECOND, "steady", SECOND * 20, 0.0, None), ("good", SECOND, 10, 0.05, 5, 10 * SECOND, "steady", SECOND * 30, 11.0, 0.1)]
    columns = "run_id string, batch_duration_ns bigint, window_groups bigint"
    replays = spark.createDataFrame(stops, f"{columns}, precision double, consecutive_checks bigint, min_duration_ns bigint, probe_stop_reason string, would_stop_ns bigint, would_be_steady_state_throughput double, would_be_relative_half_width double")
    ends = spark.createDataFrame([(r, SECOND, 10, e) for r, e in (("moved", 0.0), ("good", 10.0), ("idle", 0.0))], f"{columns}, steady_state_throughput double")
    got = {(x.precision, x.consecutive_checks): (x.runs, x.worst_error, x.covered, x.pareto) for x in overview(replays, ends).collect()}
    assert got[0.02, 3] == (2, math.inf, 1, True)
    assert got[0.05, 3][0] == 1 and math.isnan(got[0.05, 3][1]) and got[0.05, 3][2:] == (0, False)
    assert got[0.05, 5] == (1, pytest.approx(0.1), 1, True)


def test_pareto(spark):
    rows = [(1.0, 9.0), (2.0, 5.0), (2.0, 5.0), (2.0, 6.0), (3.0, 5.0), (4.0, 1.0), (None, 0.0), (0.5, None)]
    got = pareto(spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, a double, b double"), "a", "b").toPandas().set_index("i").pareto
    assert got.sort_index().tolist() == [True, True, True, False, False, True, False, False]
    assert isinstance(got, pd.Series)


def test_query_has_the_checks_of_every_pair(spark, tmp_path):
    record = "run_id string, action string, started_at bigint, " + ", ".join(f"{c} {'double' if c == 'precision' else 'bigint'}" for c in ("poll_period_ns", "batch_duration_ns", "precision", "consecutive_checks", "window_groups", "min_duration_ns", "max_duration_ns", "first_partition_end_ns"))
    runs = [("fast", SECOND // 10), ("slow", 2 * SECOND)]
    spark.createDataFrame([(r, "shadow", 1, poll, *[None] * 7) for r, poll in runs], record).write.parquet(str(tmp_path / "run_records.parquet"))
    samples = [(r, i, i * poll, i * poll // 10**6) for r, poll in runs for i in range(300 * SECOND // poll)]
    spark.createDataFrame(samples, "run_id string, sample_index bigint, elapsed_ns bigint, rows bigint").write.parquet(str(tmp_path / "progress_samples.parquet"))
    got = {(x.run_id, x.batch_duration_ns / SECOND, x.window_groups) for x in tightness_checks(spark, str(tmp_path)).collect()}
    assert got == {(r, b, g) for r, least in (("fast", 0.5), ("slow", 2)) for b in (0.5, 1, 2, 5) if b >= least for g in (5, 10, 20, 40)}
