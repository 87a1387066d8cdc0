import random

import numpy as np
import pytest

from lociweave.operators.grid import impute, regular_grid

S = 10**9


def test_periods_and_marks(spark):
    rows = [("a", 5, 1.0), ("a", 3 * S, 7.0), ("a", 3 * S + 9, 9.0), ("a", 3 * S + 9, 9.0), ("b", 2 * S, None), ("c", -5, 1.0), ("d", None, 1.0), (None, 0, 4.0)]
    df = spark.createDataFrame(rows, "r string, t bigint, v double")
    got = {(x.r, x.period_index): x for x in regular_grid(df, ["r"], "t", "v", S).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0), ("b", 1), ("b", 2), (None, 0)}
    assert [k for k in got if got[k].filled and k[0] == "a"] and {k for k in got if got[k].filled} == {("a", 1), ("a", 2), ("b", 0), ("b", 1)}
    assert got["a", 3].value == 9.0 and got["a", 3].readings == 3
    assert 1.0 <= got["a", 1].value <= got["a", 2].value <= 9.0
    assert got["b", 2].value is None and not got["b", 2].filled


@pytest.mark.parametrize("block,halo", [(8, 3), (16, 8), (512, 64)])
def test_blocks_give_every_period_once(spark, block, halo):
    r = random.Random(block)
    seen = sorted({r.randrange(150) for _ in range(60)} | set(range(100, 110)) | {200})
    df = spark.createDataFrame([("x", p * S + r.randrange(S), float(p * 10)) for p in seen], "r string, t bigint, v double").repartition(3)
    got = sorted((x.period_index, x.filled, x.value) for x in regular_grid(df, ["r"], "t", "v", S, block=block, halo=halo).collect())
    assert [p for p, *_ in got] == list(range(201))
    assert {p for p, f, _ in got if not f} == set(seen)
    # A line is filled as a line, also across blocks without any reading.
    assert max(abs(v - p * 10) for p, _, v in got if p >= seen[0]) < 40


def test_empty(spark):
    assert regular_grid(spark.createDataFrame([], "r string, t bigint, v double"), ["r"], "t", "v", S).count() == 0


def test_imputation_beats_a_line_on_held_out_values():
    t = np.arange(160)
    truth = 3 * t + 40 * np.sin(t / 5)
    r = np.random.default_rng(1)
    hidden = np.zeros(160, bool)
    for start in r.choice(np.arange(8, 148), 9, replace=False):
        hidden[start : start + 5] = True
    x = np.where(hidden, np.nan, truth)
    line = np.interp(t, t[~hidden], truth[~hidden])
    error = lambda y: float(np.sqrt(((y - truth)[hidden] ** 2).mean()))
    assert error(impute(x, rank=4)) < 0.5 * error(line)


def test_impute_keeps_what_it_cannot_fill():
    assert np.isnan(impute(np.full(5, np.nan))).all()
    assert impute(np.array([1.0, np.nan, 3.0])).tolist() == [1, 2, 3]
    assert impute(np.array([5.0] * 5 + [np.nan] * 2 + [5.0] * 5)).tolist() == [5.0] * 12


@pytest.mark.parametrize("seed", range(4))
def test_imputation_ends_by_itself(seed):
    r = np.random.default_rng(seed)
    for n in (2, 3, 5, 9, 40, 300):
        x = np.cumsum(r.exponential(100, n))
        x[r.random(n) < 0.6] = np.nan
        if not np.isnan(x).all():
            known = ~np.isnan(x)
            got = impute(x)
            assert not np.isnan(got).any() and (got[known] == x[known]).all()


def test_a_far_reading_is_refused_by_name_and_costs_no_other_source(spark):
    df = spark.createDataFrame([("far", 1, 1.0), ("far", 2**62, 2.0), ("near", 0, 1.0), ("near", 3, 7.0)], "r string, t bigint, v double")
    got = sorted((x.r, x.period_index is None, x.period_index or 0, x.readings) for x in regular_grid(df, ["r"], "t", "v", 1).collect())
    assert got == [("far", True, 0, 2), ("near", False, 0, 1), ("near", False, 1, 0), ("near", False, 2, 0), ("near", False, 3, 1)]
    long = spark.createDataFrame([("x", 0, 0.0), ("x", 2_000_000, 4e6)], "r string, t bigint, v double")
    found = regular_grid(long, ["r"], "t", "v", 1)
    assert found.count() == 2_000_001 and found.where("abs(value - 2 * period_index) > 1").count() == 0


def test_blocks_without_readings_follow_the_coarser_series(spark):
    # A reading in each block but for a gap, on a slow wave that a line across the gap misses.
    wave = lambda p: 1e5 + 1000 * np.sin(p / 900)
    seen = [p for p in range(0, 60_000, 64) if not 23_500 < p < 24_600]
    df = spark.createDataFrame([("x", p, float(wave(p))) for p in seen], "r string, t bigint, v double")
    got = {x.period_index: x.value for x in regular_grid(df, ["r"], "t", "v", 1, counter=False, block=64, halo=8, coarse=64, rank=3).collect()}
    hidden = np.arange(23_560, 24_570)
    line = np.interp(hidden, seen, [wave(p) for p in seen])
    error = lambda y: float(np.sqrt(((np.asarray(y) - wave(hidden)) ** 2).mean()))
    assert error([got[p] for p in hidden]) < 0.7 * error(line)
