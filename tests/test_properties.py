"""Properties of the pure parts, over generated inputs."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lociweave.functions.locus import Locus, SplitPoints
from lociweave.operators.combine import grouped
from lociweave.operators.grid import _between, impute
from lociweave.operators.intervals import _merge
from lociweave.operators.throughput import ProbeSettings, Series, batch_ends, checks, nearest, warmup_cut

interval = st.tuples(st.integers(0, 2), st.integers(-40, 40), st.integers(0, 12))


@given(st.lists(interval, min_size=1, max_size=40))
@settings(max_examples=150, deadline=None)
def test_merge_covers_the_same_points_with_the_fewest_periods(rows):
    key, first = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    last = first + np.array([r[2] for r in rows])
    row, a, b = _merge([key], first, last)
    cover = {(k, p) for k, x, y in zip(key, first, last) for p in range(x, y + 1)}
    assert cover == {(key[i], p) for i, x, y in zip(row, a, b) for p in range(x, y + 1)}
    runs = sum((k, p - 1) not in cover for k, p in cover)
    assert len(row) == runs


@given(st.integers(1, 40), st.integers(1, 60))
def test_groups_are_even_and_in_order(n, g):
    found = grouped(n, g)
    sizes = [found.count(i) for i in range(max(found) + 1)]
    assert found == sorted(found) and sum(sizes) == n and len(sizes) == min(n, g)
    assert sizes == sorted(sizes, reverse=True) and max(sizes) - min(sizes) <= 1


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 2**31 - 1)), unique=True, max_size=8))
def test_split_points_round_trip(pairs):
    points = SplitPoints(Locus(*p) for p in sorted(pairs))
    if points:
        assert SplitPoints.parse(str(points)) == points
    for p in points:
        assert sum(i.contains(p) for i in points.intervals()) == 1 and Locus.unpack(p.packed) == p


@given(st.lists(st.one_of(st.none(), st.integers(-1000, 1000)), min_size=1, max_size=60))
@settings(max_examples=100, deadline=None)
def test_imputation_keeps_known_values_and_leaves_no_hole(values):
    x = np.array([np.nan if v is None else float(v) for v in values])
    known = ~np.isnan(x)
    y = impute(x)
    if known.any():
        assert not np.isnan(y).any() and np.allclose(y[known], x[known])
        z = _between(y, known)
        at = np.flatnonzero(known)
        for a, b in zip(at, at[1:]):
            assert (z[a : b + 1] >= min(x[a], x[b]) - 1e-9).all() and (z[a : b + 1] <= max(x[a], x[b]) + 1e-9).all()


@given(st.lists(st.tuples(st.integers(1, 10**9), st.integers(0, 5000)), min_size=2, max_size=80))
@settings(max_examples=60, deadline=None)
def test_checks_follow_batches(steps):
    s = Series(np.cumsum([t for t, _ in steps]), np.cumsum([n for _, n in steps]))
    ends = batch_ends(s.elapsed, 10**9)
    gaps = np.diff(s.elapsed[np.concatenate([[0], ends])]) if len(ends) else np.array([])
    assert (gaps >= 10**9).all() and (np.diff(ends) > 0).all()
    found = checks(ProbeSettings(), s)
    assert [c.sample_index for c in found] == ends.tolist()
    for k, c in enumerate(found):
        assert (c.warmup_end_ns is None) == (warmup_cut(s.rates(np.concatenate([[0], ends[: k + 1]]))) is None)


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=30, unique=True), st.integers(-50, 1050))
def test_nearest(times, target):
    t = np.array(sorted(times))
    found = t[nearest(t, np.array([target]))[0]]
    assert abs(found - target) == min(abs(t - target)) and found == min(x for x in t if abs(x - target) == abs(found - target))
