import random

import pytest

from lociweave.llm.mixing import apportion, made_up, mixed, pfair

TARGETS = "source string, target_share double, max_repeats int"


def test_made_up_takes_the_largest_that_fits():
    assert made_up(10, [(7, 1), (4, 2), (2, 3), (2, 4), (1, 5)]) == [1, 3, 5]
    assert made_up(3, [(4, 1)]) == [] and made_up(5, []) == []


def test_apportion():
    assert apportion([0.5, 0.25, 0.25], 8) == [4, 2, 2]
    assert sum(apportion([0.333, 0.333, 0.334], 1000)) == 1000


@pytest.mark.parametrize("quota", [[50, 30, 20], [97, 1, 1, 1], [34, 33, 33], [10] * 10, [60, 25, 10, 5]])
def test_pfair_keeps_every_source_within_a_block(quota):
    slots = sum(quota)
    order = pfair(quota, slots)
    assert sorted((s, b) for s, b, _ in order) == [(s, b) for s, q in enumerate(quota) for b in range(q)]
    assert [t for *_, t in order] == list(range(slots))
    done = [0] * len(quota)
    for s, _, t in order:
        done[s] += 1
        for i, q in enumerate(quota):
            assert abs(done[i] - q / slots * (t + 1)) < 1


def test_shares_repeats_and_prefixes(spark):
    r = random.Random(4)
    data = [(i, "big" if i < 3000 else "mid" if i < 3600 else "small", r.randrange(1, 60)) for i in range(3700)]
    df = spark.createDataFrame([(*x, "q") for x in data], "doc bigint, source string, n bigint, slot string").repartition(5)
    df = df.unionByName(spark.createDataFrame([(9000, None, 5, "q"), (9001, "other", 5, "q"), (9002, "big", 0, "q"), (9003, "big", None, "q")], df.schema))
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 3), ("void", 0.05, 4)], TARGETS)
    mix = mixed(df, ["doc"], "source", "n", targets, slots=100)
    rows = mix.rows.collect()
    shares = {x.source: x for x in mix.shares.collect()}
    assert set(shares) == {"big", "mid", "small", "void"} and shares["void"].mixed_tokens == 0
    total = sum(x.n_tokens for x in rows)
    for s, w in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert shares[s].mixed_tokens == sum(x.n_tokens for x in rows if x.source == s)
        assert shares[s].actual_share == pytest.approx(w / 0.95, abs=0.003)
        assert shares[s].missing_tokens == shares[s].quota_tokens - shares[s].mixed_tokens and 0 <= shares[s].missing_tokens < 60
    most = {"big": 1, "mid": 2, "small": 3}
    count = {}
    for x in rows:
        count[x.doc] = count.get(x.doc, 0) + 1
        assert x.repeat_no < most[x.source]
    assert len({(x.doc, x.repeat_no) for x in rows}) == len(rows)
    assert all(count[x.doc] <= most[x.source] for x in rows) and max(count.values()) == 3
    done, seen = dict.fromkeys(most, 0), 0
    for x in sorted(rows, key=lambda x: (x.slot, x.source, x.place)):
        done[x.source] += x.n_tokens
        seen += x.n_tokens
        for s in most:
            assert abs(done[s] - shares[s].actual_share * seen) < 2 * total / 100 + 60


@pytest.mark.parametrize("n", [1000, 10_000])
def test_the_cycle_repeats_and_blocks_do_not_grow(spark, n):
    r = random.Random(6)
    df = spark.createDataFrame([(i, r.choice("aaabbc"), r.randrange(1000, 3000)) for i in range(n)], "doc bigint, source string, n bigint")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3)], TARGETS)
    mix = mixed(df, ["doc"], "source", "n", targets)
    rows, shares = mix.rows.collect(), {x.source: x.actual_share for x in mix.shares.collect()}
    total = sum(x.n_tokens for x in rows)
    assert len({(x.doc, x.repeat_no) for x in rows}) == len(rows)
    assert -(-total // 10**6) * 1000 - 20 < max(x.slot for x in rows) + 1 <= -(-(total + 10_000) // 10**6) * 1000
    # A slot has as many tokens at ten times the data.
    assert 700 < total / (max(x.slot for x in rows) + 1) <= 1000 + 10
    done, seen = dict.fromkeys(shares, 0), 0
    for x in sorted(rows, key=lambda x: (x.slot, x.source, x.place)):
        done[x.source] += x.n_tokens
        seen += x.n_tokens
        for s in shares:
            assert abs(done[s] - shares[s] * seen) < 2 * 1000 + 2 * 3000


def test_total_and_short_sources(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", 10) for i in range(100)], "doc bigint, source string, n bigint")
    targets = spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 1), ("a", 0.2, 1), ("c", None, 1)], TARGETS)
    got = {x.source: x.mixed_tokens for x in mixed(df, ["doc"], "source", "n", targets, total_tokens=1000, slots=10).shares.collect()}
    assert got == {"a": 500, "b": 100, "c": 0}


def test_empty(spark):
    empty = spark.createDataFrame([], "doc bigint, source string, n bigint")
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    mix = mixed(empty, ["doc"], "source", "n", targets)
    assert mix.rows.count() == 0 and [x.mixed_tokens for x in mix.shares.collect()] == [0]
    assert mixed(empty, ["doc"], "source", "n", targets.where("false")).rows.count() == 0
