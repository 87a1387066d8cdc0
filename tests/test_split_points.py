import random

import pytest

from lociweave.operators.running import numbered, running_total
from lociweave.operators.split_points import UnbalancedError, heavy_keys, keyed_split_points, row_balanced


def brute(rows, requests):
    out = set()
    for i, key, j in set(requests):
        if None in (i, key, j) or j < 2:
            continue
        pos = sorted(p for k, p in rows if k == key and p is not None)
        if not pos:
            continue
        got = [pos[k * len(pos) // j] for k in range(1, j)]
        if all(a < b for a, b in zip(got, got[1:])):
            out |= {(i, k + 1, key, p) for k, p in enumerate(got)}
    return out


@pytest.mark.parametrize("share", [0.05, 0.9])
def test_keyed_against_brute_force(spark, share):
    r = random.Random(3)
    data = [(1, r.randrange(4000)) for _ in range(3000)] + [(1, 77)] * 200 + [(k, r.randrange(500)) for k in range(2, 9) for _ in range(40)] + [(None, 5), (3, None)]
    requests = [(1, 1, 4), (2, 1, 50), (3, 2, 3), (4, 3, 100), (5, 99, 4), (6, 2, 1), (7, None, 2), (8, 4, None), (9, 5, 7), (9, 5, 7), (10, 1, 2)]
    df = spark.createDataFrame(data, "key int, pos int").repartition(6)
    got = keyed_split_points(df, "key", "pos", spark.createDataFrame(requests, "id bigint, key int, n int"), "id", "n", heavy_share=share, tile_bits=6)
    assert {tuple(x) for x in got.collect()} == brute(data, requests)


def test_heavy_keys_include_every_frequent_one(spark):
    df = spark.createDataFrame([(1,)] * 500 + [(k,) for k in range(2, 300)], "k int")
    assert 1 in heavy_keys(df, "k", 0.1)


def test_empty(spark):
    df = spark.createDataFrame([], "key int, pos int")
    assert keyed_split_points(df, "key", "pos", spark.createDataFrame([(1, 1, 4)], "id bigint, key int, n int"), "id", "n").count() == 0


@pytest.mark.parametrize("n,j,expected", [(10, 4, [3, 6, 8]), (5, 2, [3]), (9, 3, [4, 7])])
def test_row_balanced_goldens(spark, n, j, expected):
    df = spark.createDataFrame([(1, p) for p in range(1, n + 1)], "o int, p int").repartition(3)
    assert [x.p for x in row_balanced(df, ["o", "p"], j).orderBy("k").collect()] == expected


def test_row_balanced_refuses(spark):
    df = spark.createDataFrame([(1, 5)] * 4, "o int, p int")
    with pytest.raises(UnbalancedError, match="cannot be balanced into 3 intervals"):
        row_balanced(df, ["o", "p"], 3)
    with pytest.raises(UnbalancedError, match="no rows"):
        row_balanced(df.where("false"), ["o", "p"], 2)
    with pytest.raises(UnbalancedError):
        row_balanced(df, ["o", "p"], 1)


def test_running_total_and_numbers(spark):
    r = random.Random(5)
    data = [(r.choice(["a", "a", "a", "b", None]), i, r.choice([None, 1, 2, 7])) for i in range(500)]
    df = spark.createDataFrame(data, "g string, i int, w int").repartition(7)
    got = {x.i: (x.upto, x.whole) for x in running_total(df, ["g"], ["i"], "w", name="upto", total="whole", partitions=6).collect()}
    seen, whole = {}, {}
    for g, _, w in data:
        whole[g] = whole.get(g, 0) + (w or 0)
    for g, i, w in data:
        seen[g] = seen.get(g, 0) + (w or 0)
        assert got[i] == (seen[g], whole[g])
    numbers = numbered(df, [], ["i"], partitions=5)
    assert all(x.row_number == x.i + 1 for x in numbers.collect())
