import random

import pytest

from lociweave.operators.intervals import periods_and_gaps


def brute(rows):
    cover = {}
    for e, a, b in rows:
        if a is not None and b is not None and b >= a:
            cover.setdefault(e, set()).update(range(a, b + 1))
    out = []
    for e, points in cover.items():
        runs = []
        for p in sorted(points):
            if runs and p == runs[-1][1] + 1:
                runs[-1][1] = p
            else:
                runs.append([p, p])
        out += [(e, "period", a, b) for a, b in runs]
        out += [(e, "gap", x[1] + 1, y[0] - 1) for x, y in zip(runs, runs[1:])]
    return set(out)


@pytest.mark.parametrize("bits,buffer", [(2, 7), (4, 50), (16, 400_000)])
def test_against_brute_force(spark, bits, buffer):
    r = random.Random(bits)
    data = []
    for _ in range(600):
        a = r.randrange(-300, 300)
        data.append((r.choice(["x", "x", "x", "y", None]), a, a + r.choice([-1, 0, 1, 5, 40])))
    data += data[:50] + [("x", None, 5), ("x", 5, None)]
    df = spark.createDataFrame(data, "e string, a int, b int").repartition(5)
    got = [tuple(x) for x in periods_and_gaps(df, ["e"], "a", "b", shard_bits=bits, buffer_rows=buffer).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(data)


def test_touching_across_shards_and_long(spark):
    df = spark.createDataFrame([("x", 0, 3), ("x", 4, 7), ("x", 8, 40), ("x", 60, 61)], "e string, a bigint, b bigint")
    got = {tuple(x) for x in periods_and_gaps(df, ["e"], "a", "b", shard_bits=2).collect()}
    assert got == {("x", "period", 0, 40), ("x", "gap", 41, 59), ("x", "period", 60, 61)}


def test_empty_and_clashing_names(spark):
    empty = spark.createDataFrame([], "e string, a int, b int")
    assert periods_and_gaps(empty, ["e"], "a", "b").count() == 0
    df = spark.createDataFrame([("x", 1, 2, 9, "q")], "k0 string, a int, b int, shard int, opens string")
    assert [tuple(x) for x in periods_and_gaps(df, ["k0"], "a", "b").collect()] == [("x", "period", 1, 2)]


def test_two_entity_columns(spark):
    df = spark.createDataFrame([("x", 1, 1, 2), ("x", 2, 3, 4), ("x", 1, 3, 3), ("y", None, 3, 3)], "e string, o int, a int, b int")
    got = {tuple(x) for x in periods_and_gaps(df, ["e", "o"], "a", "b").collect()}
    assert got == {("x", 1, "period", 1, 3), ("x", 2, "period", 3, 4), ("y", None, "period", 3, 3)}
