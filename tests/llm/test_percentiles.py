import random

import numpy as np
import pytest

from lociweave.llm.percentiles import combine, percentiles, summarize

POINTS = [0, 0.01, 0.25, 0.5, 0.9, 0.99, 1]


def test_against_numpy(spark):
    r = random.Random(1)
    data = [("hot", r.choice([1.0, 2.0, r.random() * 100])) for _ in range(3000)] + [("b", float(i)) for i in range(11)] + [("one", 4.0), (None, 2.0), (None, 3.0), ("none", None), ("b", None), ("b", float("nan"))]
    df = spark.createDataFrame(data, "g string, v double").repartition(6)
    got = {x.g: (x.n, x["values"]) for x in percentiles(summarize(df, ["g"], "v"), ["g"], POINTS, partitions=5).collect()}
    groups = {}
    for g, v in data:
        if v is not None and v == v:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert got[g][0] == len(v)
        assert got[g][1] == pytest.approx(np.quantile(v, POINTS).tolist(), rel=1e-12)


def test_parts_combine_to_the_whole(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "id * 7 % 101 AS v", "id AS value_")
    whole = percentiles(summarize(df, ["g"], "v"), ["g"], POINTS)
    days = [summarize(df.where(f"value_ % 4 = {k}"), ["g"], "v") for k in range(4)]
    parts = percentiles(combine(days, ["g"]), ["g"], POINTS)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_large_whole_numbers_stay_exact(spark):
    data = [2**53 + 1, 2**53, 2**53 + 2, 2**62 + 1, 2**62]
    df = spark.createDataFrame([("a", x) for x in data] + [("b", None), ("a", None)], "g string, v bigint")
    part = summarize(df, ["g"], "v")
    assert sorted(x.value for x in part.collect()) == sorted(data)
    got = percentiles(part, ["g"], [0, 0.5, 0.75, 0.8, 1]).collect()[0]
    assert got.low == [2**53, 2**53 + 2, 2**62, 2**62, 2**62 + 1] and got.high == [2**53, 2**53 + 2, 2**62, 2**62 + 1, 2**62 + 1]
    with pytest.raises(ValueError):
        combine([part, summarize(df.selectExpr("g", "v / 2 AS v"), ["g"], "v")], ["g"])


def test_empty_and_bad_points(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert percentiles(summarize(df, ["g"], "v"), ["g"], [0.5]).count() == 0
    with pytest.raises(ValueError):
        percentiles(summarize(df, ["g"], "v"), ["g"], [1.5])
