import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from lociweave.operators.compaction import VerificationError, _fingerprint, compact, consolidated, data_files, laid_out, listed, packing_plan, table_report

T0 = dt.datetime(2026, 1, 1)
LISTING = "d string, t string, path string, n_bytes bigint, listed_at timestamp"


def test_latest_listing_and_data_files(spark):
    rows = [("d", "t", "d/t/a.parquet", 5, T0), ("d", "t", "d/t/a.parquet", 9, T0 + dt.timedelta(1)), ("d", "t", "d/t/a.parquet", 9, T0 + dt.timedelta(1)), ("d", "t", "d/t/b.parquet", None, T0), ("d", "t", "d/t.samples.parquet", 7, T0), ("d", "t", "d/t/.tmp/c.parquet", 7, T0), ("d", "t", "d/t/.c.parquet", 7, T0), ("d", "t", None, 7, T0), ("d", "t", "d/t/x.parquet", 3, None)]
    got = {tuple(x) for x in data_files(spark.createDataFrame(rows, LISTING), ["d", "t"]).collect()}
    assert got == {("d", "t", "d/t/a.parquet", 9), ("d", "t", "d/t/b.parquet", 0), ("d", "t", "d/t/x.parquet", 3)}


def test_report(spark):
    files = spark.createDataFrame([("d", t, f"{t}{i}", n) for t, n, c in (("few", 1, 7), ("small", 1000, 8), ("large", 2**20, 8)) for i in range(c)], "d string, t string, path string, size bigint")
    assert [x.t for x in table_report(files, ["d", "t"]).where("fragmented").collect()] == ["small"]


def test_plan_holds_each_file_once_and_fills_evenly(spark):
    files = spark.createDataFrame([("d", "hot", f"p{i:05}", 100 + i % 7) for i in range(3000)] + [("d", "one", "q", 5), ("d", "one", "big", 10**6)], "d string, t string, path string, size bigint").repartition(5)
    got = packing_plan(files, ["d", "t"], target=10_000, open_cost=10).collect()
    assert len(got) == 3002 and len({x.path for x in got}) == 3002
    assert {x.path: x.out_file for x in got if x.t == "one"} == {"q": 0, "big": None}
    totals = {}
    for x in got:
        if x.t == "hot":
            totals[x.out_file] = totals.get(x.out_file, 0) + x.size + 10
    assert sorted(totals) == list(range(len(totals))) and max(totals.values()) < 10_400 and min(totals.values()) > 9_600


def test_consolidated_keeps_equal_rows_and_unplanned_paths(spark):
    plan = spark.createDataFrame([("d", "t", "p", 1, 0, 1)], "d string, t string, path string, size bigint, out_file bigint, out_files bigint")
    rows = spark.createDataFrame([("p", 1)] * 3 + [("other", 2), (None, 3)], "path string, out_file int")
    got = sorted((x.path or "", x[2]) for x in consolidated(rows.withColumnRenamed("out_file", "x"), plan, ["d", "t"]).collect())
    assert got == [("", None), ("other", None), ("p", 0), ("p", 0), ("p", 0)]


def test_compact_many_small_files(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.range(3000).selectExpr("id % 50 AS a", "cast(id AS string) AS b", "if(id % 3 = 0, null, id) AS c")
    df.unionByName(df.limit(40)).repartition(60).write.parquet(source)
    done = compact(spark, source, target)
    assert (done.files_before, done.files_after, done.rows) == (60, 1, 3040)
    assert _fingerprint(spark.read.parquet(target)) == _fingerprint(spark.read.parquet(source))
    with pytest.raises(FileExistsError):
        compact(spark, source, target)
    assert not [x for x in os.listdir(tmp_path) if "staging" in x]


def test_compact_publishes_nothing_that_differs(spark, tmp_path, monkeypatch):
    import lociweave.operators.compaction as module

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).write.parquet(source)
    seen = iter([(10, "x"), (9, "y")])
    monkeypatch.setattr(module, "_fingerprint", lambda df: next(seen))
    with pytest.raises(VerificationError):
        compact(spark, source, target)
    assert sorted(os.listdir(tmp_path)) == ["in"]


def test_compact_empty(spark, tmp_path):
    spark.createDataFrame([], "a int").write.parquet(str(tmp_path / "in"))
    assert compact(spark, str(tmp_path / "in"), str(tmp_path / "out")).rows == 0


def test_compact_reads_files_at_any_depth(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    for part, inside in enumerate(("", "multi{a}", "multi{a}/deep")):
        spark.range(part * 10, part * 10 + part + 3).coalesce(1).write.mode("append").parquet(str(source / inside))
    done = compact(spark, str(source), target)
    assert (done.files_before, done.rows) == (3, 12)
    assert sorted(x.id for x in spark.read.parquet(target).collect()) == [0, 1, 2, 10, 11, 12, 13, 20, 21, 22, 23, 24]


def test_compact_keeps_keys_of_directories_beside_plain_files(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    for n, inside in enumerate(("k=1", "k=2", "sub", "sub/j=5", "")):
        spark.range(n, n + 1).withColumn(f"c{n % 2}", F.lit(n)).coalesce(1).write.mode("append").parquet(str(source / inside))
    assert compact(spark, str(source), target).files_before == 5
    got = {x.id: (x.k and str(x.k), x.j and str(x.j), x.c0, x.c1) for x in spark.read.parquet(target).collect()}
    assert got == {0: ("1", None, 0, None), 1: ("2", None, None, 1), 2: (None, None, 2, None), 3: (None, "5", None, 3), 4: (None, None, 4, None)}


def test_compact_refuses_underscores_and_what_it_does_not_read(spark, tmp_path, monkeypatch):
    import lociweave.operators.compaction as module

    source = tmp_path / "in"
    spark.range(3).coalesce(1).write.parquet(str(source))
    spark.range(4).coalesce(1).write.parquet(str(source / "sub"))
    monkeypatch.setattr(module, "_read", lambda spark, source, files, fmt: [spark.read.parquet(source)])
    with pytest.raises(VerificationError):
        compact(spark, str(source), str(tmp_path / "out"))
    (source / "_hidden").mkdir()
    next(source.glob("*.parquet")).rename(source / "_hidden/x.parquet")
    with pytest.raises(ValueError, match="underscore"):
        compact(spark, str(source), str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path)) == ["in"]


def test_compact_keeps_tables_apart_in_one_job(spark, tmp_path):
    rows = spark.range(4000).selectExpr("concat('t ', id % 40, '/=%') AS t", "concat('p', id % 800) AS path", "id").unionByName(spark.createDataFrame([("hot", "p", i % 7) for i in range(900)], "t string, path string, id bigint"))
    folder = str(tmp_path / "in")
    assert laid_out(rows, ["t"], "path", folder, most_rows=500) == (802, 4900)
    assert laid_out(rows, ["t"], "path", folder, most_rows=500) == (802, 4900)
    done = compact(spark, folder, str(tmp_path / "out"), by=["t"])
    assert (done.files_before, done.files_after, done.rows, done.rows_after) == (802, 41, 4900, 4900)
    got = spark.read.schema("path string, id bigint, t string").parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.select("t", "path", "id").collect())) == sorted(map(tuple, rows.collect()))
    # Splits of a fixed size hold whole directories, or a part of one.
    done = compact(spark, folder, str(tmp_path / "many"), by=["t"], target_bytes=done.bytes_before // 10)
    assert 41 < done.files_after <= 41 + 12 and done.rows == 4900


def test_a_listing_opens_nothing_and_passes_over_hidden_names(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("a/x.parquet", "a/.y.parquet", "z.parquet", "a/_SUCCESS"):
        (tmp_path / name).write_bytes(b"none")
    assert {(x.path.rsplit("/", 1)[-1], x.size) for x in listed(spark, str(tmp_path)).collect()} == {("x.parquet", 4), ("z.parquet", 4)}


def test_queries_compact_the_small_files_of_each_table(spark):
    from lociweave.queries.data_ops import p5_compacted, p5_rewritten

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    stored = spark.read.parquet(f"{folder}/stored_rows.parquet")
    assert sorted(map(tuple, p5_compacted(spark, folder).collect())) == sorted(map(tuple, stored.select("path", "locus", "alleles", "s").collect()))
    got = p5_rewritten(spark, folder).collect()
    assert sum(x.files_before for x in got) == stored.select("path").distinct().count() > 2 * len(got)
    assert all(x.files_after == 1 for x in got)
