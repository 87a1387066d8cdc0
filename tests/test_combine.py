import datetime as dt
import json
import os
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lociweave.__main__ import main
from lociweave.functions.locus import SplitPoints
from lociweave.operators import combine, reports
from lociweave.operators.joins import interval_join
from lociweave.plans.ordering import OrderedFrame, OrderingAssertionFailed, ascending, held, order_violations, verify_order
from lociweave.plans.runs import BackgroundRun, Collect, CombinerRun, Explain, Formulation, InvalidAction, MetricsDirectory, Probe, RunCancelled, Write, error_code
from lociweave.sources import sinks
from lociweave.sources.conversions import ConversionError, defined_counts, entries, pack_loci, scaled, single_contig, unpack_loci, unsorted_rows
from lociweave.sources.files import compression_options
from lociweave.sources.generators import grouped_counts, range_table, unbounded_table
from lociweave.streaming.progress import event_rates, judged

from .data import SAMPLES, arrow, mixed, single_samples, write
from .test_throughput import series

LOCI = [("chr01", 10), ("chr01", 12), ("chr01", 12), ("chr01", 17), ("chr03", 4), ("chr03", 9), ("chr03", 9), ("chr04", 2)]


def loci(table):
    return list(zip(table["contig"].to_pylist(), table["position"].to_pylist()))


@pytest.mark.parametrize("n,groups,expected", [(5, 2, [0, 0, 0, 1, 1]), (4, 3, [0, 0, 1, 2]), (2, 9, [0, 1]), (1, 1, [0])])
def test_groups(n, groups, expected):
    assert combine.grouped(n, groups) == expected


@pytest.mark.parametrize("how", [Formulation(), Formulation("grouped-merge", 3), Formulation("interval-merge", points=SplitPoints.parse("1:17,3:9"))])
def test_formulations_give_the_same_rows(spark, tmp_path, how):
    out = CombinerRun(spark, mixed(tmp_path), "locus", how, Collect(None)).execute()
    assert out.rows == 32 and loci(out.table) == [x for x in LOCI for _ in SAMPLES]


def test_alleles_with_ranks(spark, tmp_path):
    out = CombinerRun(spark, single_samples(tmp_path), "locus,alleles", Formulation("alleles"), Collect()).execute()
    assert out.table["rank"].to_pylist() == [1, 1, 2, 1, 1, 1, 2, 1] and out.table["alleles"].to_pylist()[:3] == ["T,C", "A,T", "G,T"]


def test_one_exchange_for_each_formulation(spark, tmp_path):
    from lociweave.sources.dataset import Dataset

    ds = Dataset.discover(spark, single_samples(tmp_path), "locus")
    for how in (Formulation(), Formulation("grouped-merge", 2)):
        plan = how.plan(ds).df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "SinglePartition" not in plan


def test_writes(spark, tmp_path):
    root, m = mixed(tmp_path / "in"), str(tmp_path / "m")
    path = str(tmp_path / "all.parquet")
    out = CombinerRun(spark, root, "locus", Formulation(), Write(path, compression="zstd(3)", metrics=m, run_id="r")).execute()
    file = pq.ParquetFile(path)
    assert out.rows == 32 and file.metadata.num_rows == 32 and [c.column_index for c in file.metadata.row_group(0).sorting_columns] == [0, 1] and file.metadata.row_group(0).column(0).compression == "ZSTD"
    assert pq.read_table(str(tmp_path / "all.samples.parquet"))["s"].to_pylist() == sorted(SAMPLES)
    assert spark.read.parquet(path).count() == 32
    directory = MetricsDirectory(spark, m)
    r = directory.read("runs").first()
    assert (r.status, r.rows_written, r.samples, r.input_tables, r.run_id) == ("completed", 32, 4, 3, "r") and len(r) == 38
    assert directory.read("metrics").where("operator LIKE 'Scan%' AND metric = 'numOutputRows'").count() >= 3
    with pytest.raises(InvalidAction, match="taken"):
        CombinerRun(spark, root, "locus", Formulation(), Write(path, metrics=m, run_id="r")).execute()


def test_two_levels_give_the_rows_of_one(spark, tmp_path):
    root, second = single_samples(tmp_path / "in"), tmp_path / "second"
    os.makedirs(second)
    CombinerRun(spark, root, "locus", Formulation("grouped-merge", 2), Write(str(second / "g0.parquet")), inputs=[f"s={s}" for s in SAMPLES[:2]]).execute()
    CombinerRun(spark, root, "locus", Formulation("interval-merge", points=SplitPoints.parse("1:17,3:9,9:9")), Write(str(second / "g1")), inputs=[f"s={s}" for s in SAMPLES[2:]]).execute()
    names = [n for n in sorted(os.listdir(second / "g1")) if not n.startswith(".")]
    assert names == ["0.parquet", "1.parquet", "2.parquet", "3.parquet"] and [pq.read_metadata(second / "g1" / n).num_rows for n in names] == [6, 4, 6, 0]
    out = CombinerRun(spark, str(second), "locus,s", Formulation(), Collect(None)).execute()
    assert out.rows == 32 and loci(out.table) == [x for x in LOCI for _ in SAMPLES] and out.table["s"].to_pylist()[:4] == sorted(SAMPLES)


def test_output_refusals(spark, tmp_path):
    for bad in ("x", "x.samples.parquet", ".x.parquet", "x.parquet/", "x.orc"):
        with pytest.raises(sinks.OutputError):
            sinks.check_file_path(f"{tmp_path}/{bad}")
    for bad in ("x.parquet", ".x", "s=x"):
        with pytest.raises(sinks.OutputError):
            sinks.check_directory_path(f"{tmp_path}/{bad}")
    (tmp_path / "full").mkdir()
    (tmp_path / "full" / "x").touch()
    (tmp_path / "link").symlink_to(tmp_path / "none")
    for bad in ("full", "full/x", "link"):
        with pytest.raises(sinks.OutputError):
            sinks.check_vacant(spark, str(tmp_path / bad))
    sinks.remove_output(spark, str(tmp_path / "full"))
    sinks.check_vacant(spark, str(tmp_path / "full"))
    for bad in ("brotli", "zstd(99)", "snappy(3)", "gzip(x)"):
        with pytest.raises(ValueError):
            compression_options(bad)
    assert compression_options("gzip(6)")["compression"] == "gzip" and compression_options(None) == {}
    assert sinks.interval_file_names(11)[:2] == ["00.parquet", "01.parquet"]
    for how in (dict(name="x"), dict(name="union", groups=2), dict(name="interval-merge"), dict(name="union", points=SplitPoints([]))):
        with pytest.raises(InvalidAction):
            Formulation(**how)


def test_a_failed_run_is_recorded_and_leaves_no_annotation(spark, tmp_path):
    root, m = single_samples(tmp_path / "in"), str(tmp_path / "m")
    write(f"{root}/s={SAMPLES[0]}/bad.parquet", arrow([(1, 1, "A")]))
    with open(f"{root}/s={SAMPLES[0]}/bad.parquet", "r+b") as f:
        f.seek(4)
        f.write(b"\0" * 40)
    with pytest.raises(Exception):
        CombinerRun(spark, root, "locus", Formulation(), Write(str(tmp_path / "o.parquet"), metrics=m, run_id="r")).execute()
    assert MetricsDirectory(spark, m).read("runs").first().status == "failed" and not (tmp_path / "o.samples.parquet").exists()


def test_sinks(spark):
    df = range_table(spark, 1000)
    assert sinks.drained(df) == 1000
    assert sinks.collected(OrderedFrame(df.orderBy(*ascending(["idx"])), ("idx",)), 3)["idx"].to_pylist() == [1, 2, 3]
    assert {x.bucket: x.n for x in grouped_counts(df, 300).collect()} == {0: 299, 1: 300, 2: 300, 3: 101}
    assert unbounded_table(spark).isStreaming


def test_ordering_assertion(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    good = df.orderBy(*ascending(["x", "y"]))
    held(good, ["x"]), held(good, ["x", "y"]), held(good.limit(1), ["x"]), held(good.where("x > 0").select("x"), ["x"])
    held(df.sortWithinPartitions(*ascending(["x"])), ["x"], "each-partition")
    for bad, keys in ((df, ["x"]), (good, ["y"]), (df.orderBy("x"), ["x"]), (df.orderBy(F.desc_nulls_last("x")), ["x"]), (df.sortWithinPartitions(*ascending(["x"])), ["x"]), (good.groupBy("x").count(), ["x"])):
        with pytest.raises(OrderingAssertionFailed) as e:
            held(bad, keys)
        assert error_code(e.value) == "ordering_assertion_failed"
    with pytest.raises(ValueError):
        held(good, [])


def test_order_verification(spark):
    df = spark.range(100, numPartitions=4).selectExpr("id", "if(id = 63, null, id) AS v")
    verify_order(df, ["id"], strict=True)
    assert [tuple(x) for x in order_violations(df, ["v"]).collect()] == [(2, 14)]
    with pytest.raises(OrderingAssertionFailed, match="row 14 of partition 2"):
        verify_order(df, ["v"])
    assert order_violations(df.union(df), ["id"]).count() == 1 and order_violations(df.where("false"), ["id"]).count() == 0
    assert unsorted_rows(df.selectExpr("1 AS k", "cast(id div 2 AS string) AS s").coalesce(1).limit(10), ["k"]).count() == 5


def test_top_rows_need_no_full_sort(spark):
    frame = combine.combine_union([range_table(spark, 100), range_table(spark, 50)], ["idx"]).limit(5)
    assert "TakeOrderedAndProject" in frame.df._jdf.queryExecution().executedPlan().toString() and [r.idx for r in frame.df.collect()] == [1, 1, 2, 2, 3]


def test_explain(spark, tmp_path):
    root = single_samples(tmp_path)
    assert "Exchange" in CombinerRun(spark, root, "locus", Formulation(), Explain()).execute().text
    assert "numOutputRows" in CombinerRun(spark, root, "locus", Formulation(), Explain(True)).execute().text


def test_probe_and_replay(spark, tmp_path):
    root, m = single_samples(tmp_path / "in"), str(tmp_path / "m")
    for shadow in (False, True):
        out = CombinerRun(spark, root, "locus", Formulation(), Probe(m, f"p{shadow}", shadow)).execute()
        assert out.record["stop_reason"] == "completed" and out.rows == 32
    directory = MetricsDirectory(spark, m)
    write(f"{m}/checks/old.parquet", arrow([(1, 1, "A")]))
    assert directory.replay() == ["pTrue"] and directory.read("replays").count() == 576 and not os.path.exists(f"{m}/checks/old.parquet")
    assert directory.read("progress").where("run_id = 'pTrue'").count() >= 2


def test_background_runs(spark):
    run = BackgroundRun(spark, lambda: spark.range(10).count()).start()
    assert run.wait(60) == 10
    with pytest.raises(InvalidAction):
        BackgroundRun(spark, lambda: 1, run.run_id).start()
    slow = BackgroundRun(spark, lambda: spark.range(10**13).selectExpr("sum(hash(id))").collect()).start()
    time.sleep(0.5)
    slow.cancel()
    with pytest.raises(RunCancelled) as e:
        slow.wait(60)
    assert error_code(e.value) == "run_cancelled"


def test_settings_and_limits(spark, tmp_path):
    root = single_samples(tmp_path)
    out = CombinerRun(spark, root, "locus", Formulation(), Collect(None), limit=3, inputs=[f"s={SAMPLES[0]}"], settings={"target_partitions": "3"}).execute()
    assert loci(out.table) == LOCI[:3]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for bad in ({"x": "1"}, {"threads": "0"}):
        with pytest.raises(InvalidAction):
            CombinerRun(spark, root, "locus", Formulation(), Collect(), settings=bad).execute()


def test_interval_join(spark):
    points = [("a", p) for p in range(0, 200, 7)] + [(None, 3), ("b", None)]
    intervals = [("a", 5, 20, 1), ("a", 10, 150, 2), ("a", 150, 149, 3), ("b", 0, 9, 4), ("a", None, 5, 5)]
    p, i = spark.createDataFrame(points, "k string, x int"), spark.createDataFrame(intervals, "k string, lo int, hi int, n int")
    want = sorted((k, x, n) for k, x in points for j, lo, hi, n in intervals if k == j and None not in (k, x, lo) and lo <= x <= hi)
    assert sorted((r.k, r.x, r.n) for r in interval_join(p, i, ["k"], "x", "lo", "hi", bin_width=16).collect()) == want
    assert interval_join(p, i, ["k"], "x", "lo", "hi", how="left_semi").count() == len({w[:2] for w in want})
    assert interval_join(p, i, ["k"], "x", "lo", "hi", how="left_anti").count() == len(points) - len({w[:2] for w in want})
    assert interval_join(p, i, ["k"], "x", "lo", "hi", how="left").count() == len(want) + len(points) - len({w[:2] for w in want})


def test_conversions(spark):
    df = spark.createDataFrame([("chr1", 5, "A,G"), ("chr02", 7, "")], "contig string, position int, alleles string")
    packed = pack_loci(df)
    assert packed.columns == ["locus", "alleles"] and [tuple(r)[:2] for r in unpack_loci(packed).collect()] == [("chr01", 5), ("chr02", 7)]
    with pytest.raises(ConversionError):
        pack_loci(df.union(spark.createDataFrame([("chrX", 1, "A")], df.schema)))
    assert sorted((r.contig, r.position) for r in scaled(df, 3).collect()) == [("chr02", 7), ("chr1", 5), ("chr21", 5), ("chr21", 7), ("chr22", 5), ("chr22", 7)]
    for bad in (0, 24):
        with pytest.raises(ConversionError):
            scaled(df, bad)
    with pytest.raises(ConversionError):
        single_contig(df)
    assert single_contig(df.limit(1)) == "chr1"
    assert [r.alleles for r in combine.explode_alleles(df).collect()] == ["A", "G", ""]
    wide = spark.createDataFrame([(1, {"x": 3, "y": None})], "k int, entries map<string,int>")
    assert [tuple(r) for r in entries(wide, ["k"]).collect()] == [(1, "x", 3)]
    counts = defined_counts(spark.createDataFrame([("s", 1, None), ("s", None, None), ("t", None, None)], "s string, a int, b int"), ["s"], ["a", "b"])
    assert {tuple(r) for r in counts.collect()} == {("s", 2, 1, 0, True), ("t", 1, 0, 0, False)}


def test_sweep_report(spark, tmp_path):
    outcomes = [("u", 0), ("v", 1), ("w", 0)]
    rows = [("r1", "m", 1, 1, ["u", "v", "w", "x"], [(c, f"{c}-r1", e, 1.0) for c, e in outcomes], "done"), ("r2", "m", 1, 2, ["u"], [], "running")]
    runners = spark.createDataFrame(rows, reports.RUNNERS)
    schema = "run_id string, status string, input_tables bigint, threads bigint, rows_written bigint, run_ns bigint, steady_state_throughput double, peak_rss_bytes bigint"
    records = spark.createDataFrame([("u-r1", "completed", 50, 2, 1_000_000, 2 * 10**9, 600_000.0, 2**30), ("u-r2", None, 50, 2, 1_200_000, 2 * 10**9, None, 2**31), ("v-r1", "completed", 50, 2, 1, 1, None, 1)], schema)
    found = reports.cells(runners, records)
    assert {(r.run_id, r.state) for r in found.collect()} == {("u-r1", "ok"), ("u-r2", "ok"), ("v-r1", "failed"), ("w-r1", "failed"), ("x-r1", "open")}
    figures = reports.sweep(found, ["cell"])
    r = figures.first()
    assert r.n == 2 and r.whole_run == pytest.approx(1075806.3, rel=1e-6) and r.whole_run_half_range == pytest.approx(1 / 11) and r.steady_over_whole == pytest.approx(1.2) and r.peak_rss_bytes == 2**31
    assert [x.asDict() for x in reports.summary(figures, ["cell"]).collect()] == [{"cell": "u", "runs": "2", "rate": "1075.8k", "spread": "9.1 %", "steady rate": "1173.6k", "steady spread": "0.0 %", "steady : whole": "1.20", "memory": "2048 MiB"}]
    assert {tuple(x) for x in reports.trouble(found).collect()} == {("v-r1", "ended with code 1; record says completed"), ("w-r1", "ended well; left no record")}
    text = reports.report(figures, found, runners, ["cell"])
    assert text.startswith("Normalized throughput by cell\ncell  runs  rate ") and "\n\nIn trouble\nrun_id  why\nv-r1" in text and text.endswith("\n\nStill running\nrunner  status\nr2      running\n")
    assert "Still" not in reports.report(figures, found, runners.where("runner = 'r1'"), ["cell"])


@pytest.mark.parametrize("width", [4, 1 << 14])
def test_full_semi_and_anti_interval_joins(spark, width):
    points = spark.createDataFrame([("a", 5, 1), ("a", 5, 1), ("a", 50, 2), ("b", 7, 3), (None, 5, 4), ("a", None, 5)], "k string, at bigint, i int")
    blocks = spark.createDataFrame([("a", 0, 9, "x"), ("a", 4, 6, "y"), ("a", 9, 4, "w"), ("c", 0, 9, "z"), (None, 0, 9, "n"), ("a", None, 9, "m")], "k string, low bigint, high bigint, name string")
    join = lambda how: interval_join(points, blocks, ["k"], "at", "low", "high", bin_width=width, how=how)
    key = lambda r: tuple((x is not None, x) for x in r)
    full = sorted(((r.k, r.at, r.i, r.name) for r in join("full").collect()), key=key)
    matched = [("a", 5, 1, n) for n in "xxyy"]
    alone = [("a", 50, 2, None), ("b", 7, 3, None), (None, 5, 4, None), ("a", None, 5, None)]
    assert full == sorted([*matched, *alone, ("a", None, None, "w"), ("c", None, None, "z"), (None, None, None, "n"), ("a", None, None, "m")], key=key)
    assert sorted(r.i for r in join("left_semi").collect()) == [1, 1] and sorted(r.i for r in join("left_anti").collect()) == [2, 3, 4, 5]
    assert join("left").count() == 8 and join("inner").count() == 4
    none = interval_join(points, blocks.where("false"), ["k"], "at", "low", "high", how="full")
    assert none.count() == 6 and interval_join(points.where("false"), blocks, ["k"], "at", "low", "high", how="full").count() == 6


def test_metric_ratios(spark):
    rows = [("a", "x", 3), ("a", "x", 4), ("a", "y", 2), ("b", "x", 1), ("c", "x", 5), ("c", "y", 0)]
    got = reports.metric_ratios(spark.createDataFrame(rows, "g string, metric string, value bigint"), ["g"], {"r": ("x", "y")})
    assert {tuple(r) for r in got.collect()} == {("a", "r", 7, 2, 3.5), ("c", "r", 5, 0, None)}


def test_metrics_fold(spark):
    rows = [("a", "rows", 3), ("a", "rows", 4), ("a", "startTime", 9), ("a", "startTime", 5), ("a", "endTime", 7), ("a", "endTime", 8), ("a", "peakMemory", 2)]
    got = reports.folded_metrics(spark.createDataFrame(rows, "operator string, metric string, value bigint"), ["operator"])
    assert {r.metric: r.value for r in got.collect()} == {"rows": 7, "startTime": 5, "endTime": 8, "peakMemory": 2}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr("lociweave.__main__.local_session", lambda *a: spark)
    root = single_samples(tmp_path / "in")
    assert main(["combine-refs", root, "--show", "--limit", "2"]) == 0 and "chr01" in capsys.readouterr().out
    assert main(["combine-alleles", root, "--write", str(tmp_path / "a.parquet")]) == 0 and "8 rows written" in capsys.readouterr().out
    assert main(["combine-refs", root, "--write", str(tmp_path / "iv"), "--formulation", "interval-merge", "--split-points", "1:17,3:9"]) == 0
    write(f"{tmp_path}/t.parquet", arrow([(1, p, "A") for p in range(1, 11)]))
    capsys.readouterr()
    assert main(["balance-split-points", f"{tmp_path}/t.parquet", "--intervals", "4"]) == 0 and capsys.readouterr().out.strip() == "1:3,1:6,1:8"
    assert main(["pack-loci", f"{tmp_path}/t.parquet", f"{tmp_path}/packed"]) == 0 and spark.read.parquet(f"{tmp_path}/packed").columns == ["locus", "alleles"]
    assert main(["scale", f"{tmp_path}/t.parquet", f"{tmp_path}/scaled", "--factor", "3"]) == 0 and spark.read.parquet(f"{tmp_path}/scaled").count() == 30
    m = str(tmp_path / "m")
    assert main(["combine-refs", root, "--shadow-probe", "--metrics", m, "--run-id", "u-r1"]) == 0 and main(["replay", m]) == 0 and main(["calibration", m]) == 0
    os.makedirs(f"{m}/runners")
    with open(f"{m}/runners/r1.json", "w") as f:
        json.dump({"runner": "r1", "machine_type": "m", "threads_per_core": 1, "repetition": 1, "cell_order": ["u"], "cells": [{"cell": "u", "run_id": "u-r1", "exit_status": 0, "seconds": 1.0}], "status": "done"}, f)
    assert main(["sweep-report", m]) == 0 and "Normalized throughput by cell, machine_type" in capsys.readouterr().out
    for bad in (["combine-refs", root, "--show", "--compression", "zstd"], ["combine-refs", root, "--probe"], ["combine-refs", root, "--show", "--groups", "2"], ["balance-split-points", f"{tmp_path}/t.parquet", "--intervals", "1"]):
        assert main(bad) == 1 and "error:" in capsys.readouterr().err


def test_streamed_decisions_match_the_rule(spark, tmp_path):
    from lociweave.operators.throughput import ProbeSettings, decide

    settings = ProbeSettings(consecutive_checks=2, min_duration_ns=5 * 10**9)
    s = series([1000] * 12)
    rows = [("a", int(t), int(n)) for t, n in zip(s.elapsed, s.rows)]
    schema = "run_id string, elapsed_ns bigint, rows_total bigint"
    for i, part in enumerate((rows[:40] + rows[3:9], rows[40:], [("b", 0, 0)])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = judged(stream, settings).writeStream.format("memory").queryName("stops").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("stops").collect()
    want = next(n for n in range(1, len(s) + 1) if decide(settings, s.upto(n)))
    assert [(r.run_id, r.stop_reason, r.samples, r.steady_state_throughput) for r in got] == [("a", "steady", want, 1000.0)]


def test_event_windows(spark):
    at = dt.datetime(2026, 1, 1, 10)
    df = spark.createDataFrame([(at, "x"), (at + dt.timedelta(seconds=59), "x"), (at + dt.timedelta(seconds=60), "y")], "ts timestamp, k string")
    assert sorted((r.window_start.minute, r.k, r.n) for r in event_rates(df, key="k").collect()) == [(0, "x", 2), (1, "y", 1)]
    assert json.dumps([r.n for r in event_rates(df.where("false")).collect()]) == "[]"
