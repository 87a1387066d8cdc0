"""Datasets of many single samples: plans and calls don't grow with them."""

import uuid

import pytest

from lociweave.functions.locus import Locus, LocusInterval, SplitPoints
from lociweave.plans.runs import Collect, CombinerRun, Formulation, Write
from lociweave.queries.datasets import dataset_interval, dataset_rows, laid_out
from lociweave.sources import statistics
from lociweave.sources.dataset import Dataset

from .data import FILES, arrow, samples_table, single_samples, write

NAMES = [f"{i:03d}" for i in range(20)]


def leaves(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def counts(df):
    return {r.s: r["count"] for r in df.groupBy("s").count().collect()}


@pytest.fixture
def root(tmp_path):
    """Twenty single samples of eight rows each, and one table of two samples."""
    single_samples(tmp_path / "in", samples=NAMES)
    write(f"{tmp_path}/in/g0.parquet", arrow([(*r, s) for r in FILES["w"] for s in "xy"], sample=True))
    samples_table(f"{tmp_path}/in/g0.samples.parquet", "xy")
    return str(tmp_path / "in")


def test_reopened_dataset_is_one_scan(spark, root):
    single_samples(root, samples=["a=b", "a%3Ab"])
    write(f"{root}/s=below/x/y/w.parquet", arrow(FILES["w"]))
    df = Dataset.reopen(spark, Dataset.discover(spark, root, "locus").describe()).read()
    # One scan, g0, and the two that the engine's reader would name or list otherwise.
    assert leaves(df) == 4 and not Dataset.discover(spark, root, "locus").frames()[-1].schema["s"].nullable
    assert counts(df) == {**dict.fromkeys([*NAMES, "a=b", "a%3Ab"], 8), "below": 2, "x": 2, "y": 2}
    assert leaves(df.where("s = '007'")) <= 4 and df.where("s = '007'").count() == 8


def test_interval_is_one_scan_of_the_files_that_may_hold_it(spark, root):
    interval = LocusInterval(Locus(3, 1), Locus(3, 9))
    df = Dataset.discover(spark, root, "locus").read(interval)
    assert leaves(df) == 1 and len(df.inputFiles()) <= 2 * len(NAMES) and not any(f.endswith(("w.parquet", "t.parquet")) for f in df.inputFiles())
    assert counts(df) == dict.fromkeys(NAMES, 1)


def test_collected_run_is_one_scan(spark, root):
    run = CombinerRun(spark, root, "locus,s", Formulation(), Collect(3))
    assert leaves(run.formulation.plan(Dataset.discover(spark, root, "locus,s")).df) == 2
    assert run.execute().table.select(["contig", "position", "s"]).to_pylist() == [{"contig": "chr01", "position": 10, "s": s} for s in NAMES[:3]]


def test_interval_merge_run_is_one_scan(spark, root, tmp_path):
    how = Formulation("interval-merge", points=SplitPoints.parse("1:12,3:5"))
    assert leaves(how.plan(Dataset.discover(spark, root, "locus,s")).df) == 2
    out = str(tmp_path / "out")
    assert CombinerRun(spark, root, "locus,s", how, Write(out)).execute().rows == 164
    assert [spark.read.parquet(f"{out}/{i}.parquet").count() for i in range(3)] == [22, 82, 60]


def test_grouped_merge_run_is_one_scan(spark, root, tmp_path):
    how = Formulation("grouped-merge", 2)
    assert leaves(how.plan(Dataset.discover(spark, root, "locus,s")).df) == 2
    record = CombinerRun(spark, root, "locus,s", how, Write(str(tmp_path / "all.parquet"))).execute().record
    assert (record["groups"], record["input_tables"], record["samples"], record["rows_written"]) == (2, 21, 22, 164)


def test_written_run_is_one_scan(spark, root, tmp_path):
    assert leaves(Formulation().plan(Dataset.discover(spark, root, "locus,s")).df) == 2
    path = str(tmp_path / "all.parquet")
    CombinerRun(spark, root, "locus,s", Formulation(), Write(path)).execute()
    assert counts(spark.read.parquet(path)) == {**dict.fromkeys(NAMES, 8), "x": 2, "y": 2}


def most_tasks(spark, work):
    """Tasks of the largest stage of the jobs that `work` starts, on splits of at most 16 MB."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    spark.sparkContext.setJobGroup(group := uuid.uuid4().hex, "counted")
    try:
        work()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.sparkContext.setJobGroup("rest", "")
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(k) for j in tracker.getJobIdsForGroup(group) for k in tracker.getJobInfo(j).stageIds]
    return max(x.numTasks for x in stages if x)


@pytest.fixture
def many(tmp_path):
    """A hundred single samples of four files each."""
    return single_samples(tmp_path / "many", samples=[f"{i:03d}" for i in range(100)])


def test_tasks_of_a_grouped_merge_run_do_not_grow_with_the_files(spark, many, tmp_path):
    run = CombinerRun(spark, many, "locus,s", Formulation("grouped-merge", 2), Write(str(tmp_path / "all.parquet")))
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    # Four files a task would be a hundred tasks.
    assert most_tasks(spark, lambda: run.execute()) <= 16 and spark.conf.get("spark.sql.files.openCostInBytes") == cost
    assert counts(spark.read.parquet(str(tmp_path / "all.parquet"))) == {f"{i:03d}": 8 for i in range(100)}


def test_tasks_of_an_interval_merge_run_do_not_grow_with_the_files(spark, many, tmp_path):
    run = CombinerRun(spark, many, "locus,s", Formulation("interval-merge", points=SplitPoints.parse("1:12,3:5")), Write(str(tmp_path / "out")))
    assert most_tasks(spark, lambda: run.execute()) <= 16
    assert [spark.read.parquet(f"{tmp_path}/out/{i}.parquet").count() for i in range(3)] == [100, 400, 300]


def test_tasks_of_a_union_run_do_not_grow_with_the_files(spark, many, tmp_path):
    run = CombinerRun(spark, many, "locus,s", Formulation(), Write(str(tmp_path / "all.parquet")))
    assert most_tasks(spark, lambda: run.execute()) <= 16
    assert counts(spark.read.parquet(str(tmp_path / "all.parquet"))) == {f"{i:03d}": 8 for i in range(100)}


def test_kept_footers_share_their_names(spark, many, monkeypatch):
    monkeypatch.setattr(statistics, "_cache", {})
    ds = Dataset.discover(spark, many, "locus")
    kept = list(statistics._cache.values())
    assert len(kept) == 400 and len(ds.tables) == 100 and not any(hasattr(x, "__dict__") for f in kept for x in (f, *f.bounds.values()))
    assert len({id(c) for f in kept for c in (*f.bounds, *f.nulls)}) == 3


@pytest.fixture
def refs(spark, tmp_path):
    """refs of twenty samples of a hundred rows each, one with a name that ends in no digit, one on a contig without an ordinal."""
    samples = [f"SM{i:03d}" for i in range(18)] + ["SM00x", "SM020"]
    rows = [("chrX" if k == 19 else f"chr{1 + i // 25}", 89_000 + 100 * i, 1, 2, 3, 2, s) for k, s in enumerate(samples) for i in range(100)]
    spark.createDataFrame(rows, "contig string, position int, DP int, GQ int, LEN int, ploidy int, s string").coalesce(1).write.parquet(f"{tmp_path}/refs.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    yield str(tmp_path)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_samples_are_laid_out_by_more_tasks_than_files(spark, refs):
    found = Dataset.discover(spark, laid_out(spark, refs), "locus")
    single = {t.name: found.files(t) for t in found.tables if t.kind == "single_sample"}
    assert len(single) == 11 and all(len(f) <= 4 for f in single.values())
    # Each of the four parts of the loci is written by three tasks.
    assert len({f.path.rsplit("/", 1)[-1].split("-")[1] for files in single.values() for f in files}) > 4
    for files in single.values():
        ends = sorted(((f.bounds["contig"].low, f.bounds["position"].low), (f.bounds["contig"].high, f.bounds["position"].high)) for f in files)
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_laid_out_samples_are_whole(spark, refs):
    assert counts(dataset_interval(spark, refs)) == dict.fromkeys([*(f"SM{i:03d}" for i in range(18)), "SM00x"], 40)
    assert {(r.contig, r.s) for r in dataset_rows(spark, refs).where("contig LIKE '%X' OR s = 'SM020'").distinct().collect()} == {("chrX", "SM020")}
