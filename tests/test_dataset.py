import os

import pyarrow as pa
import pytest

from lociweave.functions.locus import Locus, LocusInterval, SplitPoints
from lociweave.plans.ordering import RowOrdering, representation
from lociweave.sources.annotation import AnnotationError, annotated, read_samples
from lociweave.sources.dataset import Dataset, DatasetError, LocusTable
from lociweave.sources.statistics import Bounds, FileStatistics, OrderRefuted, UnusableStatistics, pruned, recovered_order

from .data import FILES, SAMPLES, arrow, mixed, samples_table, single_samples, write


@pytest.mark.parametrize("packed", [False, True])
def test_single_samples(spark, tmp_path, packed):
    ds = Dataset.discover(spark, single_samples(tmp_path, packed), "locus")
    assert [t.name for t in ds.tables] == [f"s={s}" for s in SAMPLES] and ds.samples == list(SAMPLES)
    assert ds.read().count() == 32 and ds.read().columns == [*(["locus"] if packed else ["contig", "position"]), "alleles", "s"]
    assert [f.path.rsplit("/", 1)[-1] for f in ds.file_order(ds.tables[0])] == [f"{x}.parquet" for x in "wtmb"]
    some = ds.restrict_to([f"s={SAMPLES[1]}", f"s={SAMPLES[1]}"])
    assert {r.s for r in some.read().collect()} == {SAMPLES[1]}
    interval = LocusInterval(Locus(1, 12), Locus(3, 9))
    assert ds.read(interval).count() == 16


def test_sample_filter_prunes_branches(spark, tmp_path):
    df = Dataset.discover(spark, single_samples(tmp_path), "locus").read().where(f"s = '{SAMPLES[0]}'")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_raw_sample_names(spark, tmp_path):
    ds = Dataset.discover(spark, single_samples(tmp_path, samples=("007", "a%20b")), "locus")
    assert ds.samples == ["007", "a%20b"] and {r.s for r in ds.read().collect()} == {"007", "a%20b"}


def test_mixed_tables_and_descriptions(spark, tmp_path):
    ds = Dataset.discover(spark, mixed(tmp_path), "locus,s")
    assert [(t.name, t.kind) for t in ds.tables] == [("g0", "multi_sample_file"), ("g1", "multi_sample_directory"), (f"s={SAMPLES[3]}", "single_sample")]
    assert ds.read().count() == 32 and ds.sort_columns() == ["contig", "position", "s"]
    again = Dataset.reopen(spark, ds.restrict_to(["g1"]).describe())
    assert [t.name for t in again.tables] == ["g1"] and again.read().count() == 8
    with pytest.raises(DatasetError, match="changed"):
        Dataset.reopen(spark, ds.describe().replace("alleles: string", "alleles: int32"))
    with pytest.raises(DatasetError, match="version"):
        Dataset.reopen(spark, '{"version": 2}')


def test_hidden_and_empty_files(spark, tmp_path):
    root = single_samples(tmp_path, samples=SAMPLES[:1])
    write(f"{root}/.tmp/x.parquet", arrow(FILES["b"]))
    write(f"{root}/s={SAMPLES[0]}/.hidden.parquet", arrow(FILES["b"]))
    write(f"{root}/s={SAMPLES[0]}/0empty.parquet", arrow([]))
    write(f"{root}/s=none/e.parquet", arrow([]))
    ds = Dataset.discover(spark, root, "locus")
    assert [(t.name, len(ds.files(t))) for t in ds.tables] == [(f"s={SAMPLES[0]}", 5), ("s=none", 1)]
    assert ds.frame(ds.tables[0]).count() == 8 and ds.frame(ds.tables[1]).count() == 0
    # The engine would pass over a name that begins with an underscore; only a dot hides.
    write(f"{root}/s={SAMPLES[0]}/_seen.parquet", arrow([(3, 1, "T")]))
    ds = Dataset.discover(spark, root, "locus")
    rows = ds.frame(ds.tables[0])
    assert rows.count() == 9 and [tuple(r) for r in rows.where("position = 1").collect()] == [("chr03", 1, "T", SAMPLES[0])]
    write(f"{root}/s=only/_one.parquet", arrow([(5, 5, "A")]))
    assert Dataset.discover(spark, root, "locus").read().where("s = 'only'").count() == 1


@pytest.mark.parametrize(
    "break_it,message",
    [
        (lambda r: open(f"{r}/notes.txt", "w").close(), "unknown entry"),
        (lambda r: write(f"{r}/g2.parquet", arrow([(1, 1, "A", "x")], sample=True)), "incomplete write"),
        (lambda r: samples_table(f"{r}/g3.samples.parquet", ["x"]), "annotation without data"),
        (lambda r: write(f"{r}/g1.parquet", arrow([(1, 1, "A", "x")], sample=True)), "both a file and a directory"),
        (lambda r: write(f"{r}/s={SAMPLES[0]}/x.parquet", arrow(FILES["b"])), "is in both"),
        (lambda r: write(f"{r}/s=odd/x.parquet", arrow(FILES["b"], nullable=True)), r"lacks the dataset's \[alleles: string\] and the dataset lacks its \[alleles: string\?\]"),
        (lambda r: write(f"{r}/s=two/x.parquet", arrow([(1, 1, "A", "x")], sample=True)), "column s is stored"),
    ],
)
def test_refusals(spark, tmp_path, break_it, message):
    root = mixed(tmp_path)
    break_it(root)
    with pytest.raises(DatasetError, match=message):
        Dataset.discover(spark, root, "locus")


def test_more_refusals(spark, tmp_path):
    with pytest.raises(DatasetError, match="exist"):
        Dataset.discover(spark, str(tmp_path / "no"), "locus")
    ds = Dataset.discover(spark, single_samples(tmp_path / "d"), "locus")
    with pytest.raises(DatasetError, match="unknown input tables: g, h"):
        ds.restrict_to(["h", "g"])
    with pytest.raises(DatasetError):
        ds.restrict_to([])
    with pytest.raises(ValueError, match="vortex"):
        Dataset.discover(spark, str(tmp_path / "d"), "locus", "vortex")
    with pytest.raises(ValueError, match="unsupported storage"):
        Dataset.discover(spark, "ftp://x/y", "locus")
    given = Dataset.discover(spark, str(tmp_path / "d"), "locus", schema=pa.schema([pa.field("locus", pa.int64(), False)]))
    assert given.sort_columns() == ["locus"]


def test_orderings():
    assert RowOrdering.parse("locus,s").columns(["contig", "position", "s", "DP"]) == ["contig", "position", "s"]
    assert RowOrdering.parse("locus , alleles").starts_with(RowOrdering.parse("locus"))
    for bad in ("", "s", "locus,locus", "locus,x", "s,locus"):
        with pytest.raises(ValueError):
            RowOrdering.parse(bad)
    with pytest.raises(ValueError):
        RowOrdering.parse("locus,alleles").columns(["locus"])
    with pytest.raises(ValueError):
        representation(["locus", "contig", "position"])
    with pytest.raises(ValueError):
        representation(["position"])


@pytest.mark.parametrize("samples,nullable,message", [([], False, "no samples"), (["a", "a"], False, "twice"), (["a"], True, "nullable")])
def test_bad_annotations(tmp_path, samples, nullable, message):
    samples_table(str(tmp_path / "x.samples.parquet"), samples, nullable)
    with pytest.raises(AnnotationError, match=message):
        read_samples(str(tmp_path / "x.samples.parquet"))


def test_annotation_is_written_last(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    assert read_samples(annotated(spark, path, ["b", "a", "a"], lambda: None)) == ["a", "b"]

    def fail():
        assert not (tmp_path / "t.samples.parquet").exists()
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        annotated(spark, path, ["a"], fail)
    assert not (tmp_path / "t.samples.parquet").exists()


def stats(name, rows=5, nulls=None, **bounds):
    return FileStatistics(name, rows, {k: v if isinstance(v, Bounds) else Bounds(*v) for k, v in bounds.items()}, nulls or {})


def test_order_recovery():
    names = lambda fs: [f.path for f in fs]
    files = [stats("c", a=(2, 2), b=(5, 9)), stats("b", a=(2, 2), b=(1, 5)), stats("a", a=(1, 2), b=(0, 99)), stats("z", rows=0)]
    assert names(recovered_order(files, ["a", "b"])) == ["a", "b", "c"]
    assert names(recovered_order([stats("y", a=(3, 4)), stats("x", a=(1, 3))], ["a"])) == ["x", "y"]
    with pytest.raises(OrderRefuted, match="x.*y"):
        recovered_order([stats("x", a=(1, 4)), stats("y", a=(3, 5))], ["a"])
    for bad in (stats("x", a=Bounds(1, 2, False)), stats("x"), stats("x", a=(3, 1)), stats("x", a=(1, 2), nulls={"a": 1})):
        with pytest.raises(UnusableStatistics, match="x.*a"):
            recovered_order([bad], ["a"])
    # An inexact bound of a column that isn't compared doesn't matter.
    assert names(recovered_order([stats("x", a=(1, 2), b=Bounds(0, 0, False))], ["a", "b"])) == ["x"]


def test_pruning_keeps_what_it_cannot_rule_out():
    files = [stats("x", a=(1, 4)), stats("y", a=(6, 9)), stats("u"), stats("v", a=Bounds(100, 200, False))]
    assert [f.path for f in pruned(files, {"a": (5, 8)})] == ["y", "u", "v"]
    assert [f.path for f in pruned(files, {"a": (None, 5), "b": (1, 1)})] == ["x", "u", "v"]


def test_locus_table(spark, tmp_path):
    for name, rows in FILES.items():
        write(f"{tmp_path}/t/{name}.parquet", arrow(rows))
    t = LocusTable(spark, str(tmp_path / "t"))
    assert t.read().count() == 8 and [f.path[-9:] for f in t.file_order()] == [f"{x}.parquet" for x in "wtmb"]
    with pytest.raises(DatasetError, match="no rows"):
        write(f"{tmp_path}/e.parquet", arrow([]))
        LocusTable(spark, f"{tmp_path}/e.parquet").read()


def test_footers_by_tasks_are_those_by_the_driver(spark, tmp_path, monkeypatch):
    from lociweave.sources import statistics as module
    from lociweave.sources.files import Files

    ds = Dataset.discover(spark, single_samples(tmp_path), "locus")
    entries = [e for t in ds.tables for e in Files(spark).data_files(t.path, ".parquet")]
    want = module.statistics(entries)
    monkeypatch.setattr(module, "_cache", {})
    monkeypatch.setattr(module, "BY_TASKS", 2)
    assert module.statistics(entries, spark) == want and len(want) == 16 and want[0].bounds["position"].low == 2
    monkeypatch.setattr(module, "MOST_KEPT", 3)
    assert module.statistics(entries, spark) == want and len(module._cache) == 3


def test_descending_columns_and_unlike_types():
    names = lambda fs: [f.path for f in fs]
    files = [stats("low", a=(1, 1), b=(0, 4)), stats("high", a=(1, 1), b=(4, 9)), stats("top", a=(2, 5))]
    assert names(recovered_order(files, ["a", "b"], {"b"})) == ["high", "low", "top"] and names(recovered_order(files, ["a", "b"], {"a", "b"})) == ["top", "high", "low"]
    with pytest.raises(OrderRefuted):
        recovered_order([stats("x", a=(1, 4)), stats("y", a=(3, 5))], ["a"], {"a"})
    with pytest.raises(UnusableStatistics, match="types"):
        recovered_order([stats("x", a=(1, 4)), stats("y", a=("b", "c"))], ["a"])


def test_pruning_by_any_column_and_by_sample(spark, tmp_path):
    ds = Dataset.discover(spark, single_samples(tmp_path), "locus")
    got = ds.read(within={"position": (None, 10), "s": (SAMPLES[1], SAMPLES[2])})
    assert sorted({(r.s, r.position) for r in got.collect()}) == [(s, p) for s in SAMPLES[1:3] for p in (2, 4, 9, 10)]
    assert ds.frame(ds.tables[0], within={"position": (15, None)})._jdf.inputFiles()[0].endswith("t.parquet") and len(ds.frame(ds.tables[0], within={"position": (15, None)})._jdf.inputFiles()) == 1
    assert ds.frame(ds.tables[0], within={"s": (SAMPLES[1], None)}).count() == 0


def test_orc_end_to_end(spark, tmp_path):
    from lociweave.plans.runs import Collect, CombinerRun, Formulation, Write

    rows = [(f"chr{c:02d}", p, a) for part in FILES.values() for c, p, a in part]
    for s in SAMPLES:
        spark.createDataFrame(rows, "contig string, position int, alleles string").repartition(2).write.orc(f"{tmp_path}/in/s={s}")
    for root, dirs, names in os.walk(tmp_path / "in"):
        for n in names:
            if n.startswith("_"):
                os.remove(f"{root}/{n}")
    ds = Dataset.discover(spark, str(tmp_path / "in"), "locus", "orc")
    assert ds.read().count() == 32 and ds.samples == list(SAMPLES)
    out = str(tmp_path / "multi" / "all.orc")
    CombinerRun(spark, str(tmp_path / "in"), "locus", Formulation(), Write(out, "orc", "zstd"), fmt="orc").execute()
    CombinerRun(spark, str(tmp_path / "in"), "locus", Formulation("interval-merge", points=SplitPoints.parse("1:17,9:9")), Write(str(tmp_path / "multi2" / "iv"), "orc"), fmt="orc").execute()
    for folder, name in (("multi", "all"), ("multi2", "iv")):
        again = CombinerRun(spark, str(tmp_path / folder), "locus", Formulation(), Collect(None), fmt="orc").execute()
        assert again.rows == 32 and again.table["position"].to_pylist()[:4] == [10] * 4, name
    assert read_samples(str(tmp_path / "multi" / "all.samples.orc")) == sorted(SAMPLES)
    t = LocusTable(spark, out, "orc")
    assert t.read().count() == 32
    with pytest.raises(UnusableStatistics):
        t.file_order()
