"""Command line: combine-refs, combine-alleles, balance-split-points, replay, compact."""

from __future__ import annotations

import argparse
import sys

from .functions.locus import SplitPoints
from .operators import reports
from .operators.compaction import compact
from .operators.replay import calibration
from .operators.split_points import row_balanced
from .plans.ordering import ascending
from .plans.runs import Collect, CombinerRun, Explain, Formulation, InvalidAction, MetricsDirectory, Outcome, Probe, Write
from .session import local_session
from .sources.conversions import normalized_contigs, pack_loci, scaled
from .sources.dataset import LocusTable, loaded
from .sources.files import Files
from .sources.sinks import check_vacant


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lociweave")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("combine-refs", "combine-alleles"):
        c = sub.add_parser(name)
        c.add_argument("path")
        c.add_argument("--input-format", default="parquet")
        c.add_argument("--output-format")
        how = c.add_mutually_exclusive_group(required=True)
        how.add_argument("--write", metavar="PATH")
        how.add_argument("--show", action="store_true")
        how.add_argument("--explain", action="store_true")
        how.add_argument("--explain-analyze", action="store_true")
        how.add_argument("--probe", action="store_true")
        how.add_argument("--shadow-probe", action="store_true")
        c.add_argument("--compression")
        c.add_argument("--metrics", metavar="DIR")
        c.add_argument("--run-id")
        c.add_argument("--limit", type=int)
        c.add_argument("--inputs", type=lambda t: [x for x in t.split(",") if x])
        c.add_argument("--threads", default="*")
        if name == "combine-refs":
            c.add_argument("--formulation", default="union", choices=("union", "grouped-merge", "interval-merge"))
            c.add_argument("--groups", type=int)
            c.add_argument("--split-points", type=SplitPoints.parse)
            c.add_argument("--preserve-sample-ordering", action="store_true")
    b = sub.add_parser("balance-split-points")
    b.add_argument("path")
    b.add_argument("--intervals", type=int, required=True)
    b.add_argument("--input-format", default="parquet")
    r = sub.add_parser("replay")
    r.add_argument("metrics_dir")
    for name in ("pack-loci", "scale"):
        c = sub.add_parser(name)
        c.add_argument("path")
        c.add_argument("dest")
        if name == "scale":
            c.add_argument("--factor", type=int, default=10)
    w = sub.add_parser("sweep-report")
    w.add_argument("metrics_dir")
    v = sub.add_parser("calibration")
    v.add_argument("metrics_dir")
    k = sub.add_parser("compact")
    k.add_argument("source")
    k.add_argument("target")
    k.add_argument("--target-bytes", type=int, default=128 * 1024 * 1024)
    return p


def action_of(a: argparse.Namespace):
    if a.compression and not a.write:
        raise InvalidAction("--compression needs --write")
    if a.metrics and not (a.write or a.probe or a.shadow_probe):
        raise InvalidAction("--metrics needs --write or a probe")
    if a.run_id and not a.metrics:
        raise InvalidAction("--run-id needs --metrics")
    if a.write:
        return Write(a.write, a.output_format or a.input_format, a.compression, a.metrics, a.run_id)
    if a.probe or a.shadow_probe:
        if not a.metrics:
            raise InvalidAction("a probe needs --metrics")
        return Probe(a.metrics, a.run_id, a.shadow_probe)
    if a.show:
        return Collect(a.limit if a.limit is not None else 20)
    return Explain(a.explain_analyze)


def rendered(o: Outcome) -> str:
    if o.kind == "plan":
        return o.text
    if o.kind == "rows":
        return o.table.to_pandas().to_string(index=False)
    if o.kind == "write":
        return f"{o.rows} rows written"
    r = o.record
    if o.kind == "measured-write":
        return f"{o.rows} rows written in {r['run_ns'] / 1e9:.3f} s, run {o.run_id}"
    rate = r["steady_state_throughput"]
    return f"{r['stop_reason']}: {'no rate' if rate is None else f'{rate:.1f} rows/s'}, {r['window_rows']} rows in the window, run {o.run_id}"


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = local_session(getattr(a, "threads", "*"))
    try:
        if a.command in ("combine-refs", "combine-alleles"):
            if a.command == "combine-refs":
                how = Formulation(a.formulation, a.groups, a.split_points)
                ordering = "locus,s" if a.preserve_sample_ordering else "locus"
            else:
                how, ordering = Formulation("alleles"), "locus,alleles"
            limit = None if a.show else a.limit
            print(rendered(CombinerRun(spark, a.path, ordering, how, action_of(a), fmt=a.input_format, inputs=a.inputs, limit=limit).execute()))
        elif a.command == "balance-split-points":
            table = LocusTable(spark, a.path, a.input_format)
            print(points_text(table, a.intervals))
        elif a.command == "replay":
            print(f"{len(MetricsDirectory(spark, a.metrics_dir).replay())} shadow runs replayed")
        elif a.command in ("pack-loci", "scale"):
            rows = loaded_table(spark, a.path)
            check_vacant(spark, a.dest)
            made = pack_loci(rows) if a.command == "pack-loci" else scaled(normalized_contigs(rows), a.factor)
            keys = [c for c in ("locus", "contig", "position", "s") if c in made.columns]
            made.repartitionByRange(*ascending(keys)).sortWithinPartitions(*ascending(keys)).write.mode("append").parquet(a.dest)
            print(f"written to {a.dest}")
        elif a.command == "sweep-report":
            print(sweep_text(spark, a.metrics_dir))
        elif a.command == "calibration":
            runs = MetricsDirectory(spark, a.metrics_dir).read("runs")
            if runs is None or not runs.where("action = 'shadow'").limit(1).count():
                raise ValueError(f"{a.metrics_dir} has no shadow probes")
            print(calibration(runs).orderBy("run_id").toPandas().to_string(index=False))
        else:
            done = compact(spark, a.source, a.target, target_bytes=a.target_bytes)
            print(f"{done.rows} rows, {done.files_before} files into {done.files_after}")
    except (ValueError, RuntimeError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


def loaded_table(spark, path: str):
    return loaded(spark, "parquet", [e.path for e in Files(spark).data_files(path, ".parquet")])


def sweep_text(spark, folder: str) -> str:
    """The report over a metrics directory's runs/ and the runner records (JSON) in its runners/."""
    records = MetricsDirectory(spark, folder).read("runs")
    if records is None or not Files(spark).exists(f"{folder}/runners"):
        raise ValueError(f"{folder} has no run records, or no runner records under runners/")
    runners = spark.read.schema(reports.RUNNERS).option("multiLine", True).json(f"{folder}/runners")
    found = reports.cells(runners, records)
    by = ["cell", "machine_type", "threads_per_core"]
    return reports.report(reports.sweep(found, by), found, runners, by)


def points_text(table: LocusTable, intervals: int) -> str:
    """Split points in the form that --split-points takes."""
    from pyspark.sql import functions as F

    from .functions.locus import Locus, contig_ordinal

    columns = table.ordering()
    rows = table.read()
    if columns == ["locus"]:
        found = row_balanced(rows, ["locus"], intervals).orderBy("k").collect()
        return str(SplitPoints(Locus.unpack(r.locus) for r in found))
    rows = rows.select(contig_ordinal(F.col("contig")).alias("ordinal"), "position")
    if rows.where("ordinal IS NULL").limit(1).count():
        raise ValueError("a contig has no ordinal")
    found = row_balanced(rows, ["ordinal", "position"], intervals).orderBy("k").collect()
    return str(SplitPoints(Locus(r.ordinal, r.position) for r in found))


if __name__ == "__main__":
    sys.exit(main())
