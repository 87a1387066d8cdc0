"""Queries of the dataset, sink and run layers: each lays refs out as a dataset in the shared folder and works on that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.locus import Locus, LocusInterval, SplitPoints, contig_ordinal, interval_index, pack
from ..operators import reports
from ..operators.joins import interval_join
from ..operators.replay import overview, stops_over_checks
from ..plans.ordering import OrderedFrame, ascending, order_violations
from ..plans.runs import Collect, CombinerRun, Explain, Formulation, MetricsDirectory, Write
from ..session import partitions_for, scratch_path, table
from ..sources import sinks
from ..sources.annotation import annotated, read_samples
from ..sources.conversions import normalized_contigs
from ..sources.dataset import Dataset, loaded
from ..sources.files import Files

POINTS = SplitPoints.parse("1:80000,2:60000,5:40000")
INTERVAL = LocusInterval(Locus.parse("1:90000"), Locus.parse("3:50000"))
COLUMNS = ["contig", "position", "DP", "GQ", "LEN", "ploidy", "s"]
LOCUS = ["contig", "position"]


def laid_out(spark: SparkSession, d: str) -> str:
    """refs as a dataset: samples ending in 0-4 as a directory each, in 5-6 as one file, in 7-9 (or no digit) as a directory of a file an interval."""
    root = scratch_path(spark, "dataset")
    refs = normalized_contigs(table(spark, d, "refs").select(*COLUMNS)).where("s IS NOT NULL")
    digit = F.substring("s", -1, 1)
    single, groups = digit < "5", {"g0": digit.between("5", "6"), "g1": digit >= "7"}
    quarters, samples = _quarters_and_samples(refs, single, groups)
    # A sample's rows lie in a file a quarter of the loci; the samples of a quarter are shared out among tasks.
    spread = max(1, partitions_for(spark) // (len(quarters) + 1))
    task = interval_index(quarters, contig=F.col("contig"), position=F.col("position")) * spread + F.pmod(F.hash("s"), F.lit(spread))
    rows = refs.where(single).withColumn("__task", task).repartitionById((len(quarters) + 1) * spread, F.col("__task")).drop("__task").sortWithinPartitions("s", *LOCUS)
    rows.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy("s").parquet(root)
    for name, of_group in groups.items():
        rows = refs.where(of_group).withColumn("s", F.coalesce("s", F.lit("")))
        if not samples[name]:
            continue
        if name == "g0":
            frame = OrderedFrame(rows.orderBy(*ascending(LOCUS)), tuple(LOCUS))
            annotated(spark, f"{root}/g0.parquet", samples[name], lambda f=frame: sinks.write_file(f, f"{root}/g0.parquet"))
        else:
            annotated(spark, f"{root}/g1", samples[name], lambda r=rows: sinks.write_intervals(r, POINTS, LOCUS, f"{root}/g1"))
    return root


def _quarters_and_samples(refs: DataFrame, single: Column, groups: dict[str, Column]) -> tuple[SplitPoints, dict[str, list[str]]]:
    """Loci that cut the rows of single samples into about four equal parts, and the samples of each group; one pass."""
    locus = F.when(single & (F.col("position") >= 0), pack(contig_ordinal(F.col("contig")), F.col("position")))
    found = refs.agg(F.percentile_approx(locus, [0.25, 0.5, 0.75], 1000).alias("q"), *(F.collect_set(F.when(c, F.col("s"))).alias(n) for n, c in groups.items())).first()
    return SplitPoints(Locus.unpack(x) for x in sorted(set(found.q or []))), {n: sorted(found[n]) for n in groups}


def _dataset(spark: SparkSession, d: str) -> Dataset:
    return Dataset.discover(spark, laid_out(spark, d), "locus")


def dataset_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every row of every input table, with the sample that its table or its column names."""
    return _dataset(spark, d).read().select(*COLUMNS)


def dataset_tables(spark: SparkSession, d: str) -> DataFrame:
    """Input tables with their kind, samples (from annotations or names) and rows (from footers); one row a table."""
    ds = _dataset(spark, d)
    return spark.createDataFrame([(t.name, t.kind, len(t.samples), sum(f.rows for f in ds.files(t))) for t in ds.tables], "name string, kind string, samples bigint, n bigint")


def dataset_restricted(spark: SparkSession, d: str) -> DataFrame:
    """Rows by sample of a dataset restricted to g1 and the single samples ending in 1."""
    ds = _dataset(spark, d)
    return ds.restrict_to([t.name for t in ds.tables if t.name == "g1" or t.name.endswith("1")]).read().groupBy("s").agg(F.count("*").alias("n"))


def dataset_interval(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a locus interval; files are pruned by their footers."""
    return _dataset(spark, d).read(INTERVAL).select("contig", "position", "s")


def dataset_within(spark: SparkSession, d: str) -> DataFrame:
    """Rows within bounds of position, DP and sample; files and single-sample tables are pruned by them."""
    return _dataset(spark, d).read(within={"position": (50_000, 90_000), "DP": (10, None), "s": (None, "t")}).select("contig", "position", "DP", "s")


def dataset_reopened(spark: SparkSession, d: str) -> DataFrame:
    """Rows by contig of a dataset rebuilt from its description."""
    return Dataset.reopen(spark, _dataset(spark, d).describe()).read().groupBy("contig").agg(F.count("*").alias("n"))


def dataset_samples(spark: SparkSession, d: str) -> DataFrame:
    """The samples of the annotation tables."""
    ds = _dataset(spark, d)
    found = [(t.name, s) for t in ds.tables if t.kind != "single_sample" for s in read_samples(f"{t.path.removesuffix('.parquet')}.samples.parquet")]
    return spark.createDataFrame(found, "name string, s string")


def dataset_file_order(spark: SparkSession, d: str) -> DataFrame:
    """Files and rows out of order when a table's files are read in the order that their footers show."""
    ds = _dataset(spark, d)
    out = []
    for t in ds.tables:
        if t.kind == "multi_sample_directory":
            files = ds.file_order(t)
            rows = loaded(spark, "parquet", [files[0].path]).coalesce(1)
            for f in files[1:]:
                rows = rows.unionByName(loaded(spark, "parquet", [f.path]).coalesce(1))
            out.append((t.name, order_violations(rows, LOCUS).count(), rows.count()))
    return spark.createDataFrame(out, "name string, violations bigint, n bigint")


def _run(spark: SparkSession, d: str, how: Formulation, name: str) -> tuple[str, MetricsDirectory]:
    root, out = laid_out(spark, d), scratch_path(spark, "run")
    CombinerRun(spark, root, "locus,s", how, Write(f"{out}/{name}", compression="zstd(3)", metrics=f"{out}-metrics", run_id="r1")).execute()
    return f"{out}/{name}", MetricsDirectory(spark, f"{out}-metrics")


def run_written(spark: SparkSession, d: str) -> DataFrame:
    """All rows, read from the one ordered file that a run wrote."""
    path, _ = _run(spark, d, Formulation(), "all.parquet")
    return spark.read.parquet(path).select(*COLUMNS)


def run_record(spark: SparkSession, d: str) -> DataFrame:
    """What the record of a grouped-merge run says."""
    _, directory = _run(spark, d, Formulation("grouped-merge", 2), "all.parquet")
    return directory.read("runs").select("run_id", "status", "formulation", "groups", "row_ordering", "input_format", "compression", "input_tables", "samples", "rows_written", F.col("action").isNull().alias("plain"))


def run_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each file of an interval-merge run."""
    path, _ = _run(spark, d, Formulation("interval-merge", points=POINTS), "intervals")
    name = F.regexp_extract(F.col("_metadata.file_name"), "^([0-9]+)", 1).cast("int")
    return spark.read.parquet(path).groupBy(name.alias("interval_index")).agg(F.count("*").alias("n"))


def run_collected(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred loci and samples, as a run shows them; the limit is the feature."""
    out = CombinerRun(spark, laid_out(spark, d), "locus,s", Formulation(), Collect(100)).execute()
    return spark.createDataFrame(out.table.select(["contig", "position", "s"]))


def run_explained(spark: SparkSession, d: str) -> DataFrame:
    """Exchanges and sorts in a run's plan: one of each."""
    text = CombinerRun(spark, laid_out(spark, d), "locus", Formulation(), Explain()).execute().text
    plan = text.split("\n\n")[0]
    return spark.createDataFrame([(plan.count("Exchange"), plan.count("Sort"))], "exchanges bigint, sorts bigint")


def run_shadowed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a draining sink has seen."""
    return spark.createDataFrame([(sinks.drained(_dataset(spark, d).read()),)], "n bigint")


def order_check_strict(spark: SparkSession, d: str) -> DataFrame:
    """Rows that repeat the locus and sample of the row before, once the table is in order."""
    rows = normalized_contigs(table(spark, d, "refs").select(*COLUMNS)).orderBy(*ascending([*LOCUS, "s"]))
    return order_violations(rows, [*LOCUS, "s"], strict=True).agg(F.count("*").alias("n"))


def metrics_folded(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the runs of each data set, folded by their kind: ends and peaks to the greatest, starts to the least, others to sums."""
    runs = table(spark, d, "run_records").select("dataset_path", F.expr("stack(4, 'startSample', poll_period_ns, 'endWarmup', warmup_end_ns, 'peakMemory', peak_rss_bytes, 'rowsWritten', rows_written) AS (metric, value)"))
    return reports.folded_metrics(runs, ["dataset_path"]).select("dataset_path", "metric", "value")


def metric_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Steady share of the runs' time and rows a byte of peak memory, by data set."""
    runs = table(spark, d, "run_records").select("dataset_path", F.expr("stack(4, 'warmup', warmup_end_ns, 'window', window_end_ns, 'rows', rows_written, 'peak', peak_rss_bytes) AS (metric, value)"))
    found = reports.metric_ratios(runs, ["dataset_path"], {"warmup_share": ("warmup", "window"), "rows_a_byte": ("rows", "peak")})
    return found.select("dataset_path", "ratio", "part", "whole", F.round("value", 9).alias("value"))


def sweep_cells(spark: SparkSession, d: str) -> DataFrame:
    """Runs by cell and state, joined to what their runners saw; every seventh exit counts as bad here."""
    runs = table(spark, d, "run_records").where("run_id LIKE '%-%'").groupBy("run_id").agg(F.max(F.struct("status", "run_ns")).alias("x")).select("run_id", "x.*")
    runs = runs.selectExpr("run_id", "status", "run_ns", "regexp_extract(run_id, '^([^-]+)-', 1) AS cell", "regexp_extract(run_id, '^[^-]+-(.*)$', 1) AS runner")
    runners = runs.selectExpr("runner", "'m' AS machine_type", "2L AS threads_per_core", "1L AS repetition", "array(cell) AS cell_order", "array(named_struct('cell', cell, 'run_id', run_id, 'exit_status', if(run_ns % 7 = 0, 1L, 0L), 'seconds', run_ns / 1e9D)) AS cells", "'done' AS status")
    records = runs.selectExpr("run_id", "status", "1L AS input_tables", "1L AS threads", "1L AS rows_written", "run_ns", "1D AS steady_state_throughput", "1L AS peak_rss_bytes")
    return reports.cells(runners, records).groupBy("cell", "state").agg(F.count("*").alias("n"))


def merge_join_contigs(spark: SparkSession, d: str) -> DataFrame:
    """Rows of refs and of locus_rows by contig ordinal, joined by merging their order."""
    counted = lambda name, n: table(spark, d, name).select(contig_ordinal(F.col("contig")).alias("contig_ordinal")).where("contig_ordinal IS NOT NULL").groupBy("contig_ordinal").agg(F.count("*").alias(n))
    return counted("refs", "blocks").join(counted("locus_rows", "loci").hint("merge"), "contig_ordinal")


SETTINGS = "batch_duration_ns, window_groups, precision, consecutive_checks, min_duration_ns"


def recorded_overview(spark: SparkSession, d: str) -> DataFrame:
    """The overview of settings over what shadow runs recorded of their own settings."""
    runs = table(spark, d, "run_records").where("action = 'shadow' AND batch_duration_ns IS NOT NULL AND window_groups IS NOT NULL").select("run_id", *SETTINGS.split(", "), "would_stop_ns", "would_be_steady_state_throughput", "would_be_relative_half_width", "steady_state_throughput").distinct()
    reason = F.when(F.col("would_stop_ns").isNotNull(), "steady").otherwise("completed")
    ends = runs.groupBy("run_id", "batch_duration_ns", "window_groups").agg(F.max("steady_state_throughput").alias("steady_state_throughput"))
    found = overview(runs.drop("steady_state_throughput").withColumn("probe_stop_reason", reason), ends)
    return found.select(*SETTINGS.split(", "), "runs", "steady", F.round("median_stop_ns", 1).alias("median_stop_ns"), F.round("worst_error", 6).alias("worst_error"), "covered", "intervals", "pareto")


def stops_over_samples(spark: SparkSession, d: str) -> DataFrame:
    """The stopping rule over all progress samples, each taken as a check whose half-width comes from its count of rows."""
    once = table(spark, d, "progress_samples").where("elapsed_ns IS NOT NULL AND rows IS NOT NULL AND run_id IS NOT NULL").groupBy("run_id", "elapsed_ns").agg(F.max("rows").alias("n"))
    checks = once.select("run_id", F.col("elapsed_ns").alias("check_index"), "elapsed_ns", F.when(F.col("n") > 0, F.lit(0).cast("bigint")).alias("warmup_end_ns"), F.expr("(n % 97) / 1000D").alias("relative_half_width"), F.lit(60 * 10**9).cast("bigint").alias("first_partition_end_ns"))
    checks = checks.withColumn("check_index", F.expr("row_number() OVER (PARTITION BY run_id ORDER BY elapsed_ns) - 1").cast("bigint"))
    return stops_over_checks(checks, spark.createDataFrame([(0.05, 1, 0), (0.09, 3, 2 * 10**9), (0.07, 2, 10**9)], "precision double, consecutive_checks bigint, min_duration_ns bigint"))


def interval_join_full(spark: SparkSession, d: str) -> DataFrame:
    """Split points' loci of requests against covered blocks of one contig's sample, with what has no partner on either side."""
    points = table(spark, d, "balance_requests").select(F.col("contig_ordinal").alias("k"), (F.col("intervals").cast("bigint") * 1000).alias("at"), "request_id")
    blocks = table(spark, d, "pack_sizes").selectExpr("explode(sequence(1, 9)) AS k", "cast(capacity_tokens AS bigint) * 4 AS low", "cast(capacity_tokens AS bigint) * 9 AS high")
    return interval_join(points, blocks, ["k"], "at", "low", "high", how="full")


def files_listed(spark: SparkSession, d: str) -> DataFrame:
    """Data files of a dataset by table, listed at any depth."""
    ds = _dataset(spark, d)
    return spark.createDataFrame([(t.name, len(Files(spark).data_files(t.path, ".parquet")) > 0) for t in ds.tables], "name string, has_files boolean")


NAMES = ["dataset_rows", "dataset_tables", "dataset_restricted", "dataset_interval", "dataset_within", "dataset_reopened", "dataset_samples", "dataset_file_order", "run_written", "run_record", "run_intervals", "run_collected", "run_explained", "run_shadowed_rows", "order_check_strict", "metrics_folded", "metric_ratios", "sweep_cells", "merge_join_contigs", "recorded_overview", "stops_over_samples", "interval_join_full", "files_listed"]
QUERIES = {n: globals()[n] for n in NAMES}

REFS = """
WITH r AS (SELECT coalesce(printf('chr%02d', TRY_CAST(regexp_extract(contig, '^chr0*([0-9]+)$', 1) AS INT)), contig) AS contig, position, DP, GQ, "LEN", ploidy, s FROM refs WHERE s IS NOT NULL),
n AS (SELECT *, CASE WHEN right(s, 1) < '5' THEN 's=' || s WHEN right(s, 1) < '7' THEN 'g0' ELSE 'g1' END AS name FROM r)
"""
INDEX = "CASE WHEN contig < 'chr01' OR (contig = 'chr01' AND position < 80000) THEN 0 WHEN contig < 'chr02' OR (contig = 'chr02' AND position < 60000) THEN 1 WHEN contig < 'chr05' OR (contig = 'chr05' AND position < 40000) THEN 2 ELSE 3 END"
_FULL = 'WITH p AS (SELECT contig_ordinal AS k, intervals::BIGINT * 1000 AS "at", request_id FROM balance_requests), b AS (SELECT unnest(generate_series(1, 9))::INT AS k, capacity_tokens::BIGINT * 4 AS low, capacity_tokens::BIGINT * 9 AS high FROM pack_sizes)'
SQL = {
    "dataset_rows": REFS + 'SELECT contig, position, DP, GQ, "LEN", ploidy, s FROM r',
    "dataset_tables": REFS + "SELECT name, CASE name WHEN 'g0' THEN 'multi_sample_file' WHEN 'g1' THEN 'multi_sample_directory' ELSE 'single_sample' END AS kind, count(DISTINCT s)::BIGINT AS samples, count(*)::BIGINT AS n FROM n GROUP BY ALL",
    "dataset_restricted": REFS + "SELECT s, count(*)::BIGINT AS n FROM n WHERE name = 'g1' OR (name NOT IN ('g0', 'g1') AND right(name, 1) = '1') GROUP BY s",
    "dataset_interval": REFS + "SELECT contig, position, s FROM r WHERE (contig > 'chr01' OR (contig = 'chr01' AND position >= 90000)) AND (contig < 'chr03' OR (contig = 'chr03' AND position < 50000))",
    "dataset_within": REFS + "SELECT contig, position, DP, s FROM r WHERE position BETWEEN 50000 AND 90000 AND DP >= 10 AND s <= 't'",
    "dataset_reopened": REFS + "SELECT contig, count(*)::BIGINT AS n FROM r GROUP BY contig",
    "dataset_samples": REFS + "SELECT DISTINCT name, s FROM n WHERE name IN ('g0', 'g1')",
    "dataset_file_order": REFS + "SELECT name, 0::BIGINT AS violations, count(*)::BIGINT AS n FROM n WHERE name = 'g1' GROUP BY name",
    "run_written": REFS + 'SELECT contig, position, DP, GQ, "LEN", ploidy, s FROM r',
    "run_record": REFS + "SELECT 'r1' AS run_id, 'completed' AS status, 'grouped-merge' AS formulation, 2::BIGINT AS groups, 'locus,s' AS row_ordering, 'parquet' AS input_format, 'zstd(3)' AS compression, count(DISTINCT name)::BIGINT AS input_tables, count(DISTINCT s)::BIGINT AS samples, count(*)::BIGINT AS rows_written, TRUE AS plain FROM n",
    "run_intervals": REFS + f"SELECT {INDEX} AS interval_index, count(*)::BIGINT AS n FROM r GROUP BY 1",
    "run_collected": REFS + "SELECT contig, position, s FROM r ORDER BY contig NULLS LAST, position NULLS LAST, s NULLS LAST LIMIT 100",
    "run_explained": "SELECT 1::BIGINT AS exchanges, 1::BIGINT AS sorts",
    "run_shadowed_rows": REFS + "SELECT count(*)::BIGINT AS n FROM r",
    "order_check_strict": """SELECT sum(c - 1)::BIGINT AS n FROM (SELECT count(*) AS c FROM (SELECT coalesce(printf('chr%02d', TRY_CAST(regexp_extract(contig, '^chr0*([0-9]+)$', 1) AS INT)), contig) AS contig, position, s FROM refs) GROUP BY contig, position, s)""",
    "metrics_folded": """WITH m AS (SELECT dataset_path, unnest(['startSample', 'endWarmup', 'peakMemory', 'rowsWritten']) AS metric, unnest([poll_period_ns, warmup_end_ns, peak_rss_bytes, rows_written]) AS value FROM run_records)
 SELECT dataset_path, metric, CASE metric WHEN 'startSample' THEN min(value) WHEN 'rowsWritten' THEN sum(value)::BIGINT ELSE max(value) END AS value FROM m GROUP BY dataset_path, metric""",
    "metric_ratios": """WITH m AS (SELECT dataset_path, sum(warmup_end_ns)::BIGINT AS w, sum(window_end_ns)::BIGINT AS e, sum(rows_written)::BIGINT AS r, sum(peak_rss_bytes)::BIGINT AS p FROM run_records GROUP BY 1),
 x AS (SELECT dataset_path, 'warmup_share' AS ratio, w AS part, e AS whole FROM m UNION ALL SELECT dataset_path, 'rows_a_byte', r, p FROM m)
 SELECT *, round(part::DOUBLE / nullif(whole, 0), 9) AS value FROM x WHERE part IS NOT NULL AND whole IS NOT NULL""",
    "sweep_cells": """WITH r AS (SELECT run_id, max((status, run_ns)) AS x FROM run_records WHERE run_id LIKE '%-%' GROUP BY run_id)
 SELECT regexp_extract(run_id, '^([^-]+)-', 1) AS cell, CASE WHEN x[1] <> 'completed' OR x[2] % 7 = 0 THEN 'failed' ELSE 'ok' END AS state, count(*)::BIGINT AS n FROM r GROUP BY ALL""",
    "merge_join_contigs": """WITH a AS (SELECT TRY_CAST(regexp_extract(contig, '^chr0*([0-9]+)$', 1) AS INT) AS o, count(*) AS n FROM refs GROUP BY 1), b AS (SELECT TRY_CAST(regexp_extract(contig, '^chr0*([0-9]+)$', 1) AS INT) AS o, count(*) AS n FROM locus_rows GROUP BY 1)
 SELECT a.o AS contig_ordinal, a.n::BIGINT AS blocks, b.n::BIGINT AS loci FROM a JOIN b ON a.o = b.o""",
    "recorded_overview": f"""WITH x AS (SELECT DISTINCT run_id, {SETTINGS}, would_stop_ns AS t, would_be_steady_state_throughput AS w, would_be_relative_half_width AS h, steady_state_throughput AS e0 FROM run_records WHERE action = 'shadow' AND batch_duration_ns IS NOT NULL AND window_groups IS NOT NULL),
 e AS (SELECT run_id, batch_duration_ns, window_groups, max(e0) AS e FROM x GROUP BY ALL), y AS (SELECT x.*, e.e, t IS NOT NULL AS st FROM x JOIN e USING (run_id, batch_duration_ns, window_groups)),
 c AS (SELECT {SETTINGS}, count(*)::BIGINT AS runs, count(*) FILTER (st)::BIGINT AS steady, round(quantile_cont(t::DOUBLE, 0.5), 1) AS median_stop_ns, max(CASE WHEN st THEN abs(w / e - 1) END) AS err, count(*) FILTER (st AND h IS NOT NULL AND w * (1 - h) <= e AND e <= w * (1 + h))::BIGINT AS covered, count(*) FILTER (st AND h IS NOT NULL)::BIGINT AS intervals FROM y GROUP BY {SETTINGS})
 SELECT {SETTINGS}, runs, steady, median_stop_ns, round(err, 6) AS worst_error, covered, intervals, median_stop_ns IS NOT NULL AND err IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c o WHERE o.median_stop_ns <= c.median_stop_ns AND o.err <= c.err AND (o.median_stop_ns < c.median_stop_ns OR o.err < c.err)) AS pareto FROM c""",
    "stops_over_samples": """WITH o AS (SELECT run_id, elapsed_ns, max("rows") AS n FROM progress_samples WHERE elapsed_ns IS NOT NULL AND "rows" IS NOT NULL AND run_id IS NOT NULL GROUP BY ALL),
 c AS (SELECT run_id, elapsed_ns, n > 0 AS warm, (n % 97) / 1000.0::DOUBLE AS width, row_number() OVER (PARTITION BY run_id ORDER BY elapsed_ns) - 1 AS i FROM o),
 s(p, k, m) AS (VALUES (0.05::DOUBLE, 1::BIGINT, 0::BIGINT), (0.09, 3, 2000000000), (0.07, 2, 1000000000)),
 e AS (SELECT *, coalesce(max(CASE WHEN NOT (warm AND width < p) THEN i END) OVER (PARTITION BY run_id, p, k, m ORDER BY i), -1) AS failed FROM c, s)
 SELECT run_id, p AS precision, k AS consecutive_checks, m AS min_duration_ns, min(CASE WHEN i - failed >= k AND elapsed_ns >= m AND elapsed_ns < 60000000000 THEN elapsed_ns END) AS would_stop_ns FROM e GROUP BY ALL""",
    "interval_join_full": _FULL + ' SELECT coalesce(p.k, b.k) AS k, "at", request_id, low, high FROM p FULL JOIN b ON p.k = b.k AND "at" BETWEEN low AND high',
    "files_listed": REFS + "SELECT DISTINCT name, TRUE AS has_files FROM n",
}
