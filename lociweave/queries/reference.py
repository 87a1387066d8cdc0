"""Queries of the combiner, ordering, throughput and report operators over the whole test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.locus import Locus, LocusInterval, SplitPoints, contig_name, contig_ordinal, named_contig, pack, packed_ordinal, packed_position
from ..operators import combine, reports
from ..operators.joins import interval_join
from ..operators.replay import Grid, calibration, overview, pareto, replay, shadow_series, stops_over_checks
from ..operators.running import numbered
from ..operators.split_points import row_balanced
from ..operators.throughput import t_975
from ..plans.ordering import OrderedFrame, held, order_violations
from ..sources.conversions import defined_counts, normalized_contigs, scaled
from ..sources.generators import grouped_counts, range_table
from ..session import table
from ..streaming.progress import event_rates, judged

POINTS = SplitPoints.parse("1:80000,2:60000,5:40000")
INTERVAL = LocusInterval(Locus.parse("1:90000"), Locus.parse("3:50000"))
REF_COLUMNS = ["contig", "position", "DP", "GQ", "LEN", "ploidy", "s"]
ORDER = ["contig", "position", "s"]


def _refs(spark: SparkSession, d: str) -> DataFrame:
    return normalized_contigs(table(spark, d, "refs").select(*REF_COLUMNS))


def _tables(spark: SparkSession, d: str) -> list[DataFrame]:
    """Four input tables: the samples whose names end in 0-2, 3-5, 6-7 and 8-9."""
    refs = _refs(spark, d)
    return [refs.where(F.substring("s", -1, 1).isin(list(x))) for x in ("012", "345", "67", "89")]


def combine_refs_union(spark: SparkSession, d: str) -> DataFrame:
    frame = combine.combine_union(_tables(spark, d), ORDER)
    return held(frame.df, list(frame.ordering))


def combine_refs_grouped(spark: SparkSession, d: str) -> DataFrame:
    return combine.combine_grouped(_tables(spark, d), ORDER, 3, group_column="group_index").df


def combine_refs_interval(spark: SparkSession, d: str) -> DataFrame:
    return combine.combine_intervals(_tables(spark, d), ORDER, POINTS).df


def interval_row_counts(spark: SparkSession, d: str) -> DataFrame:
    return combine.combine_intervals(_tables(spark, d), ORDER, POINTS).df.groupBy("interval_index").agg(F.count("*").alias("n"))


def combine_alleles(spark: SparkSession, d: str) -> DataFrame:
    frame: OrderedFrame = combine.combine_alleles([table(spark, d, "stored_rows")], ["locus"])
    return frame.df


def locus_pack(spark: SparkSession, d: str) -> DataFrame:
    loci = table(spark, d, "locus_rows").select("contig", "position", pack(contig_ordinal(F.col("contig")), F.col("position")).alias("locus"))
    return loci.where("locus IS NOT NULL")


def locus_unpack(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "stored_rows")
    return rows.select(contig_name(packed_ordinal(F.col("locus"))).alias("contig"), packed_position(F.col("locus")).alias("position"), "s")


def locus_filter_contig_position(spark: SparkSession, d: str) -> DataFrame:
    """Rows of INTERVAL. Its ordinals are asked of the raw names first, in a form that the scan takes."""
    raw = table(spark, d, "refs").select(*REF_COLUMNS).where(named_contig(F.col("contig"), range(INTERVAL.low.ordinal, INTERVAL.high.ordinal + 1)))
    return normalized_contigs(raw).where(INTERVAL.predicate(contig=F.col("contig"), position=F.col("position"))).select("contig", "position", "s")


def locus_filter_packed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stored_rows").where(INTERVAL.predicate(packed=F.col("locus"))).select("locus", "alleles", "s")


def contig_filter(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "refs").where(named_contig(F.col("contig"), range(3, 4)))
    return normalized_contigs(raw.select("contig", "position", "s", "LEN"))


def row_balanced_split_points(spark: SparkSession, d: str) -> DataFrame:
    loci = table(spark, d, "refs").select(contig_ordinal(F.col("contig")).alias("contig_ordinal"), "position").where("contig_ordinal IS NOT NULL")
    return row_balanced(loci, ["contig_ordinal", "position"], 8)


def row_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Row numbers of the whole table in order, without a single-partition window."""
    return numbered(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [], ["o_totalprice", "o_orderkey"])


def sample_set(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "refs").select("s").distinct()


def sample_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Samples that records of more than one input table of a data set name."""
    files = table(spark, d, "stored_files").select("path", "dataset", "input_table").distinct()
    rows = table(spark, d, "stored_rows").groupBy("path", "s").agg(F.count("*").alias("n"))
    return rows.join(files, "path").groupBy("dataset", "s").agg(F.count_distinct("input_table").alias("tables"), F.sum("n").alias("n")).where("tables > 1")


def sample_tables(spark: SparkSession, d: str) -> DataFrame:
    """Samples and records of each input table that has stored records."""
    files = table(spark, d, "stored_files").select("path", "dataset", "input_table").distinct()
    rows = table(spark, d, "stored_rows").groupBy("path", "s").agg(F.count("*").alias("n"))
    return rows.join(files, "path").groupBy("dataset", "input_table").agg(F.count_distinct("s").alias("samples"), F.sum("n").alias("n"))


def incomplete_tables(spark: SparkSession, d: str) -> DataFrame:
    """Multi-sample input tables without a sample annotation table."""
    files = table(spark, d, "stored_files").where("kind <> 'single_sample'")
    return files.groupBy("dataset", "input_table").agg(F.bool_or(F.col("path").rlike(r"\.samples\.parquet$")).alias("annotated")).where("NOT annotated").select("dataset", "input_table")


def restrict_inputs(spark: SparkSession, d: str) -> DataFrame:
    frames = _tables(spark, d)
    return combine.union([frames[0], frames[2]]).groupBy("s").agg(F.count("*").alias("n"))


def refs_topk(spark: SparkSession, d: str) -> DataFrame:
    return combine.combine_union(_tables(spark, d), REF_COLUMNS).limit(100).df


def range_group_count(spark: SparkSession, d: str) -> DataFrame:
    return grouped_counts(range_table(spark, 1 << 18))


def range_join(spark: SparkSession, d: str) -> DataFrame:
    return range_table(spark, 1_000_000).join(range_table(spark, 1000, "idx2"), F.col("idx") == F.col("idx2"), "inner")


def membership_semi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "progress_samples").join(table(spark, d, "run_records").select("run_id"), "run_id", "left_semi").select("run_id", "sample_index", "elapsed_ns")


def membership_anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "progress_samples").join(table(spark, d, "run_records").select("run_id"), "run_id", "left_anti").select("run_id", "sample_index", "elapsed_ns")


def interval_join_loci(spark: SparkSession, d: str) -> DataFrame:
    """Rows of locus_rows that some reference block covers."""
    points = table(spark, d, "locus_rows").select(contig_ordinal(F.col("contig")).alias("contig_ordinal"), "position").where("contig_ordinal IS NOT NULL")
    blocks = table(spark, d, "refs").where("LEN > 0").select(contig_ordinal(F.col("contig")).alias("contig_ordinal"), F.col("position").alias("low"), (F.col("position").cast("bigint") + F.col("LEN") - 1).alias("high"))
    return interval_join(points, blocks, ["contig_ordinal"], "position", "low", "high", how="left_semi")


def explode_alleles(spark: SparkSession, d: str) -> DataFrame:
    return combine.explode_alleles(table(spark, d, "stored_rows").select("locus", "s", "alleles"))


def entries_defined_counts(spark: SparkSession, d: str) -> DataFrame:
    return defined_counts(table(spark, d, "refs"), ["s"], ["DP", "GQ", "LEN"])


def scaled_contigs(spark: SparkSession, d: str) -> DataFrame:
    return scaled(_refs(spark, d).select("contig", "position", "s"), 3).groupBy("contig").agg(F.count("*").alias("n"))


def sample_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rows a second between neighbouring progress samples of a run."""
    from pyspark.sql import Window

    once = table(spark, d, "progress_samples").groupBy("run_id", "elapsed_ns").agg(F.max("rows").alias("n"))
    w = Window.partitionBy("run_id").orderBy("elapsed_ns")
    gained, took = F.greatest(F.col("n") - F.lag("n").over(w), F.lit(0)), F.col("elapsed_ns") - F.lag("elapsed_ns").over(w)
    return once.select("run_id", "elapsed_ns", F.round(gained / (took / 1e9), 3).alias("rate")).where("rate IS NOT NULL")


def _shadow(spark: SparkSession, d: str) -> DataFrame:
    return shadow_series(table(spark, d, "run_records"), table(spark, d, "progress_samples"))


def tightness_checks(spark: SparkSession, d: str) -> DataFrame:
    """The checks of every run under all sixteen pairs of batch duration and window groups (less those below its poll period)."""
    found = replay(_shadow(spark, d), "checks")
    return found.withColumns({"steady_state_throughput": F.round("steady_state_throughput", 3), "relative_half_width": F.round("relative_half_width", 6)})


def replay_baselines(spark: SparkSession, d: str) -> DataFrame:
    """What each run shows at its end under every pair, and when it would have been capped."""
    found = replay(_shadow(spark, d), "baselines")
    return found.withColumns({"steady_state_throughput": F.round("steady_state_throughput", 3), "relative_half_width": F.round("relative_half_width", 6)})


def replay_stops(spark: SparkSession, d: str) -> DataFrame:
    """When each run would have stopped under each of the 576 settings."""
    found = replay(_shadow(spark, d), "replays")
    return found.withColumns({"would_be_steady_state_throughput": F.round("would_be_steady_state_throughput", 3), "would_be_relative_half_width": F.round("would_be_relative_half_width", 6)})


def settings_overview(spark: SparkSession, d: str) -> DataFrame:
    """Runs, stops, errors and coverage of each of the 576 settings."""
    shadow = _shadow(spark, d)
    return overview(replay(shadow, "replays"), replay(shadow, "baselines")).withColumn("worst_error", F.round("worst_error", 6))


def replay_grid(spark: SparkSession, d: str) -> DataFrame:
    """The 576 settings that a replay judges runs under."""
    g = Grid()
    axes = {"batch_duration_ns": ("bigint", g.batch_durations_ns), "window_groups": ("bigint", g.window_groups), "precision": ("double", g.precisions), "consecutive_checks": ("bigint", g.consecutive_checks), "min_duration_ns": ("bigint", g.min_durations_ns)}
    out = spark.range(1)
    for name, (kind, values) in axes.items():
        out = out.withColumn(name, F.explode(F.array(*(F.lit(v).cast(kind) for v in values))))
    return out.drop("id")


#: Checks of three runs (check_index, half-width in thousandths or None) for stop_over_checks; a check a second, warm from the second on.
CHECKS = {"even": [30, 15, 12, 11, 9, 8, 30, 7], "gaps": [None, 12, None, 9, 9, 9, 9, 9], "late": [50, 40, 30, 25, 19, 19, 19, 25]}
ENDS = {"even": None, "gaps": 7_000_000_000, "late": 7_000_000_000}
STOP_SETTINGS = [(0.01, 1, 0), (0.02, 1, 0), (0.02, 3, 0), (0.02, 3, 6_000_000_000), (0.05, 5, 0)]


def stop_over_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = [(run, i, (i + 1) * 10**9, None if i == 0 else 10**9, None if w is None else w / 1000, ENDS[run]) for run, ws in CHECKS.items() for i, w in enumerate(ws)]
    checks = spark.createDataFrame(rows, "run_id string, check_index bigint, elapsed_ns bigint, warmup_end_ns bigint, relative_half_width double, first_partition_end_ns bigint")
    return stops_over_checks(checks, spark.createDataFrame(STOP_SETTINGS, "precision double, consecutive_checks bigint, min_duration_ns bigint"))


def probe_stop_reason(spark: SparkSession, d: str) -> DataFrame:
    """How each shadow record would have ended as a probe."""
    end, stop, cap = F.col("first_partition_end_ns"), F.col("would_stop_ns"), F.when(F.col("window_end_ns") >= F.col("max_duration_ns"), F.col("max_duration_ns"))
    reason = F.when(stop.isNotNull() & (cap.isNull() | (stop <= cap)), "steady").when(cap.isNotNull() & (end.isNull() | (cap < end)), "capped").otherwise("completed")
    return table(spark, d, "run_records").where("action = 'shadow'").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def normalized_throughput(spark: SparkSession, d: str) -> DataFrame:
    found = reports.run_throughput(table(spark, d, "run_records"))
    return found.select("run_id", F.round("whole_run", 3).alias("whole_run"), F.round("whole_run_normalized", 3).alias("whole_run_normalized"), F.round("steady_state_normalized", 3).alias("steady_state_normalized"))


def sweep_report(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "run_records").where("status = 'completed' AND run_ns > 0 AND input_tables > 0")
    out = reports.sweep(runs, ["formulation", "threads"])
    return out.select("formulation", "threads", "n", *(F.round(c, 4).alias(c) for c in ("whole_run", "whole_run_half_range", "steady_state", "steady_over_whole")), "peak_rss_bytes")


def calibration_errors(spark: SparkSession, d: str) -> DataFrame:
    found = calibration(table(spark, d, "run_records"))
    return found.select("run_id", "settled", *(F.round(c, 6).alias(c) for c in ("error", "low", "high")), "covers")


def pareto_datasets(spark: SparkSession, d: str) -> DataFrame:
    """Data sets on the frontier of shortest run and least peak memory."""
    by = table(spark, d, "run_records").groupBy("dataset_path").agg(F.min("run_ns").alias("least_ns"), F.min("peak_rss_bytes").alias("least_rss"))
    return pareto(by, "least_ns", "least_rss")


def run_status_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "run_records").groupBy("status", "action").agg(F.count("*").alias("n"), F.min(F.unix_micros("started_at")).alias("first_us"), F.max(F.unix_micros("started_at")).alias("last_us"), F.coalesce(F.sum("rows_written"), F.lit(0)).alias("rows_written"))


def order_check_violations(spark: SparkSession, d: str) -> DataFrame:
    """The stored order of refs held against (locus, s); rows depend on how the table is split."""
    return order_violations(table(spark, d, "refs"), ORDER)


def order_check_sorted(spark: SparkSession, d: str) -> DataFrame:
    """None, after the combiner has put the rows in order."""
    return order_violations(combine_refs_union(spark, d), ORDER)


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return event_rates(table(spark, d, "events"), "ts", "1 hour", "10 minutes", "event_type")


def streamed_stops(spark: SparkSession, d: str) -> DataFrame:
    """Progress samples of all runs read as a stream and judged run by run as they arrive."""
    from ..session import scratch_path

    samples = spark.readStream.schema(table(spark, d, "progress_samples").schema).parquet(f"{d}/progress_samples.parque[t]")
    found = judged(samples.where("elapsed_ns IS NOT NULL AND rows IS NOT NULL").select("run_id", "elapsed_ns", F.col("rows").alias("rows_total")))
    out = scratch_path(spark, "stops")
    run = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(found.schema).parquet(out).withColumn("steady_state_throughput", F.round("steady_state_throughput", 3))


NAMES = ["combine_refs_union", "combine_refs_grouped", "combine_refs_interval", "interval_row_counts", "combine_alleles", "locus_pack", "locus_unpack", "locus_filter_contig_position", "locus_filter_packed", "contig_filter", "row_balanced_split_points", "row_numbers", "sample_set", "sample_overlap", "sample_tables", "incomplete_tables", "restrict_inputs", "refs_topk", "range_group_count", "range_join", "membership_semi", "membership_anti", "interval_join_loci", "explode_alleles", "entries_defined_counts", "scaled_contigs", "sample_rates", "tightness_checks", "replay_baselines", "replay_stops", "settings_overview", "replay_grid", "stop_over_checks", "probe_stop_reason", "normalized_throughput", "sweep_report", "calibration_errors", "pareto_datasets", "run_status_summary", "order_check_violations", "order_check_sorted", "event_windows", "streamed_stops"]
QUERIES = {n: globals()[n] for n in NAMES}

REFS = """
WITH r AS (SELECT coalesce(printf('chr%02d', TRY_CAST(regexp_extract(contig, '^chr0*([0-9]+)$', 1) AS INT)), contig) AS contig, position, DP, GQ, "LEN", ploidy, s FROM refs)
"""
INDEX = "CASE WHEN contig < 'chr01' OR (contig = 'chr01' AND position < 80000) THEN 0 WHEN contig < 'chr02' OR (contig = 'chr02' AND position < 60000) THEN 1 WHEN contig < 'chr05' OR (contig = 'chr05' AND position < 40000) THEN 2 ELSE 3 END"
ORDINAL = "TRY_CAST(regexp_extract(contig, '^chr0*([0-9]+)$', 1) AS INT)"
DONE = "status = 'completed' AND run_ns > 0 AND input_tables > 0 AND threads > 0"
_W = "(rows_written / (run_ns / 1e9))"
_CHECKS = ", ".join(f"('{run}', {i}, {(i + 1) * 10**9}, {'NULL' if i == 0 else 10**9}, {'NULL' if w is None else w / 1000}, {ENDS[run] or 'NULL'})" for run, ws in CHECKS.items() for i, w in enumerate(ws))
_SETTINGS = ", ".join(str(x) for x in STOP_SETTINGS)
#: The rule in SQL: batch ends by recursion, every tail of every check's rates, parts snapped to the nearest sample.
RULE = f"""WITH RECURSIVE l AS (SELECT run_id, arg_max(coalesce(poll_period_ns, 100000000), started_at) AS poll, arg_max(coalesce(max_duration_ns, 300000000000), started_at) AS longest, arg_max(coalesce(first_partition_end_ns, -1), started_at) AS ended FROM run_records WHERE action = 'shadow' GROUP BY run_id),
 s AS (SELECT run_id, elapsed_ns AS t, max("rows") AS n, row_number() OVER (PARTITION BY run_id ORDER BY elapsed_ns) - 1 AS i FROM progress_samples SEMI JOIN l USING (run_id) WHERE elapsed_ns IS NOT NULL AND "rows" IS NOT NULL GROUP BY run_id, elapsed_ns),
 z AS (SELECT run_id, min(t) AS t FROM s GROUP BY run_id), b(d) AS (VALUES (500000000::BIGINT), (1000000000), (2000000000), (5000000000)),
 e AS (SELECT run_id, d, t, 0 AS k FROM z JOIN l USING (run_id), b WHERE d >= poll UNION ALL
       SELECT e.run_id, e.d, s.t, e.k + 1 FROM e JOIN s ON s.run_id = e.run_id AND s.t >= e.t + e.d QUALIFY row_number() OVER (PARTITION BY e.run_id, e.d ORDER BY s.t) = 1),
 x AS (SELECT e.run_id, d, k, e.t, s.n, s.i, lag(e.t) OVER w AS t0, lag(s.n) OVER w AS n0 FROM e JOIN s ON s.run_id = e.run_id AND s.t = e.t WINDOW w AS (PARTITION BY e.run_id, d ORDER BY k)),
 r AS (SELECT run_id, d, k, greatest(n - n0, 0) / ((t - t0) / 1e9) AS rate FROM x WHERE k > 0),
 v AS (SELECT c.run_id, c.d, c.k, a.k - 1 AS cut, var_pop(r.rate) / count(*) AS err FROM r c JOIN r a ON a.run_id = c.run_id AND a.d = c.d AND a.k <= c.k - 4 JOIN r ON r.run_id = c.run_id AND r.d = c.d AND r.k BETWEEN a.k AND c.k GROUP BY ALL),
 m AS (SELECT run_id, d, k, arg_min(cut, (err, cut)) AS cut FROM v GROUP BY ALL),
 g AS (SELECT c.run_id, c.d, c.k, c.t, c.i, c.n, CASE WHEN 2 * m.cut <= c.k THEN m.cut END AS cut FROM x c LEFT JOIN m USING (run_id, d, k) WHERE c.k > 0),
 o AS (SELECT g.*, a.t AS t1, a.n AS n1, a.i AS i1 FROM g JOIN x a ON a.run_id = g.run_id AND a.d = g.d AND a.k = coalesce(g.cut, 0)),
 q(q, tt) AS (VALUES {", ".join(f"({n}, {t_975(n - 1)!r}::DOUBLE)" for n in Grid().window_groups)}),
 p AS (SELECT run_id, d, k, q, tt, h, t1 + (t - t1) * h // q AS aim FROM o, q, (SELECT unnest(generate_series(0, 40)) AS h) WHERE h <= q AND q <= i - i1),
 f AS (SELECT p.*, s.t AS lt, s.n AS ln FROM p ASOF JOIN s ON s.run_id = p.run_id AND s.t <= p.aim),
 y AS (SELECT f.*, s.t AS rt, s.n AS rn FROM f ASOF JOIN s ON s.run_id = f.run_id AND s.t >= f.aim),
 u AS (SELECT run_id, d, k, q, tt, h, CASE WHEN rt - aim < aim - lt THEN rt ELSE lt END AS t, CASE WHEN rt - aim < aim - lt THEN rn ELSE ln END AS n FROM y),
 j AS (SELECT *, t - lag(t) OVER w AS ns, greatest(n - lag(n) OVER w, 0) AS grown FROM u WINDOW w AS (PARTITION BY run_id, d, k, q ORDER BY h)),
 w AS (SELECT run_id, d, k, q, any_value(tt) AS tt, min(ns) AS least, avg(grown / (ns / 1e9)) AS mean, var_samp(grown / (ns / 1e9)) AS var FROM j WHERE h > 0 GROUP BY ALL),
 c AS (SELECT o.run_id, o.d, q.q, o.k - 1 AS check_index, o.i, o.t, CASE WHEN cut IS NOT NULL THEN t1 END AS warm, CASE WHEN o.t > t1 THEN greatest(o.n - n1, 0) / ((o.t - t1) / 1e9) END AS rate, CASE WHEN least > 0 AND mean > 0 THEN w.tt * sqrt(var / q.q) / mean END AS width FROM o CROSS JOIN q LEFT JOIN w ON w.run_id = o.run_id AND w.d = o.d AND w.k = o.k AND w.q = q.q)
"""
STOPS = RULE + """, cap AS (SELECT s.run_id, min(t) AS cap FROM s JOIN l USING (run_id) WHERE t >= longest GROUP BY 1),
 sets AS (SELECT a.p, b.c, e.m FROM (VALUES (0.01::DOUBLE), (0.02), (0.05)) a(p), (VALUES (1::BIGINT), (3), (5), (10)) b(c), (VALUES (10000000000::BIGINT), (20000000000), (60000000000)) e(m)),
 k AS (SELECT c.*, l.ended FROM c JOIN l USING (run_id) WHERE l.ended < 0 OR t < l.ended),
 pr AS (SELECT k.*, p, coalesce(max(CASE WHEN NOT coalesce(warm IS NOT NULL AND width < p, FALSE) THEN check_index END) OVER (PARTITION BY run_id, d, q, p ORDER BY check_index), -1) AS failed FROM k, (SELECT DISTINCT p FROM sets)),
 hit AS (SELECT run_id, d, q, pr.p, sets.c, m, min(check_index) AS check_index FROM pr JOIN sets ON sets.p = pr.p WHERE check_index - failed >= sets.c AND t >= m GROUP BY ALL),
 every AS (SELECT l.run_id, b.d, q.q, sets.p, sets.c, sets.m, ended FROM l SEMI JOIN s USING (run_id), b, q, sets WHERE b.d >= poll)
 SELECT v.run_id, v.d AS batch_duration_ns, v.q::BIGINT AS window_groups, v.p AS precision, v.c AS consecutive_checks, v.m AS min_duration_ns, c.t AS would_stop_ns, round(c.rate, 3) AS would_be_steady_state_throughput, round(c.width, 6) AS would_be_relative_half_width, c.warm AS would_be_warmup_end_ns,
  CASE WHEN c.t IS NOT NULL AND (cap IS NULL OR c.t <= cap) THEN 'steady' WHEN cap IS NOT NULL AND (v.ended < 0 OR cap < v.ended) THEN 'capped' ELSE 'completed' END AS probe_stop_reason
 FROM every v LEFT JOIN cap USING (run_id) LEFT JOIN hit h ON h.run_id = v.run_id AND h.d = v.d AND h.q = v.q AND h.p = v.p AND h.c = v.c AND h.m = v.m LEFT JOIN c ON c.run_id = h.run_id AND c.d = h.d AND c.q = h.q AND c.check_index = h.check_index"""
ENDS_SQL = RULE + """, at_end AS (SELECT s.run_id, max(t) AS t, max(i) AS i, arg_max(n, t) AS n FROM s JOIN l USING (run_id) WHERE l.ended < 0 OR t <= l.ended GROUP BY s.run_id),
 kmax AS (SELECT a.run_id, b.d, coalesce(max(x.k), 0) AS k FROM at_end a JOIN l USING (run_id) JOIN b ON b.d >= l.poll LEFT JOIN x ON x.run_id = a.run_id AND x.d = b.d AND x.t <= a.t GROUP BY ALL),
 bs AS (SELECT kmax.run_id, kmax.d, kmax.k, CASE WHEN 2 * m.cut <= kmax.k THEN m.cut END AS cut FROM kmax LEFT JOIN m ON m.run_id = kmax.run_id AND m.d = kmax.d AND m.k = kmax.k),
 bo AS (SELECT bs.run_id, bs.d, bs.k, bs.cut, a.t, a.n, a.i, x.t AS t1, x.n AS n1, x.i AS i1 FROM bs JOIN at_end a USING (run_id) JOIN x ON x.run_id = bs.run_id AND x.d = bs.d AND x.k = coalesce(bs.cut, 0)),
 bp AS (SELECT run_id, d, q, tt, h, t1 + (t - t1) * h // q AS aim FROM bo, q, (SELECT unnest(generate_series(0, 40)) AS h) WHERE h <= q AND q <= i - i1),
 bf AS (SELECT bp.*, s.t AS lt, s.n AS ln FROM bp ASOF JOIN s ON s.run_id = bp.run_id AND s.t <= bp.aim),
 bw AS (SELECT bf.*, s.t AS rt, s.n AS rn FROM bf ASOF JOIN s ON s.run_id = bf.run_id AND s.t >= bf.aim),
 bu AS (SELECT run_id, d, q, tt, h, CASE WHEN rt - aim < aim - lt THEN rt ELSE lt END AS t, CASE WHEN rt - aim < aim - lt THEN rn ELSE ln END AS n FROM bw),
 bj AS (SELECT *, t - lag(t) OVER w AS ns, greatest(n - lag(n) OVER w, 0) AS grown FROM bu WINDOW w AS (PARTITION BY run_id, d, q ORDER BY h)),
 bv AS (SELECT run_id, d, q, any_value(tt) AS tt, min(ns) AS least, avg(grown / (ns / 1e9)) AS mean, var_samp(grown / (ns / 1e9)) AS var FROM bj WHERE h > 0 GROUP BY ALL),
 own AS (SELECT run_id, arg_max(coalesce("precision", 0.02), started_at) AS p, arg_max(coalesce(consecutive_checks, 3), started_at) AS c, arg_max(coalesce(min_duration_ns, 20000000000), started_at) AS m FROM run_records WHERE action = 'shadow' GROUP BY run_id),
 streak AS (SELECT c.run_id, c.d, c.q, c.check_index, c.i, c.check_index - coalesce(max(CASE WHEN NOT coalesce(warm IS NOT NULL AND width < p, FALSE) THEN check_index END) OVER (PARTITION BY c.run_id, d, q ORDER BY check_index), -1) AS run FROM c JOIN own USING (run_id)),
 ends AS (SELECT bo.*, q.q, l.ended, l.longest, CASE WHEN bo.t > t1 THEN greatest(bo.n - n1, 0) / ((bo.t - t1) / 1e9) END AS rate, CASE WHEN least > 0 AND mean > 0 THEN bv.tt * sqrt(var / q.q) / mean END AS width,
   l.ended >= 0 OR bo.t >= l.longest OR coalesce(streak.run >= own.c AND bo.t >= own.m AND streak.i = bo.i, FALSE) AS decided
  FROM bo CROSS JOIN q JOIN l USING (run_id) JOIN own USING (run_id) LEFT JOIN bv ON bv.run_id = bo.run_id AND bv.d = bo.d AND bv.q = q.q LEFT JOIN streak ON streak.run_id = bo.run_id AND streak.d = bo.d AND streak.q = q.q AND streak.check_index = bo.k - 1),
 cap0 AS (SELECT s.run_id, min(t) AS cap FROM s JOIN l USING (run_id) WHERE t >= longest GROUP BY 1),
 pairs AS (SELECT DISTINCT l.run_id, b.d, q.q FROM l SEMI JOIN s USING (run_id), b, q WHERE b.d >= poll),
 baselines AS (SELECT p.run_id, p.d, p.q, CASE WHEN decided THEN rate END AS rate, CASE WHEN decided THEN width END AS width, CASE WHEN decided AND cut IS NOT NULL THEN t1 END AS warm, CASE WHEN decided THEN e.t END AS t, cap FROM pairs p LEFT JOIN ends e ON e.run_id = p.run_id AND e.d = p.d AND e.q = p.q LEFT JOIN cap0 ON cap0.run_id = p.run_id)
"""
OVERVIEW = ENDS_SQL + ", replays AS (" + STOPS.removeprefix(RULE).replace(", cap AS (", "WITH cap AS (", 1).replace("round(c.rate, 3)", "c.rate").replace("round(c.width, 6)", "c.width") + """),
 joined AS (SELECT r.*, e.rate AS fin, probe_stop_reason = 'steady' AS st, would_be_steady_state_throughput AS wt, would_be_relative_half_width AS wh FROM replays r JOIN baselines e ON e.run_id = r.run_id AND e.d = r.batch_duration_ns AND e.q = r.window_groups),
 combos AS (SELECT batch_duration_ns, window_groups, precision, consecutive_checks, min_duration_ns, count(*)::BIGINT AS runs, count(*) FILTER (st)::BIGINT AS steady, quantile_cont(CASE WHEN st THEN would_stop_ns::DOUBLE END, 0.5) AS median_stop_ns, max(CASE WHEN st THEN abs(wt / fin - 1) END) AS err,
   count(*) FILTER (st AND wh IS NOT NULL AND wt * (1 - wh) <= fin AND fin <= wt * (1 + wh))::BIGINT AS covered, count(*) FILTER (st AND wh IS NOT NULL)::BIGINT AS intervals FROM joined GROUP BY 1, 2, 3, 4, 5)
 SELECT c.* EXCLUDE (err), round(err, 6) AS worst_error, median_stop_ns IS NOT NULL AND err IS NOT NULL AND NOT EXISTS (SELECT 1 FROM combos o WHERE o.median_stop_ns <= c.median_stop_ns AND o.err <= c.err AND (o.median_stop_ns < c.median_stop_ns OR o.err < c.err)) AS pareto FROM combos c"""
#: The rule over all runs of the stream under the usual settings: the first of samples at one time counts, and stops are
#: sought at batch ends of a second. Runs of these tables end long before the cap.
STREAMED = RULE.replace("l AS (SELECT run_id, arg_max(coalesce(poll_period_ns, 100000000), started_at) AS poll, arg_max(coalesce(max_duration_ns, 300000000000), started_at) AS longest, arg_max(coalesce(first_partition_end_ns, -1), started_at) AS ended FROM run_records WHERE action = 'shadow' GROUP BY run_id)", "l AS (SELECT DISTINCT run_id, 1000000000 AS poll FROM progress_samples)").replace('max("rows") AS n', 'min("rows") AS n') + """, k AS (SELECT *, check_index - coalesce(max(CASE WHEN NOT coalesce(warm IS NOT NULL AND width < 0.02, FALSE) THEN check_index END) OVER (PARTITION BY run_id ORDER BY check_index), -1) AS run FROM c WHERE d = 1000000000 AND q = 10)
 SELECT run_id, 'steady' AS stop_reason, t AS stopped_at_ns, round(rate, 3) AS steady_state_throughput, warm AS warmup_end_ns, i + 1 AS samples FROM k WHERE run >= 3 AND t >= 20000000000 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY t) = 1"""
SQL = {
    "tightness_checks": RULE + "SELECT run_id, d AS batch_duration_ns, q::BIGINT AS window_groups, check_index::BIGINT AS check_index, i AS sample_index, t AS elapsed_ns, warm AS warmup_end_ns, round(rate, 3) AS steady_state_throughput, round(width, 6) AS relative_half_width FROM c",
    "replay_stops": STOPS,
    "replay_baselines": ENDS_SQL + "SELECT run_id, d AS batch_duration_ns, q::BIGINT AS window_groups, round(rate, 3) AS steady_state_throughput, round(width, 6) AS relative_half_width, warm AS warmup_end_ns, t AS window_end_ns, cap AS capped_at_ns FROM baselines",
    "settings_overview": OVERVIEW,
    "streamed_stops": STREAMED,
    "combine_refs_union": REFS + "SELECT * FROM r",
    "combine_refs_grouped": REFS + "SELECT *, CASE WHEN right(s, 1) IN ('0','1','2','3','4','5') THEN 0 WHEN right(s, 1) IN ('6','7') THEN 1 ELSE 2 END AS group_index FROM r",
    "combine_refs_interval": REFS + f"SELECT *, {INDEX} AS interval_index FROM r",
    "interval_row_counts": REFS + f"SELECT {INDEX} AS interval_index, count(*)::BIGINT AS n FROM r GROUP BY 1",
    "combine_alleles": "SELECT locus, alleles, rank() OVER (PARTITION BY locus ORDER BY alleles) AS rank FROM (SELECT DISTINCT locus, alleles FROM stored_rows)",
    "locus_pack": f"SELECT contig, position, ({ORDINAL}::BIGINT << 32) | position AS locus FROM locus_rows WHERE {ORDINAL} IS NOT NULL",
    "locus_unpack": "SELECT printf('chr%02d', locus >> 32) AS contig, (locus & 4294967295)::INT AS position, s FROM stored_rows",
    "locus_filter_contig_position": REFS + "SELECT contig, position, s FROM r WHERE (contig > 'chr01' OR (contig = 'chr01' AND position >= 90000)) AND (contig < 'chr03' OR (contig = 'chr03' AND position < 50000))",
    "locus_filter_packed": "SELECT locus, alleles, s FROM stored_rows WHERE locus >= (1::BIGINT << 32) + 90000 AND locus < (3::BIGINT << 32) + 50000",
    "contig_filter": REFS + """SELECT contig, position, s, "LEN" FROM r WHERE contig = 'chr03'""",
    "row_balanced_split_points": f"""WITH l AS (SELECT {ORDINAL} AS contig_ordinal, position FROM refs), o AS (SELECT *, row_number() OVER (ORDER BY contig_ordinal, position) AS i, count(*) OVER () AS n FROM l WHERE contig_ordinal IS NOT NULL)
 SELECT k::INT AS k, contig_ordinal, position FROM o JOIN (SELECT unnest(generate_series(1, 7)) AS k) ON i = (k * n) // 8 + 1""",
    "row_numbers": "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_number FROM orders",
    "sample_set": "SELECT DISTINCT s FROM refs",
    "sample_overlap": "SELECT dataset, s, count(DISTINCT input_table)::BIGINT AS tables, sum(n)::BIGINT AS n FROM (SELECT path, s, count(*) AS n FROM stored_rows GROUP BY ALL) JOIN (SELECT DISTINCT path, dataset, input_table FROM stored_files) USING (path) GROUP BY ALL HAVING count(DISTINCT input_table) > 1",
    "sample_tables": "SELECT dataset, input_table, count(DISTINCT s)::BIGINT AS samples, count(*)::BIGINT AS n FROM stored_rows JOIN (SELECT DISTINCT path, dataset, input_table FROM stored_files) USING (path) GROUP BY ALL",
    "incomplete_tables": "SELECT dataset, input_table FROM stored_files WHERE kind <> 'single_sample' GROUP BY ALL HAVING NOT bool_or(path LIKE '%.samples.parquet')",
    "restrict_inputs": "SELECT s, count(*)::BIGINT AS n FROM refs WHERE right(s, 1) IN ('0','1','2','6','7') GROUP BY s",
    "refs_topk": REFS + """SELECT * FROM r ORDER BY contig NULLS LAST, position NULLS LAST, DP NULLS LAST, GQ NULLS LAST, "LEN" NULLS LAST, ploidy NULLS LAST, s NULLS LAST LIMIT 100""",
    "range_group_count": "SELECT (i // 1000)::INT AS bucket, count(*)::BIGINT AS n FROM range(1, 262145) t(i) GROUP BY 1",
    "range_join": "SELECT a.i::INT AS idx, b.i::INT AS idx2 FROM range(1, 1000001) a(i) JOIN range(1, 1001) b(i) ON a.i = b.i",
    "membership_semi": "SELECT run_id, sample_index, elapsed_ns FROM progress_samples WHERE run_id IN (SELECT run_id FROM run_records)",
    "membership_anti": "SELECT run_id, sample_index, elapsed_ns FROM progress_samples p WHERE NOT EXISTS (SELECT 1 FROM run_records r WHERE r.run_id = p.run_id)",
    "interval_join_loci": f"""WITH b AS (SELECT {ORDINAL} AS o, position::BIGINT AS a, position::BIGINT + "LEN" - 1 AS b FROM refs WHERE "LEN" > 0),
 m AS (SELECT *, max(b) OVER (PARTITION BY o ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b WHERE o IS NOT NULL),
 i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY o ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS n FROM m),
 p AS (SELECT o, min(a) AS a, max(b) AS b FROM i GROUP BY o, n), l AS (SELECT {ORDINAL} AS contig_ordinal, position FROM locus_rows)
 SELECT contig_ordinal, position FROM l ASOF JOIN p ON l.contig_ordinal = p.o AND l.position >= p.a WHERE position <= p.b""",
    "explode_alleles": "SELECT locus, s, unnest(string_split(alleles, ',')) AS alleles FROM stored_rows",
    "entries_defined_counts": """SELECT s, count(*)::BIGINT AS rows_total, count(DP)::BIGINT AS "DP_defined", count(GQ)::BIGINT AS "GQ_defined", count("LEN")::BIGINT AS "LEN_defined", bool_or(DP IS NOT NULL OR GQ IS NOT NULL OR "LEN" IS NOT NULL) AS any_defined FROM refs GROUP BY s""",
    "scaled_contigs": REFS + "SELECT contig, count(*)::BIGINT AS n FROM (SELECT contig FROM r UNION ALL SELECT 'chr22' FROM r UNION ALL SELECT 'chr21' FROM r) GROUP BY contig",
    "sample_rates": """WITH o AS (SELECT run_id, elapsed_ns, max("rows") AS n FROM progress_samples GROUP BY ALL),
 g AS (SELECT run_id, elapsed_ns, greatest(n - lag(n) OVER w, 0) AS gained, elapsed_ns - lag(elapsed_ns) OVER w AS took FROM o WINDOW w AS (PARTITION BY run_id ORDER BY elapsed_ns))
 SELECT run_id, elapsed_ns, round(gained / (took / 1e9), 3) AS rate FROM g WHERE took IS NOT NULL""",
    "replay_grid": "SELECT a.v::BIGINT AS batch_duration_ns, b.v::BIGINT AS window_groups, c.v::DOUBLE AS precision, d.v::BIGINT AS consecutive_checks, e.v::BIGINT AS min_duration_ns FROM (VALUES (500000000), (1000000000), (2000000000), (5000000000)) a(v), (VALUES (5), (10), (20), (40)) b(v), (VALUES (0.01), (0.02), (0.05)) c(v), (VALUES (1), (3), (5), (10)) d(v), (VALUES (10000000000), (20000000000), (60000000000)) e(v)",
    "stop_over_checks": f"""WITH c(run_id, check_index, elapsed_ns, warm, width, ended) AS (VALUES {_CHECKS}), s(precision, consecutive_checks, min_duration_ns) AS (VALUES {_SETTINGS}),
 e AS (SELECT *, coalesce(max(CASE WHEN NOT coalesce(warm IS NOT NULL AND width < precision, FALSE) THEN check_index END) OVER (PARTITION BY run_id, precision, consecutive_checks, min_duration_ns ORDER BY check_index), -1) AS failed FROM c, s)
 SELECT run_id, precision::DOUBLE AS precision, consecutive_checks::BIGINT AS consecutive_checks, min_duration_ns::BIGINT AS min_duration_ns, min(CASE WHEN check_index - failed >= consecutive_checks AND elapsed_ns >= min_duration_ns AND (ended IS NULL OR elapsed_ns < ended) THEN elapsed_ns END)::BIGINT AS would_stop_ns FROM e GROUP BY ALL""",
    "probe_stop_reason": """WITH x AS (SELECT would_stop_ns AS stop, CASE WHEN window_end_ns >= max_duration_ns THEN max_duration_ns END AS cap, first_partition_end_ns AS ended FROM run_records WHERE action = 'shadow')
 SELECT CASE WHEN stop IS NOT NULL AND (cap IS NULL OR stop <= cap) THEN 'steady' WHEN cap IS NOT NULL AND (ended IS NULL OR cap < ended) THEN 'capped' ELSE 'completed' END AS reason, count(*)::BIGINT AS n FROM x GROUP BY 1""",
    "normalized_throughput": f"SELECT run_id, round({_W}, 3) AS whole_run, round({_W} * ln(input_tables) / threads, 3) AS whole_run_normalized, round(steady_state_throughput * ln(input_tables) / threads, 3) AS steady_state_normalized FROM run_records WHERE {DONE}",
    "sweep_report": f"""WITH x AS (SELECT formulation, threads, peak_rss_bytes, {_W} * ln(input_tables) / threads AS w, steady_state_throughput * ln(input_tables) / threads AS t FROM run_records WHERE {DONE})
 SELECT formulation, threads, count(*)::BIGINT AS n, round(avg(w), 4) AS whole_run, round((max(w) - min(w)) / avg(w) / 2, 4) AS whole_run_half_range, round(avg(t), 4) AS steady_state, round(avg(t) / avg(CASE WHEN t IS NOT NULL THEN w END), 4) AS steady_over_whole, max(peak_rss_bytes) AS peak_rss_bytes FROM x GROUP BY ALL""",
    "calibration_errors": """WITH x AS (SELECT DISTINCT run_id, formulation, threads, would_stop_ns IS NOT NULL AS settled, relative_half_width AS band, would_stop_ns, would_be_steady_state_throughput AS w, would_be_relative_half_width AS h, steady_state_throughput AS e FROM run_records WHERE action = 'shadow'),
 y AS (SELECT run_id, settled, CASE WHEN settled THEN w / e - 1 END AS error, CASE WHEN settled THEN w * (1 - h) / e - 1 END AS low, CASE WHEN settled THEN w * (1 + h) / e - 1 END AS high FROM x)
 SELECT run_id, settled, round(error, 6) AS error, round(low, 6) AS low, round(high, 6) AS high, low <= 0 AND high >= 0 AS covers FROM y""",
    "pareto_datasets": """WITH b AS (SELECT dataset_path, min(run_ns) AS least_ns, min(peak_rss_bytes) AS least_rss FROM run_records GROUP BY 1)
 SELECT *, NOT EXISTS (SELECT 1 FROM b o WHERE o.least_ns <= b.least_ns AND o.least_rss <= b.least_rss AND (o.least_ns < b.least_ns OR o.least_rss < b.least_rss)) AS pareto FROM b""",
    "run_status_summary": "SELECT status, action, count(*)::BIGINT AS n, min(epoch_us(started_at)) AS first_us, max(epoch_us(started_at)) AS last_us, coalesce(sum(rows_written), 0)::BIGINT AS rows_written FROM run_records GROUP BY ALL",
    "order_check_violations": """WITH f AS (SELECT row_number() OVER () - 1 AS i, contig AS c, position AS p, s FROM refs),
 n AS (SELECT *, lag(c) OVER w AS c0, lag(p) OVER w AS p0, lag(s) OVER w AS s0 FROM f WINDOW w AS (ORDER BY i))
 SELECT 0::BIGINT AS partition, i AS row_in_partition FROM n WHERE i > 0 AND (c0 > c OR (c0 IS NULL AND c IS NOT NULL) OR (c0 IS NOT DISTINCT FROM c AND (p0 > p OR (p0 IS NULL AND p IS NOT NULL) OR (p0 IS NOT DISTINCT FROM p AND (s0 > s OR (s0 IS NULL AND s IS NOT NULL))))))""",
    "order_check_sorted": "SELECT 0::BIGINT AS partition, 0::BIGINT AS row_in_partition WHERE FALSE",
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL",
}
