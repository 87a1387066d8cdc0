"""Queries of the general data-processing operators (problems 1, 3, 4 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.locus import contig_ordinal
from ..operators.compaction import Compaction, compact, consolidated, data_files, laid_out, listed, packing_plan, table_report
from ..operators.grid import regular_grid
from ..operators.intervals import periods_and_gaps
from ..operators.split_points import keyed_split_points
from ..session import scratch_path, table

MAX_GAP = 500_000


def _covered(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "refs").where("LEN > 0").select("s", contig_ordinal(F.col("contig")).alias("contig_ordinal"), F.col("position").cast("bigint").alias("first"), (F.col("position").cast("bigint") + F.col("LEN") - 1).alias("last"))
    return periods_and_gaps(blocks.where("contig_ordinal IS NOT NULL"), ["s", "contig_ordinal"], "first", "last")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Periods of each s and ordinal, and the gaps of at most MAX_GAP positions between neighbouring ones."""
    found = _covered(spark, d).where(f"kind = 'period' OR last_position - first_position < {MAX_GAP}")
    return found.select("kind", "s", "contig_ordinal", F.col("first_position").try_cast("int").alias("first_position"), F.col("last_position").try_cast("int").alias("last_position"))


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Covered and uncovered positions between the first and last covered one, by s and ordinal."""
    n = F.col("last_position") - F.col("first_position") + 1
    return _covered(spark, d).groupBy("s", "contig_ordinal").agg(
        F.count_if(F.col("kind") == "period").alias("periods"),
        F.sum(F.when(F.col("kind") == "period", n).otherwise(0)).alias("covered"),
        F.sum(F.when(F.col("kind") == "gap", n).otherwise(0)).alias("uncovered"),
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Split points of every request over the rows of its contig ordinal."""
    loci = table(spark, d, "locus_rows").select(contig_ordinal(F.col("contig")).alias("contig_ordinal"), "position")
    found = keyed_split_points(loci, "contig_ordinal", "position", table(spark, d, "balance_requests"), "request_id", "intervals")
    return found.select("request_id", "k", "contig_ordinal", "position")


def _grid(spark: SparkSession, d: str) -> DataFrame:
    shadow = table(spark, d, "run_records").where("action = 'shadow'").select("run_id").distinct()
    readings = table(spark, d, "progress_samples").join(shadow, "run_id", "left_semi")
    return regular_grid(readings, ["run_id"], "elapsed_ns", "rows", 10**9, names=("period_index", "rows_total", "readings", "filled"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Seconds of the shadow runs for which there was no reading."""
    return _grid(spark, d).where("filled").select("run_id", "period_index")


def p4_grid(spark: SparkSession, d: str) -> DataFrame:
    """One row a second of every shadow run, with the last or the imputed count of rows."""
    return _grid(spark, d)


def p4_checked(spark: SparkSession, d: str) -> DataFrame:
    """Every second with its reading's count of rows; of filled ones, whether the count lies between its neighbours'."""
    from pyspark.sql import Window

    run = Window.partitionBy("run_id").orderBy("period_index")
    seen = F.when(~F.col("filled"), F.col("rows_total"))
    before = F.last(seen, ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(seen, ignorenulls=True).over(run.rowsBetween(1, Window.unboundedFollowing))
    low, high = F.least(before, after), F.greatest(before, after)
    inside = F.when(before.isNull(), F.col("rows_total") <= after).otherwise(F.col("rows_total").between(low, high))
    return _grid(spark, d).select("run_id", "period_index", "readings", "filled", seen.cast("bigint").alias("rows_total"), F.when(F.col("filled"), inside).alias("between"))


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    """Seconds, filled seconds and readings of every shadow run."""
    return _grid(spark, d).groupBy("run_id").agg(F.count("*").alias("periods"), F.count_if("filled").alias("filled"), F.sum("readings").alias("readings"))


TABLE = ["dataset", "input_table"]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Input tables with at least eight data files of under 1 MiB in the mean: those that the packing plan of all tables
    would put together from many small files."""
    return table_report(packing_plan(data_files(table(spark, d, "stored_files"), TABLE), TABLE), TABLE).where("fragmented").select(*TABLE)


def _plan(spark: SparkSession, d: str) -> DataFrame:
    files = data_files(table(spark, d, "stored_files"), TABLE)
    fragmented = table_report(files, TABLE).where("fragmented").select(*TABLE)
    return packing_plan(files.join(fragmented, TABLE, "left_semi"), TABLE)


def p5_plan(spark: SparkSession, d: str) -> DataFrame:
    """The output file of every data file of a fragmented input table (-1: it is large enough as it is)."""
    return _plan(spark, d).withColumn("out_file", F.coalesce("out_file", F.lit(-1)))


def p5_consolidated(spark: SparkSession, d: str) -> DataFrame:
    """Every stored record with the output file it goes to (-1: its file isn't rewritten)."""
    return consolidated(table(spark, d, "stored_rows"), _plan(spark, d), TABLE).withColumn("out_file", F.coalesce("out_file", F.lit(-1)))


def _rewritten(spark: SparkSession, d: str) -> tuple[str, str, Compaction]:
    """The stored records as one small file a path, in a directory for each input table, and their compaction by table."""
    of = table(spark, d, "stored_files").groupBy("path").agg(F.min(F.struct(*TABLE)).alias("of"))
    rows = table(spark, d, "stored_rows").join(of, "path").select("of.*", "path", "locus", "alleles", "s")
    folder = scratch_path(spark, "rewritten")
    laid_out(rows, TABLE, "path", f"{folder}/before")
    return f"{folder}/before", f"{folder}/after", compact(spark, f"{folder}/before", f"{folder}/after", by=TABLE)


def p5_compacted(spark: SparkSession, d: str) -> DataFrame:
    """Every stored record, read from the compacted files: each path's records are first written as a small file of their
    own, then these files are combined in splits, input table by input table, staged, verified and published."""
    _, after, _ = _rewritten(spark, d)
    schema = ", ".join(["path string, locus bigint, alleles string, s string", *(f"{c} string" for c in TABLE)])
    return spark.read.schema(schema).parquet(after).select("path", "locus", "alleles", "s")


def p5_rewritten(spark: SparkSession, d: str) -> DataFrame:
    """Files before and after the compaction of p5_compacted, by input table; -1 stands for a table that has vanished."""
    before, after, _ = _rewritten(spark, d)
    part = lambda c: F.expr(f"url_decode(regexp_extract(path, '/{c}=([^/]*)/', 1))").alias(c)
    counted = lambda where, name: listed(spark, where).groupBy(*map(part, TABLE)).agg(F.count("*").alias(name))
    return counted(before, "files_before").join(counted(after, "files_after"), TABLE, "left").select(*TABLE, "files_before", F.coalesce("files_after", F.lit(-1)).alias("files_after"))


BLOCKS = """
WITH r AS (SELECT s, TRY_CAST(regexp_extract(contig, '^chr0*([0-9]+)$', 1) AS INT) AS o, position::BIGINT AS a, position::BIGINT + "LEN" - 1 AS b
           FROM refs WHERE "LEN" > 0 AND regexp_matches(contig, '^chr[0-9]+$')),
m AS (SELECT *, max(b) OVER (PARTITION BY s, o ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r WHERE o IS NOT NULL),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY s, o ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS n FROM m),
p AS (SELECT s, o, n, min(a) AS a, max(b) AS b FROM i GROUP BY s, o, n),
g AS (SELECT s, o, b + 1 AS a, lead(a) OVER (PARTITION BY s, o ORDER BY a) - 1 AS b FROM p),
k AS (SELECT 'period' AS kind, s, o, a, b FROM p UNION ALL SELECT 'gap', s, o, a, b FROM g WHERE b IS NOT NULL)
"""

SPLITS = """
WITH l AS (SELECT TRY_CAST(regexp_extract(contig, '^chr0*([0-9]+)$', 1) AS INT) AS o, position FROM locus_rows WHERE regexp_matches(contig, '^chr[0-9]+$')),
r AS (SELECT o, position, row_number() OVER (PARTITION BY o ORDER BY position) AS i, count(*) OVER (PARTITION BY o) AS n FROM l WHERE o IS NOT NULL),
w AS (SELECT request_id, contig_ordinal, intervals AS j, unnest(generate_series(1, intervals - 1)) AS k FROM (SELECT DISTINCT * FROM balance_requests) WHERE intervals >= 2),
f AS (SELECT w.request_id, w.contig_ordinal, w.j, w.k, r.position FROM w JOIN r ON r.o = w.contig_ordinal AND r.i = (w.k * r.n) // w.j + 1),
g AS (SELECT *, coalesce(position > lag(position) OVER (PARTITION BY request_id ORDER BY k), TRUE) AS grows FROM f)
SELECT request_id, k::INT AS k, contig_ordinal, position FROM g QUALIFY bool_and(grows) OVER (PARTITION BY request_id)
"""

GRID = """
WITH sh AS (SELECT DISTINCT run_id FROM run_records WHERE action = 'shadow'),
b AS (SELECT run_id, elapsed_ns // 1000000000 AS p, count(*) AS n FROM progress_samples SEMI JOIN sh USING (run_id) WHERE elapsed_ns >= 0 GROUP BY 1, 2),
m AS (SELECT run_id, max(p) AS last FROM b GROUP BY 1),
g AS (SELECT run_id, unnest(generate_series(0, last)) AS p FROM m),
j AS (SELECT g.run_id, g.p, coalesce(b.n, 0) AS n FROM g LEFT JOIN b USING (run_id, p))
"""

FILES = r"""
WITH f AS (SELECT dataset, input_table, path, arg_max(n_bytes, (listed_at, n_bytes)) AS size FROM stored_files
           WHERE NOT regexp_matches(path, '(^|/)\.') AND NOT regexp_matches(path, '(^|/)[^/]+\.samples\.parquet$') GROUP BY ALL),
t AS (SELECT dataset, input_table FROM f GROUP BY ALL HAVING count(*) >= 8 AND sum(size) < count(*) * 1048576)
"""

PLAN = FILES + """,
w AS (SELECT *, CASE WHEN size < 134217728 THEN size + 16384 ELSE 0 END AS weight FROM f SEMI JOIN t USING (dataset, input_table)),
u AS (SELECT *, sum(weight) OVER (PARTITION BY dataset, input_table ORDER BY path ROWS UNBOUNDED PRECEDING) AS upto, sum(weight) OVER (PARTITION BY dataset, input_table) AS whole FROM w),
o AS (SELECT *, greatest(round(whole / 134217728), 1)::BIGINT AS out_files FROM u),
p AS (SELECT dataset, input_table, path, size, out_files, CASE WHEN size < 134217728 THEN least(floor((upto - weight + weight // 2)::DOUBLE * out_files / whole)::BIGINT, out_files - 1) END AS out_file FROM o)
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_coverage": p1_coverage,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_grid": p4_grid,
    "p4_checked": p4_checked,
    "p4_runs": p4_runs,
    "p5_found": p5_found,
    "p5_plan": p5_plan,
    "p5_consolidated": p5_consolidated,
    "p5_compacted": p5_compacted,
    "p5_rewritten": p5_rewritten,
}
SQL = {
    "p1_found": BLOCKS + "SELECT kind, s, o AS contig_ordinal, a::INT AS first_position, b::INT AS last_position FROM k WHERE kind = 'period' OR b - a < 500000",
    "p1_coverage": BLOCKS + """SELECT s, o AS contig_ordinal, count(*) FILTER (kind = 'period')::BIGINT AS periods,
 sum(CASE WHEN kind = 'period' THEN b - a + 1 ELSE 0 END)::BIGINT AS covered, sum(CASE WHEN kind = 'gap' THEN b - a + 1 ELSE 0 END)::BIGINT AS uncovered FROM k GROUP BY s, o""",
    "p3_found": SPLITS,
    "p4_found": GRID + "SELECT run_id, p AS period_index FROM j WHERE n = 0",
    "p4_checked": GRID + """, l AS (SELECT run_id, elapsed_ns // 1000000000 AS p, arg_max("rows", (elapsed_ns, "rows")) AS v FROM progress_samples SEMI JOIN sh USING (run_id) WHERE elapsed_ns >= 0 GROUP BY 1, 2)
 SELECT j.run_id, j.p AS period_index, j.n AS readings, j.n = 0 AS filled, l.v AS rows_total, CASE WHEN j.n = 0 THEN TRUE END AS "between" FROM j LEFT JOIN l USING (run_id, p)""",
    "p4_runs": GRID + "SELECT run_id, count(*)::BIGINT AS periods, count(*) FILTER (n = 0)::BIGINT AS filled, sum(n)::BIGINT AS readings FROM j GROUP BY run_id",
    "p5_found": FILES + "SELECT dataset, input_table FROM t",
    "p5_plan": PLAN + "SELECT dataset, input_table, path, size, coalesce(out_file, -1) AS out_file, out_files FROM p",
    "p5_compacted": "SELECT path, locus, alleles, s FROM stored_rows",
    "p5_rewritten": "WITH f AS (SELECT path, min((dataset, input_table)) AS t FROM stored_files GROUP BY path) SELECT t[1] AS dataset, t[2] AS input_table, count(DISTINCT path)::BIGINT AS files_before, 1::BIGINT AS files_after FROM stored_rows JOIN f USING (path) GROUP BY ALL",
    "p5_consolidated": PLAN + "SELECT p.dataset, p.input_table, coalesce(p.out_file, -1) AS out_file, r.* FROM stored_rows r LEFT JOIN p ON p.path = r.path",
}
