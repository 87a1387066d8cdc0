"""Queries of the operators for training data (problems 2, 6, 7 and 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table
from .mixing import Mix, mixed
from .packing import packed
from .pii import Detector, detector, found, redacted
from .percentiles import combine, percentiles, summarize
from .tokens import with_tokens

POINTS = [0.01, 0.25, 0.5, 0.75, 0.9, 0.99]
GROUP = ["field", "group_key"]


def _values(spark: SparkSession, d: str) -> list[DataFrame]:
    """DP and GQ of refs by sample, and run_ns of run_records by data set."""
    blocks = table(spark, d, "refs").select(F.col("s").alias("group_key"), F.expr("stack(2, 'DP', DP, 'GQ', GQ) AS (field, x)"))
    runs = table(spark, d, "run_records").select(F.col("dataset_path").alias("group_key"), F.lit("run_ns").alias("field"), F.col("run_ns").alias("x"))
    return [blocks.select(*GROUP, F.col("x").cast("bigint").alias("x")), runs.select(*GROUP, "x")]


def _parts(spark: SparkSession, d: str) -> DataFrame:
    blocks, runs = _values(spark, d)
    return summarize(blocks.unionByName(runs), GROUP, "x")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups whose 99th percentile is at least ten times their median."""
    return percentiles(_parts(spark, d), GROUP, [0.5, 0.99]).where("values[1] >= 10 * values[0]").select(*GROUP)


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """POINTS of every group."""
    found = percentiles(_parts(spark, d), GROUP, POINTS)
    return found.select(*GROUP, "n", *(F.round(F.col("values")[i], 2).alias(f"p{round(p * 100):02d}") for i, p in enumerate(POINTS)))


def p2_by_parts(spark: SparkSession, d: str) -> DataFrame:
    """POINTS of every group from parts that are summarized by themselves and then combined: DP, GQ and the runs of each status."""
    blocks, _ = _values(spark, d)
    status = table(spark, d, "run_records").select(F.col("dataset_path").alias("group_key"), F.lit("run_ns").alias("field"), F.col("run_ns").alias("x"), "status")
    parts = [blocks.where("field = 'DP'"), blocks.where("field = 'GQ'"), status.where("status = 'completed'"), status.where("status <> 'completed' OR status IS NULL")]
    found = percentiles(combine([summarize(p, GROUP, "x") for p in parts], GROUP), GROUP, POINTS)
    return found.select(*GROUP, "n", *(F.round(F.col("values")[i], 2).alias(f"p{round(p * 100):02d}") for i, p in enumerate(POINTS)))


def _texts(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    return with_tokens(table(spark, d, "documents"), "text", keep=list(keep))


#: Most loss-bearing tokens of a container, as a share of its capacity: a counterpart may run longer than its text,
#: in a language that the vocabulary serves less.
LOSS_SHARE = 1.75


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """The container of every text, or of every piece of a text longer than the capacity, for each pack.

    A document is an example of instruction data: `text` is the prompt, whose tokens the capacity bounds, and
    `target_text` the answer, whose tokens bear the loss and have a limit of their own (LOSS_SHARE); the number of
    segments is the third limit.
    """
    sized = with_tokens(table(spark, d, "documents"), "text", keep=["doc_id", "target_text"])
    sized = with_tokens(sized, "target_text", keep=["doc_id", "n_tokens"], name="n_loss")
    return packed(sized, ["doc_id"], "n_tokens", table(spark, d, "pack_sizes"), loss_tokens="n_loss", loss_share=LOSS_SHARE)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """By pack: containers, tokens, the share of room used, and how many containers each limit stops.

    A container counts as full in a dimension if less than 2 % of that limit is left (of segments: none).
    """
    sizes = table(spark, d, "pack_sizes").select("pack_name", F.col("capacity_tokens").cast("bigint").alias("capacity_tokens"))
    full = p6_packed(spark, d).where("container IS NOT NULL").groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("n"), F.sum("loss_tokens").alias("loss"), F.count("*").alias("pieces"))
    full = full.join(F.broadcast(sizes), "pack_name")
    by = full.groupBy("pack_name", "capacity_tokens").agg(
        F.count("*").alias("containers"),
        F.sum("n").alias("tokens"),
        F.sum("pieces").alias("pieces"),
        F.count_if(F.expr("n >= 0.98 * capacity_tokens")).alias("full_of_tokens"),
        F.count_if(F.expr(f"loss >= 0.98 * {LOSS_SHARE} * capacity_tokens")).alias("full_of_loss"),
        F.count_if(F.expr("pieces >= greatest(4, capacity_tokens div 16)")).alias("full_of_segments"),
        F.count_if(F.expr(f"pieces > 1 AND (n > capacity_tokens OR loss > {LOSS_SHARE} * capacity_tokens OR pieces > greatest(4, capacity_tokens div 16))")).alias("over_a_limit"),
    )
    return by.withColumn("used", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))


def p6_checked(spark: SparkSession, d: str) -> DataFrame:
    """By pack: documents that come out, containers above a limit, and texts whose pieces leave a token out or give one twice."""
    rows = p6_packed(spark, d)
    sizes = F.broadcast(table(spark, d, "pack_sizes").select("pack_name", F.col("capacity_tokens").cast("bigint").alias("cap")))
    full = rows.where("container IS NOT NULL").groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("n"), F.sum("loss_tokens").alias("loss"), F.count("*").alias("pieces")).join(sizes, "pack_name")
    above = full.groupBy("pack_name").agg(F.count_if(F.expr(f"n > cap OR pieces > greatest(4, cap div 16) OR (pieces > 1 AND loss > cap * {LOSS_SHARE})")).alias("above_limits"))
    each = rows.groupBy("pack_name", "doc_id").agg(F.count("*").alias("pieces"), F.max("piece").alias("last"), F.max(F.expr("first_token + n_tokens")).alias("end"), F.sum("n_tokens").alias("n")).join(sizes, "pack_name")
    whole = each.groupBy("pack_name").agg(F.count("*").alias("documents"), F.count_if(F.expr("pieces <> last + 1 OR end <> n OR pieces <> greatest(1, ceil(n / cap))")).alias("not_whole"))
    return whole.join(above, "pack_name")


def _mix(spark: SparkSession, d: str) -> Mix:
    return mixed(_texts(spark, d, "doc_id", "source"), ["doc_id"], "source", "n_tokens", table(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix, each as often as it occurs, with its place."""
    return _mix(spark, d).rows


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached shares of every source."""
    return _mix(spark, d).shares


def p7_checked(spark: SparkSession, d: str) -> DataFrame:
    """By source of the mix: documents that occur too often or twice in one pass, whether its share is held to within half a
    percent of all tokens (or 0.2 % of them and one longest text), and slots out of the order that the schedule asks for."""
    mix = _mix(spark, d)
    rows = mix.rows.join(F.broadcast(table(spark, d, "mix_targets").select("source", "target_share", "max_repeats")), "source")
    docs = rows.groupBy("source", "target_share", "max_repeats", "doc_id").agg(F.count("*").alias("n"), F.count_distinct("repeat_no").alias("passes"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest"))
    by = docs.groupBy("source", "target_share").agg(F.count_if(F.expr("n > max_repeats OR passes <> n")).alias("too_often"), F.sum("tokens").alias("tokens"), F.max("longest").alias("longest"))
    # One row a source.
    every = Window.partitionBy()
    off = F.abs(F.col("tokens") / F.sum("tokens").over(every) - F.col("target_share") / F.sum("target_share").over(every))
    return by.select("source", "too_often", (off * F.sum("tokens").over(every) <= F.greatest(0.005 * F.sum("tokens").over(every), 0.002 * F.sum("tokens").over(every) + F.col("longest"))).alias("held"))


def _detector(spark: SparkSession, d: str) -> Detector:
    return detector(table(spark, d, "known_names"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct piece of personal information of every text."""
    return found(table(spark, d, "documents"), ["doc_id"], "text", _detector(spark, d)).select("doc_id", "kind", "found_text").distinct()


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text with placeholders of their type for its pieces of personal information."""
    return redacted(table(spark, d, "documents"), ["doc_id"], "text", _detector(spark, d))


def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    """Texts, and those whose redaction isn't the text with each piece replaced, the rest as it was."""
    with_ = _detector(spark, d)
    documents = table(spark, d, "documents").select("doc_id", "text")
    pieces = found(documents, ["doc_id"], "text", with_).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "found_text", "kind"))).alias("xs"))
    both = documents.join(redacted(documents, ["doc_id"], "text", with_), "doc_id").join(pieces, "doc_id", "left")
    # The text put together anew: what lies between the pieces, and their placeholders.
    step = lambda a, x: F.struct(F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, x["start"].cast("int") - a["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out"), (x["start"].cast("int") + F.length(x["found_text"])).alias("at"))
    made = F.aggregate("xs", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, 1 << 30)))
    return both.agg(F.count("*").alias("documents"), F.count_if(~F.coalesce(made, F.col("text")).eqNullSafe(F.col("redacted_text"))).alias("unlike"))


ALL_VALUES = """
WITH v AS (SELECT 'DP' AS field, s AS group_key, DP::DOUBLE AS x FROM refs UNION ALL SELECT 'GQ', s, GQ FROM refs UNION ALL SELECT 'run_ns', dataset_path, run_ns FROM run_records)
"""
QUERIES = {"p2_found": p2_found, "p2_percentiles": p2_percentiles, "p2_by_parts": p2_by_parts, "p6_packed": p6_packed, "p6_fill": p6_fill, "p6_checked": p6_checked, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_checked": p7_checked, "p8_found": p8_found, "p8_redacted": p8_redacted, "p8_checked": p8_checked}
SQL = {
    "p2_found": ALL_VALUES + "SELECT field, group_key FROM v WHERE x IS NOT NULL GROUP BY ALL HAVING quantile_cont(x, 0.99) >= 10 * quantile_cont(x, 0.5)",
    "p2_percentiles": ALL_VALUES + "SELECT field, group_key, count(*)::BIGINT AS n, " + ", ".join(f"round(quantile_cont(x, {p}), 2) AS p{round(p * 100):02d}" for p in POINTS) + " FROM v WHERE x IS NOT NULL GROUP BY ALL",
}
SQL["p2_by_parts"] = SQL["p2_percentiles"]
SQL["p6_checked"] = "SELECT pack_name, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS not_whole, 0::BIGINT AS above_limits FROM pack_sizes"
SQL["p7_checked"] = "SELECT source, 0::BIGINT AS too_often, TRUE AS held FROM mix_targets WHERE source IN (SELECT source FROM documents WHERE text <> '')"
SQL["p8_checked"] = "SELECT count(*) AS documents, 0::BIGINT AS unlike FROM documents"
