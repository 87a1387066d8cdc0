"""Reshaping tables: packed loci, scaled copies, sample assignment, defined entries, sortedness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.locus import contig_name, contig_ordinal, pack, packed_ordinal, packed_position
from ..plans.ordering import order_violations

MOST_SCALE = 23


class ConversionError(ValueError):
    """Rows that a conversion doesn't take."""


def pack_loci(df: DataFrame) -> DataFrame:
    """`locus` in place of `contig` and `position`; every contig must have an ordinal, and nothing may be null."""
    bad = df.select(F.count_if(contig_ordinal(F.col("contig")).isNull() | F.col("position").isNull()).alias("n")).first().n
    if bad:
        raise ConversionError(f"{bad} rows have no contig ordinal or no position")
    locus = pack(contig_ordinal(F.col("contig")), F.col("position")).alias("locus")
    return df.select(*(locus if c == "contig" else F.col(f"`{c}`") for c in df.columns if c != "position"))


def unpack_loci(df: DataFrame) -> DataFrame:
    """`contig` and `position` in place of `locus`."""
    return df.select(*(x for c in df.columns for x in ([contig_name(packed_ordinal(F.col("locus"))).alias("contig"), packed_position(F.col("locus")).alias("position")] if c == "locus" else [F.col(f"`{c}`")])))


def single_contig(df: DataFrame) -> str:
    """The one contig of a table."""
    found = [r.contig for r in df.select("contig").distinct().limit(3).collect()]
    if len(found) != 1 or found[0] is None:
        raise ConversionError(f"one contig is needed, found {found}")
    return found[0]


def scaled(df: DataFrame, factor: int) -> DataFrame:
    """The rows, and copies of them on the contigs 22, 21 and on down: `factor` times as many in all."""
    if not 1 <= factor <= MOST_SCALE:
        raise ConversionError(f"a scale factor lies between 1 and {MOST_SCALE}")
    names = F.array(F.col("contig"), *(F.lit(f"chr{22 - i:02d}") for i in range(factor - 1)))
    return df.withColumn("contig", F.explode(names)).select(*df.columns)


def normalized_contigs(df: DataFrame) -> DataFrame:
    """Contigs in their two-digit spelling; names without an ordinal stay as they are."""
    return df.withColumn("contig", F.coalesce(contig_name(contig_ordinal(F.col("contig"))), F.col("contig")))


def entries(df: DataFrame, key: list[str], sample: str = "s") -> DataFrame:
    """Rows of a wide table with a map column `entries` (sample to value) as one row for each defined entry."""
    return df.select(*key, F.explode("entries").alias(sample, "entry")).where("entry IS NOT NULL")


def defined_counts(df: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Per key: rows, and for each field how many are defined; the samples that have one."""
    return df.groupBy(*key).agg(F.count("*").alias("rows_total"), *(F.count(f).alias(f"{f}_defined") for f in fields), F.bool_or(F.coalesce(*(F.col(f).cast("string") for f in fields)).isNotNull()).alias("any_defined"))


def unsorted_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose (keys, s) doesn't strictly follow that of the row before, as the partitions lie now."""
    return order_violations(df, [*keys, "s"], strict=True)
