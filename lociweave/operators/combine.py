"""Combining input tables: reference formulations, allele ranks, interval filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.locus import SplitPoints, interval_index
from ..plans.ordering import OrderedFrame, ascending, representation


def grouped(n_tables: int, groups: int) -> list[int]:
    """The group (from 0) of each of `n_tables` tables in name order: contiguous, balanced in count, larger groups first.

    More groups than tables are as many groups as tables.
    """
    if groups < 1 or n_tables < 1:
        raise ValueError("at least one table and one group are needed")
    groups = min(groups, n_tables)
    size, larger = divmod(n_tables, groups)
    return [g for g in range(groups) for _ in range(size + (g < larger))]


def union(frames: list[DataFrame]) -> DataFrame:
    """Union all, by name."""
    return reduce(DataFrame.unionByName, frames)


def combine_union(frames: list[DataFrame], ordering: list[str]) -> OrderedFrame:
    """All rows of all tables in order: a union and one range exchange with its sort."""
    return OrderedFrame(union(frames).orderBy(*ascending(ordering)), tuple(ordering))


def combine_grouped(frames: list[DataFrame], ordering: list[str], groups: int, *, group_column: str | None = None) -> OrderedFrame:
    """All rows of all tables in order, with the group of each table as a column on request.

    Merging group by group first would sort everything twice here, so groups are only told apart, not sorted.
    """
    if group_column:
        frames = [f.withColumn(group_column, F.lit(g)) for f, g in zip(frames, grouped(len(frames), groups))]
    else:
        grouped(len(frames), groups)
    return combine_union(frames, ordering)


def combine_intervals(frames: list[DataFrame], ordering: list[str], points: SplitPoints, *, interval_column: str = "interval_index") -> OrderedFrame:
    """All rows in order with the locus interval of each; one pass, whatever the number of intervals."""
    rows = union(frames)
    how = representation(rows.columns)
    index = interval_index(points, packed=F.col("locus")) if how == "packed" else interval_index(points, contig=F.col("contig"), position=F.col("position"))
    return OrderedFrame(rows.withColumn(interval_column, index).orderBy(*ascending(ordering)), tuple(ordering), "file-per-interval", tuple(points))


def combine_alleles(frames: list[DataFrame], locus: list[str], allele: str = "alleles") -> OrderedFrame:
    """The distinct alleles at each locus with their rank, in order.

    Distinct rows are made before and after one exchange on (locus, allele); ranking then needs the rows of a locus
    together. Only as many rows as a locus has distinct alleles meet in a window.
    """
    keys = [*locus, allele]
    rows = union(frames).select(*keys).distinct()
    rank = F.rank().over(Window.partitionBy(*locus).orderBy(F.col(allele).asc_nulls_last())).cast("bigint")
    return OrderedFrame(rows.withColumn("rank", rank).orderBy(*ascending(keys)), tuple(keys))


def explode_alleles(df: DataFrame, column: str = "alleles", separator: str = ",") -> DataFrame:
    """One row for each allele of a list, or of a text with separators; an empty or null list gives no row."""
    c = F.col(column)
    kind = dict(df.dtypes)[column]
    return df.withColumn(column, F.explode(c if kind.startswith("array") else F.split(c, separator, -1)))
