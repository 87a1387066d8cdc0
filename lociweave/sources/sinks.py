"""Sinks: collected rows, counted rows, one ordered file, one file per locus interval."""

from __future__ import annotations

import math
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import orc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.locus import SplitPoints, interval_index
from ..plans.ordering import OrderedFrame, ascending, held, representation
from .files import Files, arrow_codec, arrow_path, checked_format, compression_options
from .statistics import file_batches, open_footer

SETTLE_TRIES, SETTLE_PAUSE = 50, 0.1


class OutputError(ValueError):
    """An output path that can't be written to."""


def collected(frame: OrderedFrame, limit: int | None = None):
    """The rows in order, as an Arrow table; for results that fit the driver."""
    return held(frame.df if limit is None else frame.df.limit(limit), list(frame.ordering)).toArrow()


def drained(df: DataFrame) -> int:
    """Run the whole plan, keep nothing, and give the number of its rows."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    return seen.get["rows"]


def check_file_path(path: str, fmt: str = "parquet") -> None:
    name = path.rsplit("/", 1)[-1]
    if not name:
        raise OutputError(f"{path} ends in a slash; one file needs a file name")
    if name.startswith("."):
        raise OutputError(f"{path} would be hidden")
    if not name.endswith(f".{fmt}") or name == f".{fmt}":
        raise OutputError(f"{path} needs the extension .{fmt}")
    if name.endswith(f".samples.{fmt}"):
        raise OutputError(f"{path} is the name of a sample annotation table")


def check_directory_path(path: str) -> None:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if os.path.splitext(name)[1]:
        raise OutputError(f"{path} is a directory and takes no extension")
    if name.startswith(".") or name.startswith("s="):
        raise OutputError(f"{path}: a dot or s= at the front has a meaning of its own")


def check_vacant(spark: SparkSession, path: str) -> None:
    """Refuse a file, a link or a directory that isn't empty."""
    files = Files(spark)
    local = path.removeprefix("file://")
    if "://" not in local and os.path.islink(local.rstrip("/")):
        raise OutputError(f"{path} is a symbolic link")
    if files.is_file(path):
        raise OutputError(f"{path} is a file")
    if files.exists(path) and files.entries(path):
        raise OutputError(f"{path} is not empty")


def remove_output(spark: SparkSession, path: str) -> None:
    """Delete all below a path, again until late writers have settled."""
    files = Files(spark)
    for _ in range(SETTLE_TRIES):
        if not files.exists(path):
            return
        files.delete(path)
        if not files.exists(path):
            return
        time.sleep(SETTLE_PAUSE)
    raise OutputError(f"{path} could not be removed")


@dataclass(frozen=True)
class Written:
    rows: int
    files: int


def _staging(path: str) -> str:
    head, _, name = path.rstrip("/").rpartition("/")
    return f"{head}/.{name}-{uuid.uuid4().hex}"


ROW_GROUP = 1 << 20


class _Stream:
    """One file that batches are appended to, row group by row group, under a hidden name until it is whole."""

    def __init__(self, path: str, schema: pa.Schema, fmt: str, compression: str | None, ordering: list[str]):
        self.fs, self.path = arrow_path(path)
        head, _, name = self.path.rpartition("/")
        self.fs.create_dir(head, recursive=True)
        self.hidden = f"{head}/.{name}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.hidden)
        codec, level = arrow_codec(compression)
        if fmt == "orc":
            self.writer = orc.ORCWriter(self.out, compression="uncompressed" if codec == "none" else "zlib" if codec == "gzip" else codec)
        else:
            order = pq.SortingColumn.from_ordering(schema, [(c, "ascending") for c in ordering], null_placement="at_end") if ordering else None
            self.writer = pq.ParquetWriter(self.out, schema, compression=codec, compression_level=level, sorting_columns=order)
        self.schema, self.held, self.rows, self.total = schema, [], 0, 0

    def append(self, batch: pa.RecordBatch) -> None:
        self.held.append(pa.RecordBatch.from_arrays(batch.columns, schema=self.schema))
        self.rows += batch.num_rows
        if self.rows >= ROW_GROUP:
            self.flush()

    def flush(self) -> None:
        if self.held or not self.total:
            t = pa.Table.from_batches(self.held, self.schema)
            self.writer.write(t) if isinstance(self.writer, orc.ORCWriter) else self.writer.write_table(t, row_group_size=ROW_GROUP)
        self.total += self.rows
        self.held, self.rows = [], 0

    def close(self) -> int:
        self.flush()
        self.writer.close()
        self.out.close()
        self.fs.move(self.hidden, self.path)
        return self.total


def _plain(schema: pa.Schema) -> pa.Schema:
    """A schema without the engine's notes."""
    return pa.schema([f.remove_metadata() for f in schema])


def write_file(frame: OrderedFrame, path: str, fmt: str = "parquet", compression: str | None = None, *, sort_metadata: bool = True) -> Written:
    """All rows, in order, in exactly the file `path`, which is replaced.

    The sort and the encoding of its output are distributed: every task of the sort writes its part to a staging
    directory. One task, of an executor and not the driver, then appends the parts in their order, a row group at a time;
    a Parquet file notes its sort order as it is written.
    """
    spark = frame.df.sparkSession
    check_file_path(path, fmt)
    checked_format(fmt), compression_options(compression)
    files, staging, ordering = Files(spark), _staging(path), list(frame.ordering) if sort_metadata else []
    whole = f"{staging}-whole.{fmt}"
    try:
        held(frame.df, list(frame.ordering)).write.format(checked_format(fmt)).save(staging)
        parts = [e.path for e in files.entries(staging) if e.name.startswith("part-")]

        def append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            listed = [p for b in batches for _, p in sorted(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))]
            if listed:
                out = _Stream(whole, _plain(open_footer(listed[0]).schema), fmt, compression, ordering)
                for p in listed:
                    for batch in file_batches(p):
                        out.append(batch)
                yield pa.RecordBatch.from_arrays([pa.array([out.close()])], names=["n"])

        order = spark.createDataFrame(list(enumerate(parts)), "i bigint, path string").coalesce(1).sortWithinPartitions("i")
        n = order.mapInArrow(append, "n bigint").agg(F.sum("n")).first()[0]
        files.rename(whole, path)
    finally:
        files.delete(staging)
        files.delete(whole)
    return Written(n, 1)


def interval_file_names(n: int, fmt: str = "parquet") -> list[str]:
    """`0.ext` and on, padded to the digits of the count."""
    width = len(str(n))
    return [f"{i:0{width}}.{fmt}" for i in range(n)]


def by_interval(df: DataFrame, points: SplitPoints, ordering: list[str]) -> DataFrame:
    """Rows with one partition per locus interval, sorted inside: one exchange and one pass, whatever the number of intervals."""
    how = representation(df.columns)
    index = interval_index(points, packed=F.col("locus")) if how == "packed" else interval_index(points, contig=F.col("contig"), position=F.col("position"))
    spread = df.withColumn("__interval", index).repartitionById(len(points) + 1, F.col("__interval"))
    return spread.sortWithinPartitions(*ascending(ordering)).drop("__interval")


def write_intervals(df: DataFrame, points: SplitPoints, ordering: list[str], path: str, fmt: str = "parquet", compression: str | None = None) -> Written:
    """A directory of one ordered file per interval, named by `interval_file_names`; an interval without rows gets an empty file.

    Each task writes its interval's file itself, with its sort order noted; the driver only moves the whole directory into
    place. A task that runs again replaces its own file.
    """
    spark = df.sparkSession
    check_directory_path(path)
    check_vacant(spark, path)
    checked_format(fmt), compression_options(compression)
    files, staging = Files(spark), _staging(path)
    names = interval_file_names(len(points) + 1, fmt)
    schema = to_arrow_schema(df.schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = TaskContext.get().partitionId()
        out = _Stream(f"{staging}/{names[i]}", schema, fmt, compression, ordering)
        for batch in batches:
            out.append(batch)
        yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([out.close()])], names=["i", "n"])

    try:
        done = by_interval(df, points, ordering).mapInArrow(write, "i bigint, n bigint").collect()
        for i in set(range(len(names))) - {x.i for x in done}:
            _Stream(f"{staging}/{names[i]}", schema, fmt, compression, ordering).close()
        files.publish(staging, path)
    finally:
        files.delete(staging)
    return Written(sum(x.n for x in done), len(names))


def write_one_file(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A small table as one file; the tables of a metrics directory are written so."""
    files, staging = Files(df.sparkSession), _staging(path)
    try:
        df.coalesce(1).write.format(checked_format(fmt)).save(staging)
        part = next(e for e in files.entries(staging) if e.name.startswith("part-"))
        files.rename(part.path, path)
    finally:
        files.delete(staging)


def partitions_for_bytes(total_bytes: int, target: int = 256 * 1024 * 1024) -> int:
    return max(1, math.ceil(total_bytes / target))
