"""Datasets: directories of input tables under a declared row ordering."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.locus import LocusInterval
from ..plans.ordering import RowOrdering, representation
from .annotation import read_samples
from .files import Entry, Files, checked_format
from .statistics import FileStatistics, file_batches, open_footer, pruned, recovered_order, statistics


class DatasetError(ValueError):
    """A directory that isn't a dataset, or not a whole one."""


@dataclass(frozen=True)
class InputTable:
    """One sorted table and its samples. kind: single_sample, multi_sample_file or multi_sample_directory."""

    name: str
    kind: str
    path: str
    samples: tuple[str, ...]


@dataclass(frozen=True)
class RootEntries:
    """What one listing of a dataset's root holds."""

    single_samples: dict[str, str] = field(default_factory=dict)
    files: dict[str, str] = field(default_factory=dict)
    directories: dict[str, str] = field(default_factory=dict)
    annotations: dict[str, str] = field(default_factory=dict)


def classified(entries: list[Entry], fmt: str = "parquet") -> RootEntries:
    """Sort a root's entries into kinds; hidden names (a leading dot) are passed over."""
    out = RootEntries()
    for e in entries:
        if e.name.startswith("."):
            continue
        stem = e.name.removesuffix(f".{fmt}")
        if e.is_dir and e.name.startswith("s="):
            if not e.name[2:]:
                raise DatasetError(f"{e.path} names no sample")
            out.single_samples[e.name[2:]] = e.path
        elif e.is_dir:
            out.directories[e.name] = e.path
        elif e.name.endswith(f".samples.{fmt}"):
            out.annotations[e.name.removesuffix(f".samples.{fmt}")] = e.path
        elif stem != e.name and stem:
            out.files[stem] = e.path
        else:
            raise DatasetError(f"unknown entry {e.path}")
    return out


def input_tables(root: RootEntries) -> list[InputTable]:
    """The input tables of a root, in name order; every multi-sample table needs its annotation, and the other way round."""
    if both := sorted(set(root.files) & set(root.directories)):
        raise DatasetError(f"both a file and a directory are named {', '.join(both)}")
    multi = {**{n: ("multi_sample_file", p) for n, p in root.files.items()}, **{n: ("multi_sample_directory", p) for n, p in root.directories.items()}}
    if missing := sorted(set(multi) - set(root.annotations)):
        raise DatasetError(f"incomplete write: no sample annotation for {', '.join(missing)}")
    if orphan := sorted(set(root.annotations) - set(multi)):
        raise DatasetError(f"sample annotation without data: {', '.join(orphan)}")
    tables = [InputTable(f"s={s}", "single_sample", p, (s,)) for s, p in root.single_samples.items()]
    tables += [InputTable(n, kind, p, tuple(read_samples(root.annotations[n]))) for n, (kind, p) in multi.items()]
    seen: dict[str, str] = {}
    for t in sorted(tables, key=lambda t: t.name):
        for s in t.samples:
            if s in seen:
                raise DatasetError(f"the sample {s} is in both {seen[s]} and {t.name}")
            seen[s] = t.name
    return sorted(tables, key=lambda t: t.name)


def _fields(schema: pa.Schema) -> dict[str, str]:
    return {f.name: f"{f.name}: {f.type}{'?' if f.nullable else ''}" for f in schema if f.name != "s"}


@dataclass(frozen=True)
class Dataset:
    spark: SparkSession
    path: str
    fmt: str
    ordering: RowOrdering
    tables: tuple[InputTable, ...]
    schema: pa.Schema

    @classmethod
    def discover(cls, spark: SparkSession, path: str, ordering: RowOrdering | str, fmt: str = "parquet", schema: pa.Schema | None = None) -> Dataset:
        """List a root once, pair data with annotations, and take the schema of the first file that has rows (footers
        hold nullability, which Spark's reader doesn't show). Every other table's first such file must agree. With a
        given schema no data file is opened."""
        checked_format(fmt)
        ordering = RowOrdering.parse(ordering) if isinstance(ordering, str) else ordering
        files = Files(spark)
        if not files.exists(path):
            raise DatasetError(f"{path} doesn't exist")
        tables = input_tables(classified(files.entries(path), fmt))
        if not tables:
            raise DatasetError(f"{path} has no input tables")
        if schema is None:
            first: tuple[InputTable, pa.Schema] | None = None
            for t, of_table in table_statistics(spark, path, fmt, tables):
                for s in of_table:
                    if s.rows:
                        found = s.schema
                        if "s" in found.names and (t.kind == "single_sample" or (found.field("s").nullable and fmt != "orc")):
                            raise DatasetError(f"{t.name}: the column s is {'stored in a single-sample table' if t.kind == 'single_sample' else 'nullable'}")
                        if "s" not in found.names and t.kind != "single_sample":
                            raise DatasetError(f"{t.name} has several samples and no column s")
                        if first is None:
                            first = (t, found)
                        elif (a := _fields(first[1])) != (b := _fields(found)):
                            lacks, extra = sorted(set(a.values()) - set(b.values())), sorted(set(b.values()) - set(a.values()))
                            raise DatasetError(f"{t.name} differs in schema: it lacks the dataset's [{', '.join(lacks)}] and the dataset lacks its [{', '.join(extra)}]")
                        break
            if first is None:
                raise DatasetError(f"{path} has no rows to take a schema from")
            schema = first[1]
        plain = pa.schema([f for f in schema if f.name != "s"])
        representation(plain.names)
        ordering.columns([*plain.names, "s"])
        return cls(spark, path, fmt, ordering, tuple(tables), plain)

    @property
    def samples(self) -> list[str]:
        return sorted(s for t in self.tables for s in t.samples)

    @property
    def columns(self) -> list[str]:
        return [*self.schema.names, "s"]

    def sort_columns(self) -> list[str]:
        return self.ordering.columns(self.columns)

    def restrict_to(self, names: list[str]) -> Dataset:
        """Only the named input tables, in name order; a name may repeat."""
        if not names:
            raise DatasetError("no input tables to restrict to")
        if unknown := sorted(set(names) - {t.name for t in self.tables}):
            raise DatasetError(f"unknown input tables: {', '.join(unknown)}")
        return replace(self, tables=tuple(t for t in self.tables if t.name in names))

    def files(self, table: InputTable) -> list[FileStatistics]:
        return statistics(Files(self.spark).data_files(table.path, f".{self.fmt}"), self.spark)

    def frame(self, table: InputTable, interval: LocusInterval | None = None, within: dict[str, tuple] | None = None) -> DataFrame:
        """One input table, `s` last. Single samples get theirs as a constant, on which filters fold at planning time.

        With an interval, or with `within` (column: least and greatest value, None for open ends), files whose footers rule
        all rows out are left out of the plan before Spark sees them; so is a single sample's table by its `s`.
        """
        return self._frame(table, self._kept(table, self.files(table), interval, within or {}), interval, within or {})

    def _kept(self, table: InputTable, files: list[FileStatistics], interval: LocusInterval | None, within: dict[str, tuple]) -> list[FileStatistics]:
        """The files of a table that may hold rows of an interval and within bounds."""
        files = [f for f in files if f.rows]
        low, high = within.get("s", (None, None))
        if table.kind == "single_sample" and ((low is not None and table.samples[0] < low) or (high is not None and table.samples[0] > high)):
            files = []
        files = pruned(files, {c: b for c, b in within.items() if c != "s" or table.kind != "single_sample"})
        if interval is not None and files:
            files = pruned(files, interval_bounds(interval, representation(self.schema.names)))
        return files

    def _frame(self, table: InputTable, files: list[FileStatistics], interval: LocusInterval | None, within: dict[str, tuple]) -> DataFrame:
        kept = [F.col(f"`{c}`") for c in self.schema.names]
        if not files:
            empty = self.spark.createDataFrame([], _spark_schema(self.schema))
            return empty.withColumn("s", F.lit(table.samples[0] if table.kind == "single_sample" else None).cast("string"))
        df = loaded(self.spark, self.fmt, [f.path for f in files])
        if table.kind == "single_sample":
            df = df.select(*kept, F.lit(table.samples[0]).alias("s"))
        else:
            df = df.select(*kept, "s")
        return self._filtered(df, interval, within)

    def _filtered(self, df: DataFrame, interval: LocusInterval | None, within: dict[str, tuple]) -> DataFrame:
        if interval is not None:
            df = df.where(interval_predicate(interval, representation(self.schema.names)))
        for c, (low, high) in within.items():
            df = df if low is None else df.where(F.col(f"`{c}`") >= F.lit(low))
            df = df if high is None else df.where(F.col(f"`{c}`") <= F.lit(high))
        return df

    def frames(self, interval: LocusInterval | None = None, within: dict[str, tuple] | None = None) -> list[DataFrame]:
        """All input tables in few frames, in name order: one frame a multi-sample table, and one scan for all single samples,
        in the first one's place, so that a plan doesn't grow with the samples. `s` is a partition column of that scan.

        Single samples that the engine's reader would name or list otherwise have a frame each.
        """
        within = within or {}
        found = [(t, self._kept(t, f, interval, within)) for t, f in table_statistics(self.spark, self.path, self.fmt, self.tables)]
        found = [x for x in found if x[1]] or found[:1]
        shared = [f.path for t, files in found if _shareable(t, files) for f in files]
        out, scanned = [], False
        for t, files in found:
            if not _shareable(t, files):
                out.append(self._frame(t, files, interval, within))
            elif not scanned:
                scanned = True
                schema = self.spark.read.format(checked_format(self.fmt)).load(shared[0]).schema.add("s", "string")
                with listing_tasks(self.spark):
                    df = self.spark.read.format(checked_format(self.fmt)).schema(schema).option("basePath", self.path).load(shared)
                # Never null here, as the constant of a single frame isn't; the coalesce says so in the schema.
                df = df.select(*(F.col(f"`{c}`") for c in self.schema.names), F.coalesce("s", F.lit("")).alias("s"))
                out.append(self._filtered(df, interval, within))
        return out

    def read(self, interval: LocusInterval | None = None, within: dict[str, tuple] | None = None) -> DataFrame:
        """Union of all input tables."""
        return reduce(DataFrame.unionByName, self.frames(interval, within))

    def file_order(self, table: InputTable) -> list[FileStatistics]:
        """The table's files in the order of its rows, as its footers show it."""
        stored = [c for c in self.sort_columns() if c != "s" or table.kind != "single_sample"]
        return recovered_order(self.files(table), stored)

    def describe(self) -> str:
        """A description that rebuilds the dataset elsewhere; it plans, but reads nothing."""
        return json.dumps({"version": 1, "path": self.path, "format": self.fmt, "ordering": str(self.ordering), "tables": [t.name for t in self.tables], "schema": sorted(_fields(self.schema).values())})

    @classmethod
    def reopen(cls, spark: SparkSession, description: str) -> Dataset:
        """Discover a described dataset again; its schema must be what it was."""
        d = json.loads(description)
        if d.get("version") != 1:
            raise DatasetError(f"unsupported description version {d.get('version')}")
        found = cls.discover(spark, d["path"], d["ordering"], d["format"]).restrict_to(d["tables"])
        if sorted(_fields(found.schema).values()) != d["schema"]:
            raise DatasetError("the dataset's schema has changed since it was described")
        return found


def table_statistics(spark: SparkSession, path: str, fmt: str, tables: Iterable[InputTable]) -> list[tuple[InputTable, list[FileStatistics]]]:
    """Statistics of the files of each of many tables below `path`, by one listing and one reading of footers."""
    trees = Files(spark).trees(path, f".{fmt}")
    listed = [(t, trees.get(t.path.rstrip("/").rsplit("/", 1)[-1], [])) for t in tables]
    found = iter(statistics([e for _, entries in listed for e in entries], spark))
    return [(t, [next(found) for _ in entries]) for t, entries in listed]


def _shareable(table: InputTable, files: list[FileStatistics]) -> bool:
    """Whether the engine reads a single sample's files from a listing with the name in their path: no name that it decodes,
    no file that it hides, none in a directory below."""
    plain = table.kind == "single_sample" and "%" not in table.samples[0] and table.samples[0] != "__HIVE_DEFAULT_PARTITION__"
    return plain and bool(files) and all(f.path.rsplit("/", 2)[-2] == table.name and not f.path.rsplit("/", 1)[-1].startswith("_") for f in files)


@contextmanager
def listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Long lists of files are looked up by a few tasks a core instead of a task a file."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Bytes that opening a file counts as when small files are packed into tasks; the engine's own 4 MB puts four small files into a task of 16 MB.
OPENING = 128 * 1024


@contextmanager
def packed_scans(spark: SparkSession) -> Iterator[None]:
    """Plans that run inside read many small files a task, so that tasks, of each of which the driver keeps what it
    reported, grow with the bytes and not with the files."""
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(spark._jsparkSession.sessionState().conf().filesOpenCostInBytes(), OPENING)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def loaded(spark: SparkSession, fmt: str, paths: list[str]) -> DataFrame:
    """The listed files. The engine's readers pass over names that begin with an underscore; such files are read by tasks
    through Arrow, with the others' schema."""
    own = [p for p in paths if p.rsplit("/", 1)[-1].startswith("_")]
    rest = [p for p in paths if p not in set(own)]
    frames = [spark.read.format(checked_format(fmt)).load(rest)] if rest else []
    if own:
        schema = frames[0].schema if frames else _spark_schema(open_footer(own[0]).schema)
        names = schema.names

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for listed in batches:
                for p in listed.column(0).to_pylist():
                    for batch in file_batches(p):
                        yield batch.select(names)

        frames.append(spark.createDataFrame([(p,) for p in own], "path string").repartition(len(own)).mapInArrow(read, schema))
    return reduce(DataFrame.unionByName, frames)


def interval_predicate(interval: LocusInterval, how: str):
    if how == "packed":
        return interval.predicate(packed=F.col("locus"))
    return interval.predicate(contig=F.col("contig"), position=F.col("position"))


def interval_bounds(interval: LocusInterval, how: str) -> dict[str, tuple]:
    """Bounds that rows of an interval have, for pruning by footers."""
    low, high = interval.low, interval.high
    if how == "packed":
        return {"locus": (low and low.packed, high and high.packed)}
    out = {"contig": (low and low.contig, high and high.contig)}
    if low and high and low.contig == high.contig:
        out["position"] = (low.position, high.position)
    return out


def _spark_schema(schema: pa.Schema):
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)


@dataclass(frozen=True)
class LocusTable:
    """A file or directory ordered by locus, without samples."""

    spark: SparkSession
    path: str
    fmt: str = "parquet"

    def read(self) -> DataFrame:
        files = [f.path for f in statistics(Files(self.spark).data_files(self.path, f".{self.fmt}"), self.spark) if f.rows]
        if not files:
            raise DatasetError(f"{self.path} has no rows")
        df = loaded(self.spark, self.fmt, files)
        representation(df.columns)
        return df

    def ordering(self) -> list[str]:
        return RowOrdering.parse("locus").columns(self.read().columns)

    def file_order(self) -> list[FileStatistics]:
        return recovered_order(statistics(Files(self.spark).data_files(self.path, f".{self.fmt}"), self.spark), self.ordering())
