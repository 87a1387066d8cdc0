"""Footer statistics of data files: order recovery, pruning, and dropping files without rows."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cmp_to_key
from sys import intern

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import orc
from pyspark.sql import SparkSession

from .files import arrow_path

#: Longer strings may be cut short in a footer, so bounds of this length are no exact bounds.
EXACT_STRING_BYTES = 64


@dataclass(frozen=True, slots=True)
class Bounds:
    low: object
    high: object
    exact: bool = True


@dataclass(frozen=True, slots=True)
class FileStatistics:
    path: str
    rows: int
    bounds: dict[str, Bounds] = field(default_factory=dict)
    nulls: dict[str, int] = field(default_factory=dict)
    #: Without the engine's notes; files of one schema share one.
    schema: pa.Schema | None = field(default=None, compare=False, repr=False)


#: Footers that are kept, the latest ones, and files from which on footers are read by tasks, not by the driver.
MOST_KEPT, BY_TASKS = 200_000, 128
_cache: dict[tuple, FileStatistics] = {}
_schemas: dict[bytes, pa.Schema] = {}


@dataclass(frozen=True)
class Footer:
    """Schema and rows of a file. ORC files hold no nullability and Arrow shows no bounds of theirs."""

    schema: pa.Schema
    rows: int
    parquet: pq.FileMetaData | None = None


def open_footer(path: str) -> Footer:
    fs, inner = arrow_path(path)
    with fs.open_input_file(inner) as f:
        if path.endswith(".orc"):
            file = orc.ORCFile(f)
            return Footer(file.schema, file.nrows)
        file = pq.ParquetFile(f)
        return Footer(file.schema_arrow, file.metadata.num_rows, file.metadata)


def read_columns(path: str, columns: list[str]) -> pa.Table:
    """Columns of a small file."""
    fs, inner = arrow_path(path)
    with fs.open_input_file(inner) as f:
        return orc.ORCFile(f).read(columns) if path.endswith(".orc") else pq.ParquetFile(f).read(columns)


def file_batches(path: str) -> Iterator[pa.RecordBatch]:
    """The rows of a file in their order, some at a time."""
    fs, inner = arrow_path(path)
    with fs.open_input_file(inner) as f:
        if path.endswith(".orc"):
            file = orc.ORCFile(f)
            for i in range(file.nstripes):
                yield file.read_stripe(i)
        else:
            yield from pq.ParquetFile(f).iter_batches()


def _read(path: str) -> FileStatistics:
    footer = open_footer(path)
    schema = _shared(footer.schema.remove_metadata().serialize().to_pybytes())
    if footer.parquet is None:
        return FileStatistics(path, footer.rows, schema=schema)
    meta = footer.parquet
    bounds: dict[str, Bounds] = {}
    nulls: dict[str, int] = {}
    for c in range(meta.num_columns):
        name = meta.schema.column(c).path
        found = [meta.row_group(g).column(c).statistics for g in range(meta.num_row_groups) if meta.row_group(g).num_rows]
        if found and all(s is not None and s.has_null_count for s in found):
            nulls[name] = sum(s.null_count for s in found)
        with_bounds = [s for s in found if s is not None and s.has_min_max]
        if found and len(with_bounds) == len(found):
            low, high = min(s.min for s in with_bounds), max(s.max for s in with_bounds)
            long = any(isinstance(x, (str, bytes)) and len(x.encode() if isinstance(x, str) else x) >= EXACT_STRING_BYTES for x in (low, high))
            bounds[name] = Bounds(low, high, not long)
    return FileStatistics(path, meta.num_rows, bounds, nulls, schema)


def _shared(schema: bytes) -> pa.Schema:
    if schema not in _schemas:
        _schemas[schema] = pa.ipc.read_schema(pa.BufferReader(schema))
    return _schemas[schema]


def _by_tasks(spark: SparkSession, paths: list[str]) -> list[FileStatistics]:
    """Footers read by the session's tasks; one short row a file comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_read(p) for p in batch.column(1).to_pylist()]
            # Plain values, since executors need no copy of the package.
            plain = [pickle.dumps((s.rows, {c: (b.low, b.high, b.exact) for c, b in s.bounds.items()}, s.nulls, s.schema.serialize().to_pybytes())) for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plain, pa.binary())], names=["i", "x"])

    rows = spark.createDataFrame(list(enumerate(paths)), "i bigint, path string").repartition(max(2, min(len(paths) // 32, 4 * spark.sparkContext.defaultParallelism)))
    out = []
    for r in sorted(rows.mapInArrow(run, "i bigint, x binary").collect()):
        n, bounds, nulls, schema = pickle.loads(r.x)
        out.append(FileStatistics(paths[r.i], n, {intern(c): Bounds(*b) for c, b in bounds.items()}, {intern(c): k for c, k in nulls.items()}, _shared(schema)))
    return out


def statistics(entries: list, spark: SparkSession | None = None, threads: int = 16) -> list[FileStatistics]:
    """Statistics of listed files, in their order; kept by path, size and time of change. Many files' footers are read by tasks."""
    keys = [(e.path, e.size, e.modified) for e in entries]
    missing = [k for k in dict.fromkeys(keys) if k not in _cache]
    if spark is not None and len(missing) >= BY_TASKS:
        found = _by_tasks(spark, [k[0] for k in missing])
    else:
        with ThreadPoolExecutor(threads) as pool:
            found = list(pool.map(lambda k: _read(k[0]), missing))
    new = dict(zip(missing, found))
    out = [new.get(k) or _cache[k] for k in keys]
    _cache.update(new)
    for k in list(_cache)[: max(0, len(_cache) - MOST_KEPT)]:
        del _cache[k]
    return out


class UnusableStatistics(ValueError):
    """A file's footer doesn't bound a column that its order rests on."""


class OrderRefuted(ValueError):
    """Footers show that files overlap, so no order of the files orders the rows."""


def recovered_order(files: list[FileStatistics], columns: list[str], descending: frozenset[str] | set[str] = frozenset()) -> list[FileStatistics]:
    """Files in an order in which their rows may follow one another by `columns`; files without rows left out.

    Columns are ascending but for those in `descending`. A file is placed by the columns up to the first that isn't
    constant in it: by its first values, then its last. Files that touch at a bound are in order. Raises
    UnusableStatistics (also for columns whose types differ between files) or OrderRefuted, naming the files.
    """
    placed = []
    for f in files:
        if f.rows == 0:
            continue
        first, last = [], []
        for c in columns:
            b = f.bounds.get(c)
            if b is None or not b.exact or f.nulls.get(c, 0) or b.low > b.high:
                raise UnusableStatistics(f"{f.path}: no usable statistics of the column {c}")
            ends = (b.high, b.low) if c in descending else (b.low, b.high)
            first.append(ends[0])
            last.append(ends[1])
            if b.low != b.high:
                break
        placed.append((first, last, f))

    def compared(x: list, y: list) -> int:
        """-1, 0 or 1 by the columns that both keys hold."""
        for c, a, b in zip(columns, x, y):
            try:
                if a != b:
                    return -1 if (a > b if c in descending else a < b) else 1
            except TypeError as e:
                raise UnusableStatistics(f"the column {c} has values of different types in different files") from e
        return 0

    placed.sort(key=cmp_to_key(lambda x, y: compared(x[0], y[0]) or compared(x[1], y[1]) or len(x[0]) - len(y[0])))
    for (_, last, f), (first, _, g) in zip(placed, placed[1:]):
        if compared(last, first) > 0:
            raise OrderRefuted(f"{f.path} and {g.path} overlap in {', '.join(columns[: min(len(last), len(first))])}")
    return [f for *_, f in placed]


def pruned(files: list[FileStatistics], bounds: dict[str, tuple[object, object]]) -> list[FileStatistics]:
    """Files that may hold a row with every column within its (low, high), both inclusive, None for open ends.

    Missing or inexact statistics always keep a file.
    """

    def may(f: FileStatistics) -> bool:
        for c, (low, high) in bounds.items():
            b = f.bounds.get(c)
            if b is None or not b.exact:
                continue
            if (low is not None and b.high < low) or (high is not None and b.low > high):
                return False
        return True

    return [f for f in files if may(f)]
