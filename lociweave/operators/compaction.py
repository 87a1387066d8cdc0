"""Consolidating many small files: reports, a packing plan, the consolidated records, and the physical rewrite."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import partitions_for
from .running import differs, running_total

MIB = 1024 * 1024
SMALL_MEAN, LEAST_FILES = MIB, 8
#: Bytes that opening a file costs as much as reading; the engine's 4 MiB would put only 32 tiny files into a split of 128 MiB.
TARGET_BYTES, OPEN_COST = 128 * MIB, 16 * 1024
#: Files that one task opens at most; a reader keeps something of each until its task ends.
MOST_FILES = 1000
#: For listings, which open no file: about as many tasks as the session has cores.
LISTING = {"spark__sql__files__maxPartitionBytes": 1 << 50, "spark__sql__files__openCostInBytes": 1 << 27}


def is_data_file(path: Column) -> Column:
    """Neither a sample annotation table (`<name>.samples.parquet`) nor below or itself a name that starts with a dot."""
    return ~path.rlike(r"(^|/)\.") & ~path.rlike(r"(^|/)[^/]+\.samples\.parquet$")


def data_files(listing: DataFrame, table: list[str], *, path: str = "path", size: str = "n_bytes", listed_at: str = "listed_at") -> DataFrame:
    """The distinct data files of a listing with the size of the latest listing of each (`path`, `size`).

    At equal times the greater size counts, null times come first, a null size is 0 bytes. Null paths are left out.
    """
    files = listing.where(F.col(path).isNotNull() & is_data_file(F.col(path)))
    latest = files.groupBy(*table, path).agg(F.max(F.struct(F.col(listed_at).alias("at"), F.col(size).alias("size"))).alias("x"))
    return latest.select(*table, F.col(path).alias("path"), F.coalesce(F.col("x.size"), F.lit(0)).cast("bigint").alias("size"))


def packing_plan(files: DataFrame, table: list[str], *, target: int = TARGET_BYTES, open_cost: int = OPEN_COST) -> DataFrame:
    """The output file (`out_file`, from 0) of every file below `target` bytes, of each table; larger files keep a null.

    As the engine packs splits: a file weighs its size plus the open cost. Files follow one another in order of path, and
    a table's weights are cut into round(total / target) even parts, so each output file holds consecutive inputs and
    comes out near the target. Running weights come from a distributed sort; a table of any number of files spreads.
    The result has the table's columns, path, size, out_file, and out_files (the table's number of output files).
    """
    weighed = files.withColumn("weight", F.when(F.col("size") < target, F.col("size") + open_cost).otherwise(0))
    run = running_total(weighed, table, ["path"], "weight", name="upto", total="whole")
    parts = F.greatest(F.round(F.col("whole") / target), F.lit(1)).cast("bigint")
    middle = F.col("upto") - F.col("weight") + F.expr("weight div 2")
    out = run.withColumn("out_files", parts).withColumn("out_file", F.when(F.col("size") < target, F.least(F.floor(middle.cast("double") * parts / F.col("whole")).cast("bigint"), parts - 1)))
    return out.select(*table, "path", "size", "out_file", "out_files")


def table_report(files: DataFrame, table: list[str], *, small_mean: int = SMALL_MEAN, least_files: int = LEAST_FILES) -> DataFrame:
    """Per table: files, bytes, mean size, and whether it consists of many small files (`fragmented`)."""
    out = files.groupBy(*table).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return out.withColumn("fragmented", (F.col("files") >= least_files) & (F.col("bytes") < F.col("files") * small_mean))


def consolidated(rows: DataFrame, plan: DataFrame, table: list[str], *, path: str = "path") -> DataFrame:
    """Every record of `rows` with its table and output file; a record of an unplanned path keeps nulls. Rows neither
    vanish nor double, since a plan holds each path once."""
    named = plan.select(F.col("path").alias("__path"), *(F.col(t).alias(f"__t{i}") for i, t in enumerate(table)), F.col("out_file").alias("__out"))
    joined = rows.join(named, F.col(path) == F.col("__path"), "left")
    return joined.select(*(F.col(f"__t{i}").alias(t) for i, t in enumerate(table)), F.col("__out").alias("out_file"), *rows.columns)


@dataclass(frozen=True)
class Compaction:
    files_before: int
    files_after: int
    bytes_before: int
    bytes_after: int
    rows: int
    checksum: str
    #: Rows and checksum of what was written, read again.
    rows_after: int = 0
    checksum_after: str = ""


class VerificationError(RuntimeError):
    """The written records aren't those that were read; nothing was published."""


@contextmanager
def _tuned(spark: SparkSession, **conf: int):
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _fingerprint(df: DataFrame) -> tuple[int, str]:
    """Rows and an order-free checksum (sums of two hashes of all columns, by name), in one aggregation."""
    cols = [F.col(f"`{c}`") for c in sorted(df.columns)]
    whole = F.struct(*cols)
    got = df.select(F.xxhash64(whole).cast("decimal(38,0)").alias("a"), F.hash(whole).cast("bigint").alias("b")).agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    return got.n, f"{got.a or 0}/{got.b or 0}"


def listed(spark: SparkSession, path: str) -> DataFrame:
    """The files (path, size) at or below `path`, at any depth, as the engine lists them: directories in parallel by its
    tasks, names that begin with a dot or an underscore left out. No file is opened, nothing is collected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(_literal(path))
    return files.select("path", F.col("length").alias("size"))


def _unreadable(spark: SparkSession, root: str, depth: int, suffix: str) -> list[str]:
    """Data files that the engine passes over because a name in their path begins with an underscore.

    One glob a level of depth, answered inside the file system's client; only what lies below such names is walked.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for level in range(depth + 1):
        for x in fs.globStatus(path(f"{_literal(root)}{'/*' * level}/_*")) or ():
            name, inside = x.getPath().getName(), x.getPath().toUri().getPath()
            # As in the engine, a key=value directory may begin with an underscore.
            if "=" in name or "/." in inside[len(path(root).toUri().getPath()) :]:
                continue
            walk = fs.listFiles(x.getPath(), True)
            while walk.hasNext():
                if (p := walk.next().getPath().toString()).endswith(suffix):
                    found.append(p)
    return sorted(set(found))


def _literal(path: str) -> str:
    return re.sub(r"([\\{}\[\]*?,])", r"\\\1", path)


#: A key=value directory inside a path, and the most directories below which such may begin.
KEYED = "/[^/=]+=[^/]*/"
MOST_BASES = 1000


def _read(spark: SparkSession, root: str, files: DataFrame, fmt: str) -> list[DataFrame]:
    """Frames that together have all listed `files`, which lie below `root` at any depth; most often one. Keys of key=value
    directories are columns, and so is every column that only some files have."""
    # By the directory below which key=value directories begin; the engine takes one such directory at a time.
    inside = F.substring("path", len(root) + 1, 1 << 30)
    bases = [x[0] for x in files.select(F.when(inside.rlike(KEYED), F.regexp_extract(inside, f"^(.*?){KEYED}", 1))).distinct().limit(MOST_BASES + 1).collect()]
    if len(bases) > MOST_BASES:
        raise ValueError(f"key=value directories begin below more than {MOST_BASES} directories")
    reader = lambda **options: spark.read.format(fmt).options(mergeSchema=True, **options)
    keyed = [reader(basePath=root + b).load(f"{_literal(root + b)}/*=*") for b in sorted(b for b in bases if b is not None)]
    if keyed and None not in bases:
        return keyed
    if not keyed:
        return [reader(recursiveFileLookup=True).load(_literal(root))]
    # Plain files beside such directories: only the older reader tells files apart by name.
    with _tuned(spark, spark__sql__sources__useV1SourceList=fmt):
        plain = reader(recursiveFileLookup=True).load(_literal(root))
        return [*keyed, plain.where(~F.substring("_metadata.file_path", len(root) + 1, 1 << 30).rlike(KEYED))]


def _planned(read: list[DataFrame], files: DataFrame, root: str, n: int) -> int:
    """How many of the listed files the frames read."""
    found = [len(df._jdf.inputFiles()) for df in read]
    if len(found) == 1:
        return found[0]
    keyed = files.where(F.substring("path", len(root) + 1, 1 << 30).rlike(KEYED)).count()
    # The frame of plain files lists all of them and leaves the others out as it reads.
    return sum(found) if keyed == n else sum(found[:-1]) + found[-1] - keyed


def compact(spark: SparkSession, source: str, target: str, *, by: list[str] | None = None, target_bytes: int = TARGET_BYTES, open_cost: int = OPEN_COST, least_mean: int = SMALL_MEAN, fmt: str = "parquet") -> Compaction:
    """Rewrite the files below `source`, at any depth, as fewer, larger files in the new directory `target`.

    The engine's own split packing does the work: the maximum partition size and the file-open cost are tuned so that
    one split combines as many small files as come near `target_bytes`; a map-only job reads each combined split and
    writes one file, and a narrow coalesce lowers the number further where splits are cut finer; nothing is shuffled.

    `by` names key=value directories of the source that are kept apart (an input table each, say): the reader packs files
    directory by directory, so a split holds whole directories, or a part of a large one, and its task writes one file
    for each. All of them are compacted by the one job.

    Files are listed by the engine's tasks, and the number of files that the plan reads is held against the listing. They
    are written to a staging directory, read again and held against the source by row count and an order-free checksum,
    and only then moved to `target` by one rename. If verification fails, staging is removed and VerificationError
    raised; an existing target is refused. Names that begin with a dot are hidden; data files whose name, or a
    directory's above them, begins with an underscore are refused. An empty source gives a target without records.
    """
    jvm = spark.sparkContext._jvm
    final = jvm.org.apache.hadoop.fs.Path(target)
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(final):
        raise FileExistsError(target)
    root = jvm.org.apache.hadoop.fs.Path(source)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString()
    before = listed(spark, root)
    with _tuned(spark, **LISTING):
        counted = before.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.max(F.size(F.split("path", "/"))).alias("depth")).first()
    depth = max(1, counted.depth - len(root.split("/"))) if counted.n else 1
    if lost := _unreadable(spark, root, depth, f".{fmt}"):
        raise ValueError(f"the engine reads no names that begin with an underscore: {', '.join(lost[:10])}")
    mean = counted.size / max(1, counted.n)
    # Small files shall meet in a split in such number that the split's data, not its open costs, fills it.
    cost = max(1, min(open_cost, math.ceil(mean / 8)), target_bytes // MOST_FILES) if mean < least_mean else open_cost
    parts = max(1, round(counted.size / target_bytes), -(-counted.n // MOST_FILES))
    staging = f"{target.rstrip('/')}-staging-{uuid.uuid4().hex}"
    # The newer reader packs each directory's files together; the older one mixes directories by size of file.
    with _tuned(spark, spark__sql__files__maxPartitionBytes=max(target_bytes, 1), spark__sql__files__openCostInBytes=cost, spark__sql__files__minPartitionNum=1, spark__sql__parquet__columnarReaderBatchSize=512 if mean < least_mean else 4096, spark__sql__sources__useV1SourceList="" if by else fmt):
        read = _read(spark, root, before, fmt)
        planned = _planned(read, before, root, counted.n)
        if planned != counted.n:
            raise VerificationError(f"{counted.n} files are listed, {planned} would be read")
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read)
        writer = rows.coalesce(parts).write.format(fmt)
        (writer.partitionBy(*by) if by else writer).save(staging)
        try:
            was, now = _fingerprint(rows), _fingerprint(spark.read.format(fmt).schema(rows.schema).load(staging))
            if was != now:
                raise VerificationError(f"read {was[0]} rows, wrote {now[0]}, or their contents differ")
            fs.mkdirs(final.getParent())
            if not fs.rename(jvm.org.apache.hadoop.fs.Path(staging), final):
                raise VerificationError(f"could not publish {target}")
        finally:
            fs.delete(jvm.org.apache.hadoop.fs.Path(staging), True)
    with _tuned(spark, **LISTING):
        after = listed(spark, target).agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    return Compaction(counted.n, after.n, counted.size, after.size, *was, *now)


def laid_out(rows: DataFrame, table: list[str], path: str, folder: str, *, most_rows: int = 100_000) -> tuple[int, int]:
    """Write `rows` below `folder` as one small Parquet file a path (more for one of over `most_rows` rows) in the
    key=value directory of its table, and give the numbers of files and rows.

    Files are named by hash and moved into place when whole, so a task that runs again writes the same files again.
    `folder` is one that all executors reach by the same name.
    """
    data = [c for c in rows.columns if c not in table]
    at = [rows.columns.index(c) for c in table]
    kept = [rows.columns.index(c) for c in data]
    path_at = data.index(path)
    spread = rows.repartition(partitions_for(rows.sparkSession), F.col(f"`{path}`")).sortWithinPartitions(path, *table)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import md5
        from urllib.parse import quote

        fs, base = pafs.FileSystem.from_uri(folder if "://" in folder else folder.removeprefix("file:"))
        made, held, now, files, n = set(), [], None, 0, 0

        def flush() -> None:
            nonlocal files, n
            t = pa.Table.from_batches(held)
            n += t.num_rows
            where = "/".join([base, *(f"{c}={quote(str(v), safe='')}" for c, v in zip(table, now[0]))])
            if where not in made:
                fs.create_dir(where, recursive=True)
                made.add(where)
            name = md5(str(now[1]).encode()).hexdigest()
            for k in range(0, t.num_rows, most_rows):
                with fs.open_output_stream(f"{where}/.{name}-{k}") as out:
                    pq.write_table(t.slice(k, most_rows), out)
                fs.move(f"{where}/.{name}-{k}", f"{where}/{name}-{k}.parquet")
                files += 1

        for batch in batches:
            own = pa.RecordBatch.from_arrays([batch.column(i) for i in kept], names=data)
            keys = [batch.column(i) for i in at]
            p = own.column(path_at)
            opens = np.zeros(len(p), bool)
            for c in (p, *keys):
                opens[1:] |= differs(c[1:], c[:-1])
            starts = [0, *np.flatnonzero(opens).tolist(), len(p)]
            for a, b in zip(starts, starts[1:]):
                if b > a:
                    key = (tuple(k[a].as_py() for k in keys), p[a].as_py())
                    if key != now and held:
                        flush()
                        held.clear()
                    now = key
                    held.append(own.slice(a, b - a))
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([files]), pa.array([n])], names=["files", "n"])

    done = spread.mapInArrow(write, "files bigint, n bigint").agg(F.sum("files").alias("files"), F.sum("n").alias("n")).first()
    return done.files or 0, done.n or 0
