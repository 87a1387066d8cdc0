"""Sample annotation tables: one column `s`, written last, whose presence says that a table is complete."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import orc
from pyspark.sql import SparkSession

from .files import Files, arrow_path
from .statistics import open_footer, read_columns

SCHEMA = pa.schema([pa.field("s", pa.string(), nullable=False)])


class AnnotationError(ValueError):
    """A sample annotation table that can't be one."""


def annotation_path(table_path: str, fmt: str = "parquet") -> str:
    """`<stem>.samples.<ext>` beside the file or directory."""
    path = table_path.rstrip("/")
    return f"{path.removesuffix('.' + fmt)}.samples.{fmt}"


def read_samples(path: str) -> list[str]:
    """The samples of an annotation table, sorted. Columns besides `s` are ignored."""
    schema = open_footer(path).schema
    if "s" not in schema.names:
        raise AnnotationError(f"{path} has no column s")
    # ORC doesn't note whether a column may be null.
    if schema.field("s").nullable and not path.endswith(".orc"):
        raise AnnotationError(f"{path}: the column s is nullable")
    samples = read_columns(path, ["s"]).column("s").to_pylist()
    if not samples:
        raise AnnotationError(f"{path} names no samples")
    if None in samples:
        raise AnnotationError(f"{path} has a null sample")
    if len(set(samples)) < len(samples):
        raise AnnotationError(f"{path} names a sample twice")
    return sorted(samples)


def annotated(spark: SparkSession, table_path: str, samples: list[str], write: Callable[[], None], fmt: str = "parquet") -> str:
    """Run `write` between the removal of an old annotation and the writing of the new one; a failure leaves none."""
    files, path = Files(spark), annotation_path(table_path, fmt)
    if not samples:
        raise AnnotationError("no samples to annotate")
    if files.exists(path):
        files.delete(path)
    write()
    table = pa.table({"s": pa.array(sorted(set(samples)), pa.string())}, schema=SCHEMA)
    source, inner = arrow_path(path)
    with source.open_output_stream(inner) as out:
        orc.write_table(table, out) if fmt == "orc" else pq.write_table(table, out)
    return path
