"""File system helpers over Hadoop paths, formats and compression modes."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import SparkSession

#: Formats and codecs with a Spark writer here. Fixed values.
FORMATS = {"parquet": "parquet", "orc": "orc"}
CODECS = {"uncompressed": None, "snappy": None, "lz4": None, "lz4_raw": None, "gzip": (0, 9), "zstd": (1, 22)}
SCHEMES = ("", "file", "gs", "hdfs", "s3a")


@dataclass(frozen=True)
class Entry:
    name: str
    path: str
    is_dir: bool
    size: int
    modified: int


class Files:
    """Listing, moving and removing through the session's Hadoop file systems."""

    def __init__(self, spark: SparkSession):
        self.spark, self._jvm = spark, spark.sparkContext._jvm

    def path(self, p: str):
        check_scheme(p)
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def fs(self, p: str):
        return self.path(p).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, p: str) -> bool:
        return self.fs(p).exists(self.path(p))

    def is_file(self, p: str) -> bool:
        return self.exists(p) and self.fs(p).getFileStatus(self.path(p)).isFile()

    def entries(self, p: str) -> list[Entry]:
        """One listing of a directory, in name order."""
        out = [Entry(x.getPath().getName(), x.getPath().toString(), x.isDirectory(), x.getLen(), x.getModificationTime()) for x in self.fs(p).listStatus(self.path(p))]
        return sorted(out, key=lambda e: e.name)

    def data_files(self, p: str, suffix: str) -> list[Entry]:
        """Files with the suffix at or below `p`; below it, names that begin with a dot are hidden at any depth."""
        if self.is_file(p):
            s = self.fs(p).getFileStatus(self.path(p))
            return [Entry(s.getPath().getName(), s.getPath().toString(), False, s.getLen(), s.getModificationTime())]
        out: list[Entry] = []
        for e in self.entries(p):
            if e.name.startswith("."):
                continue
            if e.is_dir:
                out += self.data_files(e.path, suffix)
            elif e.name.endswith(suffix):
                out.append(e)
        return out

    def trees(self, p: str, suffix: str) -> dict[str, list[Entry]]:
        """`data_files` of every entry of the directory `p`, by name and by one listing: as many calls for thousands as for one."""
        root = self.fs(p).getFileStatus(self.path(p)).getPath().toString()
        source, inner = arrow_path(root)
        found = []
        for x in source.get_file_info(pafs.FileSelector(inner, recursive=True)):
            below = x.path[len(inner.rstrip("/")) :].lstrip("/")
            names = tuple(below.split("/"))
            if x.type == pafs.FileType.File and (len(names) == 1 or names[-1].endswith(suffix)) and not any(n.startswith(".") for n in names[1:]):
                found.append((names, Entry(names[-1], f"{root.rstrip('/')}/{below}", False, x.size, x.mtime_ns // 10**6)))
        out: dict[str, list[Entry]] = {}
        for names, e in sorted(found, key=lambda x: x[0]):
            out.setdefault(names[0], []).append(e)
        return out

    def delete(self, p: str) -> None:
        self.fs(p).delete(self.path(p), True)

    def rename(self, a: str, b: str) -> None:
        """Move a file to `b`. A file that is there is put aside first and comes back if the move fails."""
        fs = self.fs(b)
        fs.mkdirs(self.path(b).getParent())
        aside = None
        if fs.exists(self.path(b)) and fs.getFileStatus(self.path(b)).isFile():
            head, _, name = b.rpartition("/")
            aside = f"{head}/.{name}-{uuid.uuid4().hex}"
            if not fs.rename(self.path(b), self.path(aside)):
                raise OSError(f"could not put {b} aside")
        if not fs.rename(self.path(a), self.path(b)):
            if aside:
                fs.rename(self.path(aside), self.path(b))
            raise OSError(f"could not move {a} to {b}")
        if aside:
            fs.delete(self.path(aside), False)

    def publish(self, staging: str, target: str) -> None:
        """Move a directory to where nothing is, or an empty directory."""
        fs = self.fs(target)
        fs.mkdirs(self.path(target).getParent())
        if fs.exists(self.path(target)) and not fs.delete(self.path(target), False):
            raise OSError(f"{target} is not empty")
        if not fs.rename(self.path(staging), self.path(target)):
            raise OSError(f"could not move {staging} to {target}")


def arrow_path(path: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a path, for tasks and the driver alike, and the path in it."""
    path = re.sub(r"^s3a://", "s3://", path)
    return pafs.FileSystem.from_uri(path if "://" in path else re.sub(r"^file:/*", "/", path))


def check_scheme(p: str) -> None:
    scheme = re.match(r"^([A-Za-z][A-Za-z0-9+.-]*)://", p)
    if (scheme[1] if scheme else "") not in SCHEMES:
        raise ValueError(f"unsupported storage scheme in {p!r}")


def checked_format(name: str) -> str:
    if name not in FORMATS:
        raise ValueError(f"unsupported format {name!r}: one of {', '.join(FORMATS)} is needed")
    return FORMATS[name]


def compression_options(mode: str | None) -> dict[str, str]:
    """Writer options for `snappy`, `zstd(9)`, `gzip(6)` and the like; None takes the session's default."""
    if mode is None:
        return {}
    m = re.fullmatch(r"([a-z0-9_]+)(?:\((\d+)\))?", mode)
    if not m or m[1] not in CODECS:
        raise ValueError(f"unsupported compression {mode!r}: one of {', '.join(CODECS)} is needed")
    levels = CODECS[m[1]]
    if m[2] is not None:
        if levels is None:
            raise ValueError(f"{m[1]} takes no level")
        if not levels[0] <= int(m[2]) <= levels[1]:
            raise ValueError(f"the level of {m[1]} lies between {levels[0]} and {levels[1]}")
    out = {"compression": m[1]}
    if m[2] is not None:
        out[{"zstd": "parquet.compression.codec.zstd.level", "gzip": "zlib.compress.level"}[m[1]]] = m[2]
    return out


def arrow_codec(mode: str | None) -> tuple[str, int | None]:
    """Arrow's name of a compression mode, and its level."""
    compression_options(mode)
    m = re.fullmatch(r"([a-z0-9_]+)(?:\((\d+)\))?", mode or "snappy")
    return {"uncompressed": "none", "lz4_raw": "lz4"}.get(m[1], m[1]), int(m[2]) if m[2] else None
