"""Zip archives as Spark data sources: a partition for each member or archive, read in blocks.

Archives are opened where they lie (any file system that pyarrow knows) and sought in, so only the central directory and the
asked members are read, and nothing holds an archive or a member whole.  Archives and members may exceed 2 GB.
"""

from __future__ import annotations

import fnmatch
import hashlib
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import csv as pa_csv
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from latentia.session import ship

#: Fixed column order of the headerless archives.
COLUMNS = ("agg_trade_id", "price", "quantity", "first_trade_id", "last_trade_id", "timestamp", "is_buyer_maker", "is_best_match")
BLOCK = 1 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def archives(path: str) -> list[str]:
    """Archives in order: one file, the files of a folder that end in .zip, or those that fit a pattern in the last part of a path."""
    system, at = located(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    folder, _, last = at.rpartition("/")
    if not any(c in last for c in "*?["):
        info = system.get_file_info(at)
        if info.type == fs.FileType.File:
            return [path]
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        folder, last = at, "*.zip"
    found = system.get_file_info(fs.FileSelector(folder or "."))
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, last))


def opened(path: str) -> pa.NativeFile:
    system, at = located(path)
    return system.open_input_file(at)


def csv_members(z: zipfile.ZipFile) -> list[str]:
    return [n for n in z.namelist() if n.endswith(".csv")]


def base_name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


class Member(InputPartition):
    def __init__(self, path: str, member: str | None):
        self.path, self.member = path, member


class TickReader(DataSourceReader):
    """Members of archives: the first, all CSVs, or (strict) the only CSV."""

    def __init__(self, path: str, members: str, block: int):
        self.path, self.members, self.block = path, members, block

    def partitions(self) -> list[Member]:
        out = []
        for path in archives(self.path):
            with opened(path) as f, zipfile.ZipFile(f) as z:
                names = z.namelist()[:1] if self.members == "first" else csv_members(z)
            if self.members == "strict" and len(names) != 1 or not names:
                raise ValueError(f"{path}: expected exactly one CSV member, found {len(names)}")
            out += [Member(path, n) for n in names]
        return out or [Member("", None)]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if partition.member is None:
            return
        convert = pa_csv.ConvertOptions(include_columns=["agg_trade_id", "price", "timestamp"], column_types={"agg_trade_id": pa.int64(), "price": pa.float64(), "timestamp": pa.int64()})
        layout = pa_csv.ReadOptions(column_names=list(COLUMNS), block_size=self.block)
        symbol = base_name(partition.path).removesuffix(".zip")
        with opened(partition.path) as f, zipfile.ZipFile(f) as z, z.open(partition.member) as member:
            if not z.getinfo(partition.member).file_size:
                return
            for part in pa_csv.open_csv(member, read_options=layout, convert_options=convert):
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([symbol] * n), pa.array([partition.member] * n), part.column("timestamp"), part.column("agg_trade_id"), part.column("price")], names=["symbol", "member", "stamp", "seq", "price"])


class ZipTicks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_ticks"

    def schema(self) -> str:
        return "symbol string, member string, stamp long, seq long, price double"

    def reader(self, schema: object) -> TickReader:
        return TickReader(self.options["path"], self.options.get("members", "first"), int(self.options.get("block", BLOCK)))


class ReportReader(DataSourceReader):
    """Per archive: its members and lines, or its digest."""

    def __init__(self, path: str, digest: bool):
        self.path, self.digest = path, digest

    def partitions(self) -> list[Member]:
        return [Member(p, "") for p in archives(self.path)] or [Member("", None)]

    def read(self, partition: Member) -> Iterator[tuple]:
        if partition.member is None:
            return
        name = base_name(partition.path)
        if self.digest:
            sha = hashlib.sha256()
            with opened(partition.path) as f:
                while block := f.read(BLOCK):
                    sha.update(block)
            yield (name, None, None, None, sha.hexdigest())
            return
        try:
            with opened(partition.path) as f, zipfile.ZipFile(f) as z:
                names, lines = csv_members(z), None
                if len(names) == 1:
                    with z.open(names[0]) as member:
                        lines = sum(1 for _ in member)
            yield (name, len(names), "ok" if len(names) == 1 else "not one CSV", lines, None)
        except (zipfile.BadZipFile, EOFError, OSError, pa.ArrowInvalid):  # a file shorter than a directory cannot be sought in
            yield (name, 0, "invalid", None, None)


class ZipReport(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_report"

    def schema(self) -> str:
        return "file string, members int, status string, rows long, sha256 string"

    def reader(self, schema: object) -> ReportReader:
        return ReportReader(self.options["path"], self.options.get("digest", "false").lower() == "true")


def registered(spark: SparkSession) -> SparkSession:
    """The session with both sources known to it."""
    for source in (ZipTicks, ZipReport):
        spark.dataSource.register(source)
    return ship(spark)
