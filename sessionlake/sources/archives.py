"""Zip archives of CSV members as a data source, `zip_csv`: read in place by executors, and written by them.

Reading, the driver sees directories of archives alone. Each member is a partition; a task inflates it and gives out its records in batches
of bounded size. Members are known by their whole names, so equal file names in two folders stay apart. A member is one stream that can't be
entered in the middle, so it is one task's work. Any file system that pyarrow opens will do.

Writing, each task makes one archive under a name of its own, which the job's commit moves into place: a task that runs twice or dies
leaves nothing in the result.
"""

from __future__ import annotations

import csv
import io
import re
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from sessionlake.session import ship

ARCHIVE, MEMBER = "archive", "member"
BATCH_BYTES = 4 << 20
#: Longest cell that the CSV reader takes, in characters.
LONGEST_CELL = 1 << 30


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def archives_at(path: str) -> list[str]:
    """The archive, or those of a folder, by name; names that begin with a dot or an underscore aren't results."""
    fs, top = file_system(path)
    if fs.get_file_info(top).type != pafs.FileType.Directory:
        return [top]
    found = fs.get_file_info(pafs.FileSelector(top))
    return sorted(f.path for f in found if f.type == pafs.FileType.File and f.extension.lower() == "zip" and f.base_name[0] not in "._")


def csv_members(path: str, below: str = "data/") -> list[tuple[str, str]]:
    """Archives and their CSV members below a folder, in order; directories alone are read, 16 archives at a time."""
    fs, _ = file_system(path)

    def members(archive: str) -> list[tuple[str, str]]:
        with fs.open_input_file(archive) as f, zipfile.ZipFile(f) as z:
            return sorted((archive, n) for n in z.namelist() if n.startswith(below) and n.lower().endswith(".csv"))

    with ThreadPoolExecutor(16) as pool:
        return [m for some in pool.map(members, archives_at(path)) for m in some]


@dataclass
class Member(InputPartition):
    archive: str
    name: str


@dataclass
class Written(WriterCommitMessage):
    made: str | None


class ZipCsv(DataSource):
    """Options: path (an archive, or a folder of them), below (members' folder, `data/`); to write, member (a column that names the member)."""

    @classmethod
    def name(cls) -> str:
        return "zip_csv"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZipCsvReader(schema, self.options["path"], self.options.get("below", "data/"))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ZipCsvWriter(schema, self.options["path"], self.options.get("below", "data/"), self.options["member"])


class ZipCsvReader(DataSourceReader):
    """Columns by name, all of them texts: a column that a member lacks, and a cell that a record lacks, are empty texts.

    `archive` and `member` tell where a record comes from. A byte order mark is dropped, cells beyond the header are left out, blank lines
    are no records, and of columns of one name the last counts. Members without a header give no rows.
    """

    def __init__(self, schema: StructType, path: str, below: str):
        if wrong := [f.name for f in schema if f.dataType.typeName() != "string"]:
            raise ValueError(f"zip_csv reads texts; these columns have other types: {wrong}")
        self.columns, self.path, self.below = schema.names, path, below

    def partitions(self) -> Sequence[InputPartition]:
        return [Member(*m) for m in csv_members(self.path, self.below)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Member):  # a folder without members has one empty partition
            return
        csv.field_size_limit(LONGEST_CELL)
        fs, _ = file_system(self.path)
        with fs.open_input_file(partition.archive) as f, zipfile.ZipFile(f) as z, z.open(partition.name) as raw:
            records = csv.reader(io.TextIOWrapper(raw, encoding="utf-8-sig", errors="replace", newline=""))
            place = {c: i for i, c in enumerate(next(records, []))}
            if not place:
                return
            known = {ARCHIVE: partition.archive.rsplit("/", 1)[-1], MEMBER: partition.name}
            places = [None if c in known else place.get(c) for c in self.columns]
            rows, size = [], 0
            for record in records:
                if record:
                    rows.append(record)
                    size += 64 + sum(map(len, record))
                if size > BATCH_BYTES:
                    yield self.batch(rows, places, known)
                    rows, size = [], 0
            if rows:
                yield self.batch(rows, places, known)

    def batch(self, rows: list[list[str]], places: list[int | None], known: dict[str, str]) -> pa.RecordBatch:
        cells = [[known.get(c, "")] * len(rows) if i is None else [r[i] if i < len(r) else "" for r in rows] for c, i in zip(self.columns, places, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cells], names=self.columns)


class ZipCsvWriter(DataSourceWriter):
    """One archive a task; a row's member is `<below><its value>.csv`, and the rows of a member come one after another. Nulls are empty cells."""

    def __init__(self, schema: StructType, path: str, below: str, member: str):
        self.columns, self.path, self.below, self.job = [c for c in schema.names if c != member], path, below, uuid.uuid4().hex
        self.at = schema.names.index(member)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        fs, top = file_system(self.path)
        first = next(iterator, None)
        if first is None:
            return Written(None)
        fs.create_dir(f"{top}/_{self.job}", recursive=True)
        made = f"{top}/_{self.job}/{uuid.uuid4().hex}.zip"
        with fs.open_output_stream(made, compression=None) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            self.fill(z, first, iterator)
        return Written(made)

    def fill(self, z: zipfile.ZipFile, row: Row | None, rest: Iterator[Row]) -> None:
        begun: set[str] = set()
        while row is not None:
            name = row[self.at]
            if not name or name in begun:
                raise ValueError(f"rows of the member {name!r} don't come one after another, or it has no name")
            begun.add(name)
            with z.open(f"{self.below}{name}.csv", "w", force_zip64=True) as raw, io.TextIOWrapper(raw, encoding="utf-8", newline="") as text:
                out = csv.writer(text)
                out.writerow(self.columns)
                while row is not None and row[self.at] == name:
                    out.writerow([v for i, v in enumerate(row) if i != self.at])
                    row = next(rest, None)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, top = file_system(self.path)
        for m in messages:
            if isinstance(m, Written) and m.made:
                fs.move(m.made, f"{top}/{m.made.rsplit('/', 1)[-1]}")
        self.clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.clear()

    def clear(self) -> None:
        fs, top = file_system(self.path)
        if fs.get_file_info(f"{top}/_{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{top}/_{self.job}")


def _registered(spark: SparkSession) -> SparkSession:
    ship(spark).dataSource.register(ZipCsv)
    return spark


def read_zip_csv(spark: SparkSession, path: str, columns: Sequence[str], below: str = "data/") -> DataFrame:
    """The asked columns of all CSV members below a folder, as texts, and `member`, the member's whole name."""
    schema = ", ".join(f"`{c}` string" for c in (*columns, MEMBER))
    return _registered(spark).read.format("zip_csv").schema(schema).option("below", below).load(path)


def write_zip_csv(df: DataFrame, folder: str, member: str, below: str = "data/") -> None:
    """Archives in a folder, one a partition, with a member for each of the partition's values of a column; no shuffle, a sort within partitions."""
    _registered(df.sparkSession)
    df.sortWithinPartitions(member).write.format("zip_csv").option("member", member).option("below", below).mode("append").save(folder)


def table_of(member: Column) -> Column:
    """The table that a member is named after: its file name without folders and ending."""
    return F.regexp_extract(member, r"([^/]*)\.[^./]*$", 1)
