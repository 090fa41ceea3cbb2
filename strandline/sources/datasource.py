"""Sequence files as Spark data sources: readers by byte ranges, a stream reader, and an ordered writer.

``spark.read.format("strandline-fasta")`` and ``"strandline-fastq"`` plan one partition for
each range of ``bytes`` of every file.  A partition skips to the first record that begins in
its range and reads on to the end of its last one, so each record is read once, by one task,
whatever the ranges.  Only the columns of the schema that the user gives are built; filters
on ``name`` (equal, in, begins with) are taken over and decide before a body is decoded.

``"strandline-text"`` writes a column ``text``, range-sorted by the caller, as one ordered set
of files: tasks write under ``_temporary``, their commit messages carry the partition's
number, and the commit names files in that order and lists them in ``_files.json``.  Files
of failed or repeated attempts are not listed in any message and go with the folder; an
aborted write leaves nothing behind.

Paths are opened with ``pyarrow.fs``: local folders and the stores that it knows.  A file
without records gives none; text before the first record is dropped; names may repeat.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

BLOCK, ROWS, TEXT = 1 << 20, 4096, 4 << 20
LISTED, TEMPORARY = "_files.json", "_temporary"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it)."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def data_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a folder in the order of their paths; names that begin with ``_`` or ``.`` are none."""
    store, inside = opened(path)
    info = store.get_file_info(inside)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(inside, recursive=True))
    hidden = lambda p: any(x[:1] in "_." for x in p[len(inside) :].split("/") if x)
    return sorted((f.path, f.size) for f in found if f.is_file and not hidden(f.path))


def following(store: fs.FileSystem, path: str) -> Iterator[str]:
    """The files behind ``path`` in its ordered set; none where it is in no set."""
    folder, _, own = path.rpartition("/")
    names = [f["file"] for f in listed(store, folder)]
    return (f"{folder}/{n}" for n in (names[names.index(own) + 1 :] if own in names else []))


def listed(store: fs.FileSystem, folder: str) -> list[dict]:
    """file, rows, bytes of the ordered set in a folder."""
    if not store.get_file_info(f"{folder}/{LISTED}").is_file:
        return []
    with store.open_input_stream(f"{folder}/{LISTED}") as file:
        return json.loads(file.read())


def lines_from(store: fs.FileSystem, path: str, at: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) of a file from byte ``at`` on."""
    with store.open_input_file(path) as file:
        file.seek(at)
        rest = b""
        while block := file.read(BLOCK):
            *whole, rest = (rest + block).split(b"\n")
            for line in whole:
                yield at, line
                at += len(line) + 1
        if rest:
            yield at, rest


def line_starts(store: fs.FileSystem, path: str, start: int) -> Iterator[tuple[int, bytes]]:
    """The lines that begin at byte ``start`` or later."""
    lines = lines_from(store, path, max(start - 1, 0))
    if start:
        next(lines, None)  # what is left of the line that holds the byte before
    return lines


@dataclass
class Range(InputPartition):
    """The records of a file that begin in start .. stop - 1."""

    file: str
    file_no: int
    part: int
    start: int
    stop: int


def _plain(line: bytes) -> bytes:
    return line[:-1] if line.endswith(b"\r") else line


def _name(line: bytes, dashes: bool) -> str:
    name = re.sub(r"^[>@]", "", _plain(line).decode()).strip(" ")
    return name.replace(" ", "-") if dashes else name


class RecordReader(DataSourceReader):
    """Reads records of byte ranges; subclasses say how records are found."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns, self.schema = schema.names, schema
        self.path, self.bytes = options["path"], int(options.get("bytes", 32 << 20))
        self.upper, self.dashes = (options.get(k, "false").lower() == "true" for k in ("upper", "dashes"))
        self.wanted: list[tuple[str, tuple[str, ...]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                self.wanted.append(("in", (f.value,)))
            elif isinstance(f, In) and f.attribute == ("name",):
                self.wanted.append(("in", tuple(f.value)))
            elif isinstance(f, StringStartsWith) and f.attribute == ("name",):
                self.wanted.append(("begins", (f.value,)))
            else:
                yield f

    def is_wanted(self, name: str) -> bool:
        return all(name in values if how == "in" else name.startswith(values[0]) for how, values in self.wanted)

    def ranges(self, files: list[tuple[str, int]]) -> list[Range]:
        return [Range(file, n, part, start, min(start + self.bytes, size)) for n, (file, size) in enumerate(files) for part, start in enumerate(range(0, size, self.bytes))]

    def partitions(self) -> Sequence[InputPartition]:
        return self.ranges(data_files(self.path)) or [Range("", 0, 0, 0, 0)]

    def records(self, store: fs.FileSystem, part: Range) -> Iterator[dict]:
        raise NotImplementedError

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        kinds = {"file": pa.string(), "file_no": pa.int64(), "part": pa.int64(), "at": pa.int64(), "name": pa.string(), "seq": pa.string(), "quality": pa.string()}

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in self.columns], names=self.columns)

        if partition.start < partition.stop:
            store, _ = opened(self.path)
            for at, record in enumerate(self.records(store, partition)):
                if not self.is_wanted(record["name"]):
                    continue
                rows.append(record | {"file": partition.file, "file_no": partition.file_no, "part": partition.part, "at": at} | {c: record[c]() for c in ("seq", "quality") if c in self.columns})
                size += len(rows[-1]["seq"]) if "seq" in self.columns else 0
                if len(rows) >= ROWS or size >= TEXT:
                    yield batch()
                    rows, size = [], 0
        yield batch()


class FastaReader(RecordReader):
    def records(self, store: fs.FileSystem, part: Range) -> Iterator[dict]:
        name, body = None, []
        for offset, line in line_starts(store, part.file, part.start):
            if line[:1] == b">":
                if name is not None:
                    yield self._record(name, body)
                if offset >= part.stop:
                    return
                name, body = line, []
            elif name is not None:
                body.append(line)
            elif offset >= part.stop:
                return
        if name is not None:  # the record may go on in the next files of an ordered set
            for file in following(store, part.file):
                for _, line in lines_from(store, file, 0):
                    if line[:1] == b">":
                        yield self._record(name, body)
                        return
                    body.append(line)
            yield self._record(name, body)

    def _record(self, name: bytes, body: list[bytes]) -> dict:
        def seq() -> str:
            text = b"".join(_plain(line).strip(b" ") for line in body).decode()
            return text.upper() if self.upper else text

        return {"name": _name(name, self.dashes), "seq": seq}


class FastqReader(RecordReader):
    """Records of four lines.  A header is a line with ``@`` two lines before one with ``+``: behind a line of qualities that begins with ``@`` come a header and a sequence."""

    def records(self, store: fs.FileSystem, part: Range) -> Iterator[dict]:
        held: list[tuple[int, bytes]] = []
        begun = part.start == 0
        for at in line_starts(store, part.file, part.start):
            held.append(at)
            if not begun and len(held) == 3:
                if held[0][1][:1] == b"@" and held[2][1][:1] == b"+":
                    begun = True
                else:
                    held.pop(0)
            if held and held[0][0] >= part.stop:
                return
            if begun and len(held) == 4:
                (_, name), (_, seq), _, (_, quality) = held
                yield {"name": _name(name, self.dashes), "seq": lambda s=seq: _plain(s).decode().upper() if self.upper else _plain(s).decode(), "quality": lambda q=quality: _plain(q).decode()}
                held = []


class RecordStream(DataSourceStreamReader):
    """New files of a folder, each once; files are whole when they appear.

    An offset is the files that have been planned, with their sizes, so it grows with the
    folder; a file that is no longer there is not read again.
    """

    def __init__(self, reader: RecordReader):
        self.reader = reader

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return dict(data_files(self.reader.path))

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.reader.ranges(sorted((f, n) for f, n in end.items() if f not in start)) or [Range("", 0, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)


class FastaSource(DataSource):
    """Options: path, bytes (of a partition), upper, dashes (for spaces in names)."""

    reader_class = FastaReader

    @classmethod
    def name(cls) -> str:
        return "strandline-fasta"

    def schema(self) -> str:
        return "file string, file_no long, part long, at long, name string, seq string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return self.reader_class(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return RecordStream(self.reader_class(schema, self.options))


class FastqSource(FastaSource):
    reader_class = FastqReader

    @classmethod
    def name(cls) -> str:
        return "strandline-fastq"

    def schema(self) -> str:
        return "file string, file_no long, part long, at long, name string, seq string, quality string"


@dataclass
class Written(WriterCommitMessage):
    part: int
    file: str
    rows: int
    bytes: int


class OrderedWriter(DataSourceArrowWriter):
    """Files of partitions, named and listed in the order of the partitions' numbers."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.end, self.overwrite = options["path"], options.get("extension", "txt"), overwrite
        self.run = uuid.uuid4().hex

    def _folder(self) -> tuple[fs.FileSystem, str]:
        store, inside = opened(self.path)
        return store, inside.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = self._folder()
        part = TaskContext.get().partitionId()
        file = f"{TEMPORARY}/{self.run}/{part}-{uuid.uuid4().hex}"
        rows = size = 0
        store.create_dir(f"{folder}/{TEMPORARY}/{self.run}")
        with store.open_output_stream(f"{folder}/{file}") as out:
            for batch in iterator:
                for text in batch.column("text").cast(pa.binary()).to_pylist():
                    if text is not None:
                        out.write(text + b"\n")
                        rows, size = rows + 1, size + len(text) + 1
        return Written(part, file, rows, size)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = self._folder()
        store.create_dir(folder)
        before = listed(store, folder)
        kept = [] if self.overwrite else before
        first = len(kept)
        for message in sorted((m for m in messages if m and m.rows), key=lambda m: m.part):
            name = f"part-{len(kept):06d}-{self.run[:8]}.{self.end}"
            store.move(f"{folder}/{message.file}", f"{folder}/{name}")
            kept.append({"file": name, "rows": message.rows, "bytes": message.bytes})
        with store.open_output_stream(f"{folder}/{TEMPORARY}/{LISTED}") if kept[first:] else store.open_output_stream(f"{folder}/{LISTED}") as file:
            file.write(json.dumps(kept).encode())
        if kept[first:]:
            store.move(f"{folder}/{TEMPORARY}/{LISTED}", f"{folder}/{LISTED}")
        for old in before if self.overwrite else []:
            store.delete_file(f"{folder}/{old['file']}")
        self._clear(store, folder)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = self._folder()
        self._clear(store, folder)
        if store.get_file_info(folder).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(folder)):
            store.delete_dir(folder)

    def _clear(self, store: fs.FileSystem, folder: str) -> None:
        """Removes this run's folder, and the one that holds it where no other run has files in it."""
        own = f"{folder}/{TEMPORARY}"
        if store.get_file_info(f"{own}/{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{own}/{self.run}")
        if store.get_file_info(own).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(own)):
            store.delete_dir(own)


class OrderedTextSource(DataSource):
    """Options: path, extension.  Rows have a column ``text``, one or more lines without the last line's end; null rows are left out."""

    @classmethod
    def name(cls) -> str:
        return "strandline-text"

    def schema(self) -> str:
        return "text string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return OrderedWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the sources known to a session, and lets readers take filters over."""
    from ..session import ship

    ship(spark)
    for source in (FastaSource, FastqSource, OrderedTextSource):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_ordered(rows: DataFrame, path: str, order: list[str], mode: str = "append", extension: str = "txt", partitions: int | None = None) -> None:
    """Writes the column ``text`` as an ordered set of files: sorted by ranges of ``order``, no task having more than one range."""
    register(rows.sparkSession)
    ranges = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    ranges.sortWithinPartitions(*order).select("text").write.format("strandline-text").mode(mode).option("extension", extension).save(path)


def number_records(records: DataFrame, whole_set: bool = False) -> DataFrame:
    """Adds ``seq_idx``, a record's number in its file or, with ``whole_set``, in the ordered set of files.

    Numbers inside a partition and the number of records before each partition, which come
    from a table with a row a partition; no file is numbered in one task.
    """
    own = records.groupBy("file_no", "part").agg(F.count("*").alias("_n"))
    scope = Window.orderBy("file_no", "part") if whole_set else Window.partitionBy("file_no").orderBy("part")
    before = own.withColumn("_before", F.coalesce(F.sum("_n").over(scope.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("file_no", "part").orderBy("at")) - 1
    return records.withColumn("_inside", inside).join(before, ["file_no", "part"]).withColumn("seq_idx", F.col("_before") + F.col("_inside")).drop("_inside", "_before")
