"""FASTA as a Spark data source: ``spark.read.format("fasta")`` and ``df.write.format("fasta")``.

Reading cuts files into byte ranges of ``rangeBytes``, one a task, whatever the lengths of lines and records: a range
cleans its own bytes and nothing else. Rows are (file, start, at, kind, raw): ``start`` is the range's, ``at`` a place in
the file. Kinds: ``header``, the bytes of a header line after ``>``; ``sequence``, up to PIECE cleaned bases; ``rest``, bytes of
a line that began before the range, of which only the range before knows what line it is; and one ``end`` a range, whose
raw is what its last line is: ``>`` a header, ``.`` another line, nothing where no line begins in the range.
``sources.fasta`` puts these together.

Writing takes rows (header, seq), a record each, wrapped at ``width`` letters (60; 0: one line). A task writes a file of its
own attempt to a hidden folder; the commit moves the files of the attempts that succeeded, an abort deletes them.

Paths are those of pyarrow's file systems (local, hdfs, s3). This module is sent to Python workers by value.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes that are read, and bases of a row, at once; bytes of a range unless told otherwise.
PIECE, RANGE = 1 << 16, 1 << 24
SCHEMA = "file string, start long, at long, kind string, raw binary"
#: What a letter counts as; all other bytes go.
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_BASES = bytes.maketrans(_LETTERS, bytes(c if c in b"ACGT" else 65 for c in _LETTERS.upper()))
_OTHERS = bytes(b for b in range(256) if b not in _LETTERS)


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    file: str
    start: int
    stop: int


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("rangeBytes", RANGE))

    def partitions(self) -> list[Range]:
        system, path = place(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f for f in files if f.is_file and f.base_name[0] not in "._"), key=lambda f: f.path)
        return [Range(f.path, at, min(f.size, at + self.size)) for f in files for at in range(0, f.size, self.size)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        system, _ = place(self.path)
        with system.open_input_file(part.file) as f:
            yield from batches(part, rows(f, part.start, part.stop))


def rows(f, start: int, stop: int) -> Iterator[tuple[int, str, bytes]]:
    """(at, kind, raw) of a byte range. No more than a piece of a sequence line is held; a header line is held whole."""
    line = b"\n" if start == 0 else f.read_at(1, start - 1)
    state = "new" if line == b"\n" else "rest"  # of the line that the next byte belongs to
    last, header, header_at = "", [], 0
    for at in range(start, stop, PIECE):
        data = f.read_at(min(PIECE, stop - at), at)
        bases, bases_at, here = [], at, 0
        while here < len(data):
            cut = data.find(b"\n", here)
            upto = len(data) if cut < 0 else cut
            if state == "new":
                state = ">" if data[here : here + 1] == b">" else "."
                last = state
                if state == ">":
                    if own := b"".join(bases):
                        yield bases_at, "sequence", own
                    bases, header, header_at, here = [], [], at + here, here + 1
            part = data[here:upto]
            if state == "rest":
                if part:
                    yield at + here, "rest", part
            elif state == ">":
                header.append(part)
            elif clean := part.translate(_BASES, _OTHERS):
                if not bases:
                    bases_at = at + here
                bases.append(clean)
            if cut >= 0:
                if state == ">":
                    yield header_at, "header", b"".join(header)
                    header = []
                state = "new"
            here = upto + 1
        if own := b"".join(bases):
            yield bases_at, "sequence", own
    if state == ">":
        yield header_at, "header", b"".join(header)
    yield stop, "end", (b"\n" if state == "new" else b"") + last.encode()


def batches(part: Range, found: Iterator[tuple[int, str, bytes]], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    names, some, size = ["file", "start", "at", "kind", "raw"], [], 0

    def batch():
        at, kind, raw = zip(*some, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([part.file] * len(some)), pa.array([part.start] * len(some), pa.int64()), pa.array(at, pa.int64()), pa.array(kind), pa.array(raw, pa.binary())], names=names)

    for row in found:
        some.append(row)
        size += len(row[2])
        if size > most or len(some) >= 10_000:
            yield batch()
            some, size = [], 0
    if some:
        yield batch()


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class Writer(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.width, self.overwrite = options["path"], int(options.get("width", 60)), overwrite
        self.job = uuid.uuid4().hex

    def folder(self) -> tuple[fs.FileSystem, str, str]:
        system, path = place(self.path)
        return system, path, f"{path}/_writing-{self.job}"

    def write(self, iterator) -> Written:
        system, _, hidden = self.folder()
        system.create_dir(hidden, recursive=True)
        name, out = f"part-{uuid.uuid4().hex}.fa", None
        for header, seq in iterator:
            out = out or system.open_output_stream(f"{hidden}/{name}")
            seq, step = seq or "", self.width if self.width > 0 else max(1, len(seq or ""))
            out.write(f">{'' if header is None else header}\n".encode())
            for at in range(0, len(seq), step * 1000):
                out.write("".join(f"{seq[k : k + step]}\n" for k in range(at, min(len(seq), at + step * 1000), step)).encode())
        if out:
            out.close()
        return Written(name if out else None)

    def commit(self, messages) -> None:
        system, path, hidden = self.folder()
        system.create_dir(path, recursive=True)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(path)):
                if old.is_file:
                    system.delete_file(old.path)
        for m in messages:
            if m and m.file:
                system.move(f"{hidden}/{m.file}", f"{path}/{m.file}")
        self.clear(system, hidden)  # with what attempts left that were not committed
        system.open_output_stream(f"{path}/_SUCCESS").close()

    def abort(self, messages) -> None:
        system, _, hidden = self.folder()
        self.clear(system, hidden)

    def clear(self, system, hidden: str) -> None:
        if system.get_file_info(hidden).type != fs.FileType.NotFound:
            system.delete_dir(hidden)


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        if [f.name for f in schema] != ["header", "seq"]:
            raise ValueError("FASTA is written from columns header and seq")
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(FastaSource)
