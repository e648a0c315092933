"""Documents of many sessions in few files, published by one commit.

A document is a sorted run of lines.  Writing one directory per session would make a file for
each of millions of sessions, so lines are range partitioned by session and place instead: a
task writes one text file with the lines of consecutive sessions, end to end, and beside it a
manifest that says where each session's lines begin.  Small sessions share a file and a session
of any size spreads over many.

The writer is a Spark data source (``session_documents``) with its commit protocol.  Task
attempts write files of their own into a folder of the commit; what becomes of them is
decided once, on the driver, by replacing the file ``_current``, which names the commit and its
files.  Until then nothing new can be read; an aborted write removes its folder and leaves the
version before it in place.  The driver holds one entry per file, never one per session.

Files are reached through ``pyarrow.fs``: paths of the local system (or a mounted store) and
the addresses it knows (``file``, ``hdfs``, ``s3``, ``gs``).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from siftlane.session import stored

FORMAT, CURRENT = "session_documents", "_current"
SCHEMA = "session_id string, line_no long, line string"
#: Bytes read at once; lines in a batch that is read.
BLOCK, LINES = 1 << 20, 1 << 13
_ROWS = pa.schema([("session_id", pa.string()), ("line_no", pa.int64()), ("line", pa.string())])
_MANIFEST = pa.schema([("session_id", pa.string()), ("first_byte", pa.int64()), ("bytes", pa.int64()), ("lines", pa.int64())])


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if "://" in path or path.startswith("file:"):
        try:
            return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        except pa.ArrowInvalid as e:
            raise ValueError(f"documents cannot be kept at {path}: {e}") from e
    return pafs.LocalFileSystem(), path


@dataclass
class _Part(WriterCommitMessage):
    """What a task has written; ``first`` and ``last`` are the sessions at its ends, ``last_lines`` how many lines of the last it holds."""

    number: int
    file: str | None
    first: str | None = None
    last: str | None = None
    last_lines: int = 0
    sessions: int = 0


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.commit_id = path, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        number = TaskContext.get().partitionId()
        found: list[list] = []  # session, first byte, bytes, lines
        store, folder = _store(f"{self.path}/{self.commit_id}")
        name, out, at = f"part-{number:06d}-{uuid.uuid4().hex}", None, 0
        try:
            for batch in batches:
                if out is None and batch.num_rows:
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(f"{folder}/{name}.txt")
                for session, line in zip(batch.column("session_id").to_pylist(), batch.column("line").to_pylist()):
                    data = (line or "").encode() + b"\n"
                    out.write(data)
                    if not found or found[-1][0] != session:
                        found.append([session, at, 0, 0])
                    found[-1][2] += len(data)
                    found[-1][3] += data.count(b"\n")
                    at += len(data)
        finally:
            if out is not None:
                out.close()
        if not found:
            return _Part(number, None)
        columns = [pa.array(c, f.type) for c, f in zip(zip(*found), _MANIFEST)]
        pq.write_table(pa.Table.from_arrays(columns, schema=_MANIFEST), f"{folder}/{name}.manifest.parquet", filesystem=store)
        return _Part(number, name, found[0][0], found[-1][0], found[-1][3], len(found))

    def commit(self, messages: list) -> None:
        """Publish: a session that begins in a file before has its lines there counted in ``before``."""
        parts = sorted((m for m in messages if m is not None and m.file), key=lambda m: m.number)
        files, open_session, open_lines = [], None, 0
        for p in parts:
            before = open_lines if files and p.first == open_session else 0
            files.append({"file": p.file, "first": p.first, "last": p.last, "before": before, "sessions": p.sessions})
            open_session, open_lines = p.last, p.last_lines + (before if p.sessions == 1 else 0)
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        old = _current(self.path)
        with store.open_output_stream(f"{root}/{CURRENT}.{self.commit_id}") as out:
            out.write(json.dumps({"commit": self.commit_id, "files": files}).encode())
        store.move(f"{root}/{CURRENT}.{self.commit_id}", f"{root}/{CURRENT}")
        named = {f["file"] for f in files}
        self._remove(store, root, self.commit_id, lambda name: name.split(".")[0] not in named)  # of attempts that did not count
        if old is not None:
            self._remove(store, root, old["commit"], lambda name: True)

    def abort(self, messages: list) -> None:
        store, root = _store(self.path)
        self._remove(store, root, self.commit_id, lambda name: True)

    def _remove(self, store: pafs.FileSystem, root: str, commit: str, these) -> None:
        listed = store.get_file_info(pafs.FileSelector(f"{root}/{commit}", allow_not_found=True))
        for info in listed:
            if these(info.base_name):
                store.delete_file(info.path)
        if listed and all(these(info.base_name) for info in listed):
            store.delete_dir(f"{root}/{commit}")


def _current(path: str) -> dict | None:
    store, root = _store(path)
    if store.get_file_info(f"{root}/{CURRENT}").type == pafs.FileType.NotFound:
        return None
    with store.open_input_stream(f"{root}/{CURRENT}") as f:
        return json.loads(f.read())


@dataclass
class _File(InputPartition):
    commit: str
    file: str
    first: str | None
    before: int


class _Reader(DataSourceReader):
    """A partition per file; with ``sessions`` only the files and bytes that hold them."""

    def __init__(self, path: str, sessions: list[str] | None):
        self.path, self.sessions = path, None if sessions is None else set(sessions)

    def partitions(self) -> Sequence[InputPartition]:
        told = _current(self.path)
        if told is None:
            raise FileNotFoundError(f"no documents have been published at {self.path}")
        return [_File(told["commit"], f["file"], f["first"], f["before"]) for f in told["files"] if self._may_hold(f)]

    def _may_hold(self, f: dict) -> bool:
        """Sessions are sorted as UTF-8, null first."""
        if self.sessions is None:
            return True
        low, high = ((f[c] or "").encode() for c in ("first", "last"))
        return any(low <= s.encode() <= high for s in self.sessions)

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no files
            return
        store, folder = _store(f"{self.path}/{partition.commit}")
        rows = pq.read_table(f"{folder}/{partition.file}.manifest.parquet", filesystem=store).to_pylist()
        with store.open_input_file(f"{folder}/{partition.file}.txt") as f:
            for i, row in enumerate(rows):
                if self.sessions is None or row["session_id"] in self.sessions:
                    yield from _lines(f, row, partition.before if i == 0 else 0)


def _lines(f: pa.NativeFile, row: dict, before: int) -> Iterator[pa.RecordBatch]:
    """The lines of a session in a file, a few thousand at a time."""
    f.seek(row["first_byte"])
    left, rest, at, found = row["bytes"], b"", before, []
    while left:
        block = f.read(min(BLOCK, left))
        if not block:
            raise EOFError("a file of documents is shorter than its manifest says")
        left -= len(block)
        *whole, rest = (rest + block).split(b"\n")
        found += whole
        while len(found) >= LINES or (found and not left):
            some, found = found[:LINES], found[LINES:]
            yield pa.RecordBatch.from_arrays([pa.array([row["session_id"]] * len(some), pa.string()), pa.array(range(at + 1, at + 1 + len(some)), pa.int64()),
                                              pa.array([s.decode() for s in some], pa.string())], schema=_ROWS)
            at += len(some)


class SessionDocuments(DataSource):
    """Options: ``path``; for reading also ``sessions``, a JSON list."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if not overwrite:
            raise ValueError("documents are replaced as a whole: write with mode overwrite")
        return _Writer(self.options["path"].rstrip("/"))

    def reader(self, schema) -> DataSourceReader:
        sessions = self.options.get("sessions")
        return _Reader(self.options["path"].rstrip("/"), None if sessions is None else json.loads(sessions))


def write_lines(lines: DataFrame, path: str, files: int | None = None) -> None:
    """Write document lines ``(session_id, section, ord, line)``; replaces what the path holds.

    A line that holds line breaks counts as several.  ``files`` sets the number of ranges; without
    it Spark chooses it by size.  The lines are stored first, so that sampling for the ranges does
    not compute them a second time.
    """
    order = ["session_id", "section", "ord", "line"]
    lines.sparkSession.dataSource.register(SessionDocuments)
    (stored(lines.select(*order), "lines").repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order)
     .select("session_id", "line").write.format(FORMAT).mode("overwrite").option("path", path).save())


def read_documents(spark: SparkSession, path: str, sessions: Sequence[str] | None = None) -> DataFrame:
    """The lines of all documents, or of the sessions named: ``(session_id, line_no, line)``, numbered from 1.

    Only files and byte ranges that hold the sessions are read.
    """
    spark.dataSource.register(SessionDocuments)
    reader = spark.read.format(FORMAT).option("path", path)
    return (reader if sessions is None else reader.option("sessions", json.dumps(list(sessions)))).load()


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Where each session's lines are: ``(session_id, file, first_byte, bytes, first_line, lines)``, one row per session and file."""
    told = _current(path)
    if told is None:
        raise FileNotFoundError(f"no documents have been published at {path}")
    schema = "session_id string, file string, first_byte long, bytes long, first_line long, lines long"
    names = [f["file"] for f in told["files"]]
    before = {f["file"]: f["before"] for f in told["files"]}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, carried in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, folder = _store(f"{path.rstrip('/')}/{told['commit']}")
                t = pq.read_table(f"{folder}/{name}.manifest.parquet", filesystem=store)
                first = pa.array([1 + (carried if i == 0 else 0) for i in range(t.num_rows)], pa.int64())
                files = pa.array([f"{name}.txt"] * t.num_rows, pa.string())
                for b in pa.Table.from_arrays([t["session_id"], files, t["first_byte"], t["bytes"], first, t["lines"]],
                                              ["session_id", "file", "first_byte", "bytes", "first_line", "lines"]).to_batches():
                    yield b

    rows = spark.createDataFrame([(n, before[n]) for n in names], "file string, carried long")
    return rows.mapInArrow(read, schema)
