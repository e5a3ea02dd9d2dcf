"""Append-only logs as a Spark data source (``logfile``), read in spite of damaged records.

A log is a sequence of 32 KiB blocks of records; an entry is one record or, where
it doesn't fit the block, a chain of them.  Every block begins with a record, so
files are read in shards of whole blocks: an entry belongs to the shard that its
first record lies in, and shards of any number give every entry once.  Rows are
(path, off, data): the offset of the entry's first record and its bytes.

A damaged log is an error.  With ``resync`` = true, reading goes on: what follows
a damaged record in its block is lost, an entry that breaks off is left out, and
so is one that the file's end cuts.

With ``state`` = true a log holds snapshots and updates: rows are (path, off, typ,
epoch, data).  The writer takes typ and data and states the epoch itself: the
offset of the last snapshot before, or 0.

Options: ``path`` (a file, or a folder), ``shardBytes``, ``resync``, ``state``.  Each
task writes one file, its rows in the task's order; entries without bytes are
left out unless they are state.  Files appear once all are written.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, WriterCommitMessage

from .recordfile import Shard, Written, _files, _open

# The format's block size, record header (checksum, type, length, distance from the entry's start) and types; types of state.
BLOCK = 32 << 10
HEAD = struct.Struct("<IBHQ")
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4
UPDATE, SNAPSHOT = 1, 2
STATE = struct.Struct("<BQ")

#: Rows of a batch that leaves the reader.
ROWS = 1024


def checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def _record(kind: int, distance: int, data: bytes) -> bytes:
    rest = HEAD.pack(0, kind, len(data), distance)[4:] + data
    return checksum(rest).to_bytes(4, "little") + rest


def put_entry(at: int, data: bytes) -> tuple[int, bytes]:
    """The entry's offset and the bytes to append to a log of ``at`` bytes."""
    left = BLOCK - at % BLOCK
    padding = b"\0" * left if left <= HEAD.size else b""
    start = at + len(padding)
    records, size, taken = [padding], 0, 0
    while taken < len(data):
        piece = data[taken : taken + BLOCK - (start + size) % BLOCK - HEAD.size]
        taken += len(piece)
        ends = taken == len(data)
        kind = (FULL if ends else FIRST) if size == 0 else (LAST if ends else MIDDLE)
        records.append(_record(kind, size, piece))
        size += HEAD.size + len(piece)
    return start, b"".join(records)


def _records(block: bytes) -> Iterator[tuple[int, int, bytes] | None]:
    """(offset in the block, type, data) of each record; None, and no more, at a damaged one."""
    at = 0
    while at < len(block) - HEAD.size:
        total, kind, size, distance = HEAD.unpack_from(block, at)
        end = at + HEAD.size + size
        if end > len(block) or checksum(block[at + 4 : end]) != total or not FULL <= kind <= LAST or (distance == 0) != (kind <= FIRST):
            yield None
            return
        yield at, kind, block[at + HEAD.size : end]
        at = end


def entries(f, start: int, limit: int, resync: bool) -> Iterator[tuple[int, bytes]]:
    """(offset, data) of entries that begin from ``start``, which begins a block, up to ``limit``."""

    def damaged(at: int) -> None:
        if not resync:
            raise ValueError(f"a log is damaged at {at}")

    f.seek(start)
    # A later shard may begin amid an entry of the one before, until a record starts another.
    base, begun, parts, known = start, None, [], start == 0
    while block := f.read(BLOCK):
        for found in _records(block):
            if found is None or found[1] <= FIRST:
                known = True
                if begun is not None:
                    damaged(begun)
                begun, parts = None, []
                if base >= limit:
                    return
            if found is None:
                damaged(base)
                continue
            at, kind, data = found
            if kind == FULL:
                yield base + at, data
            elif kind == FIRST:
                begun, parts = base + at, [data]
            elif begun is not None:
                parts.append(data)
                if kind == LAST:
                    yield begun, b"".join(parts)
                    begun, parts = None, []
            elif known:
                damaged(base + at)
        base += len(block)
        if base >= limit and begun is None:
            return
    if begun is not None:
        damaged(begun)


def _true(options: dict, name: str) -> bool:
    return options.get(name, "false").lower() == "true"


class LogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.resync, self.state = options["path"], _true(options, "resync"), _true(options, "state")
        self.step = max(1, int(options.get("shardBytes", 64 << 20)) // BLOCK) * BLOCK

    def partitions(self) -> list[Shard]:
        return [Shard(p, a, min(n, a + self.step)) for p, n in _files(self.path) for a in range(0, n, self.step)]

    def read(self, shard: Shard | None) -> Iterator[pa.RecordBatch]:
        if shard is None:  # Spark's call where there are no shards
            return
        fs, _ = _open(self.path)
        with fs.open_input_file(shard.path) as f:
            rows: list[tuple] = []
            for at, data in entries(f, shard.start, shard.limit, self.resync):
                if not self.state:
                    rows.append((at, data))
                elif len(data) >= STATE.size and data[0] <= SNAPSHOT:
                    rows.append((at, *STATE.unpack_from(data), data[STATE.size :]))
                elif not self.resync:
                    raise ValueError(f"the state entry at {at} is damaged")
                if len(rows) == ROWS:
                    yield self._batch(shard.path, rows)
                    rows = []
            if rows:
                yield self._batch(shard.path, rows)

    def _batch(self, path: str, rows: list[tuple]) -> pa.RecordBatch:
        types = [("off", pa.int64()), *([("typ", pa.int32()), ("epoch", pa.int64())] if self.state else []), ("data", pa.binary())]
        columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), *columns], names=["path", *(name for name, _ in types)])


class LogWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.state, self.overwrite = options["path"], _true(options, "state"), overwrite
        self.job = f"_job-{uuid.uuid4().hex}-"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = _open(self.path)
        fs.create_dir(folder, recursive=True)
        name = f"part-{uuid.uuid4().hex}"
        epoch = 0
        with fs.open_output_stream(f"{folder}/{self.job}{name}") as f:
            for batch in batches:
                values = [v or b"" for v in batch.column("data").to_pylist()]
                kinds = batch.column("typ").to_pylist() if self.state else [None] * len(values)
                for kind, value in zip(kinds, values, strict=True):
                    if self.state:
                        if kind not in (UPDATE, SNAPSHOT):
                            raise ValueError(f"unknown type of state: {kind}")
                        value = STATE.pack(kind, epoch) + value
                    if value:
                        start, data = put_entry(f.tell(), value)
                        f.write(data)
                        epoch = start if kind == SNAPSHOT else epoch
        return Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, folder = _open(self.path)
        old = [p for p, _ in _files(self.path)] if self.overwrite else []
        for m in messages:
            if m:
                fs.move(f"{folder}/{self.job}{m.name}", f"{folder}/{m.name}")
        for path in old:
            fs.delete_file(path)
        self.abort([])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Remove what tasks that failed or ran twice have left."""
        fs, folder = _open(self.path)
        for info in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            if info.is_file and info.base_name.startswith(self.job):
                fs.delete_file(info.path)


class LogFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "logfile"

    def schema(self) -> str:
        return "path string, off long, typ int, epoch long, data binary" if _true(self.options, "state") else "path string, off long, data binary"

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def writer(self, schema, overwrite: bool) -> LogWriter:
        return LogWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogFile)
