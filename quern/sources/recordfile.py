"""Record files as a Spark data source (``recordfile``): chunked, checksummed blocks of byte items.

A file is a sequence of 32 KiB chunks; a block is one or more chunks, and starts
where a chunk's index is 0.  Reading cuts files into shards of whole chunks; a
block belongs to the shard its first chunk lies in, so shards of any number give
every item once, in order.  Rows are (path, block, item, value): the file offset
of the block, the number of the item within it, the bytes.  Filters on ``path`` and
``block`` (equality and IN) reach the reader: only shards that can hold such a
block are read, and in them only those blocks.

Files of the first version (records of any length, plain or packed, without
chunks) are read too; such a file has no marks to start from and is one shard.
Where its name has the suffix of compressed packed records, or ``transform`` is
given, packed records are untransformed.

Read options: ``path`` (a file, or a folder), ``shardBytes``; ``part`` = items
(default), header (path, key, type, value) or trailer (path, value), the latter
two from the first and last block alone.  Write options: ``path``, ``transform``
('zstd 3', 'flate 5', a registered name, a JSON list of them, or none),
``maxItems`` (a full block holds one more), ``header`` (JSON list of [key, value]),
``trailer`` (text), ``index`` (a folder that gets Parquet rows (key, path, block,
item) of all items, with the column ``key`` of what is written).  Overwriting
removes the files that were there once all new ones are written.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

# The format's chunk size, magic numbers, padding, header keys and type tags.
CHUNK = 32 << 10
HEAD = 28
PAYLOAD = CHUNK - HEAD
HEADER_MAGIC = bytes([0xD9, 0xE1, 0xD9, 0x5C, 0xC2, 0x16, 0x04, 0xF7])
BODY_MAGIC = bytes([0x2E, 0x76, 0x47, 0xEB, 0x34, 0x07, 0x3C, 0x2E])
TRAILER_MAGIC = bytes([0xFE, 0xBA, 0x1A, 0xD7, 0xCB, 0xDF, 0x75, 0x3A])
PLAIN_MAGIC = bytes([0xFC, 0xAE, 0x95, 0x31, 0xF0, 0xD9, 0xBD, 0x20])
PADDING = bytes([0xDE, 0xAD, 0xBE, 0xEF])
TRANSFORMER_KEY, TRAILER_KEY = "transformer", "trailer"
BOOL, INT, UINT, STRING = 1, 2, 3, 4
#: Bytes before a record of the first version: magic, length, checksum of the length.
OLD_HEAD = 20
#: What names of compressed packed files of the first version end with.
OLD_COMPRESSED = "-rpk-gz"

Change = Callable[[bytes], bytes]
#: Makes a change of bytes from what follows the name of a transformer.
Factory = Callable[[str], Change]


def put_varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def take_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def pack_items(items: list[bytes]) -> bytes:
    return b"".join([put_varint(len(items)), *(put_varint(len(i)) for i in items), *items])


def _sizes(block: bytes, at: int) -> tuple[list[int], int]:
    n, at = take_varint(block, at)
    sizes = []
    for _ in range(n):
        size, at = take_varint(block, at)
        sizes.append(size)
    return sizes, at


def _cut(data: bytes, at: int, sizes: list[int]) -> list[bytes]:
    if at + sum(sizes) != len(data):
        raise ValueError("a record block's sizes don't add up")
    out = []
    for size in sizes:
        out.append(data[at : at + size])
        at += size
    return out


def unpack_items(block: bytes) -> list[bytes]:
    sizes, at = _sizes(block, 0)
    return _cut(block, at, sizes)


def encode_header(pairs: list[tuple[str, object]]) -> bytes:
    def value(v: object) -> bytes:
        if isinstance(v, bool):
            return bytes([BOOL, v])
        if isinstance(v, int):
            return bytes([INT]) + put_varint(v << 1 if v >= 0 else ~(v << 1))
        return bytes([STRING, UINT]) + put_varint(len(str(v).encode())) + str(v).encode()

    return bytes([UINT]) + put_varint(len(pairs)) + b"".join(value(k) + value(v) for k, v in pairs)


def decode_header(data: bytes) -> list[tuple[str, str, str]]:
    """(key, type, value as text); keys may repeat."""

    def take(at: int) -> tuple[str, object, int]:
        kind = data[at]
        if kind == BOOL:
            return "bool", bool(data[at + 1]), at + 2
        if kind in (INT, UINT):
            n, at = take_varint(data, at + 1)
            return ("uint", n, at) if kind == UINT else ("int", n >> 1 if not n & 1 else ~(n >> 1), at)
        if kind == STRING:
            _, n, at = take(at + 1)
            return "string", data[at : at + n].decode(), at + n
        raise ValueError(f"unknown header type {kind}")

    _, n, at = take(0)
    out = []
    for _ in range(n):
        _, key, at = take(at)
        kind, value, at = take(at)
        out.append((key, kind, str(value).lower() if kind == "bool" else str(value)))
    return out


# -- transformers --------------------------------------------------------------


def _to_zstd(level: str) -> Change:
    import zstandard

    return zstandard.ZstdCompressor(level=int(level or 3)).compress


def _from_zstd(_: str) -> Change:
    import zstandard

    return lambda data: zstandard.ZstdDecompressor().decompressobj().decompress(data)


def _to_flate(level: str) -> Change:
    def change(data: bytes) -> bytes:
        c = zlib.compressobj(int(level or -1), zlib.DEFLATED, -15)
        return c.compress(data) + c.flush()

    return change


def _from_flate(_: str) -> Change:
    return lambda data: zlib.decompress(data, -15)


#: Name -> makers of the changes on writing and on reading.
TRANSFORMERS: dict[str, tuple[Factory, Factory]] = {"zstd": (_to_zstd, _from_zstd), "flate": (_to_flate, _from_flate)}


def _chain(names: list[str], known: dict[str, tuple[Factory, Factory]], back: bool) -> Change:
    """The named transformers one after another, or what undoes them."""
    steps = []
    for name in names[::-1] if back else names:
        kind, _, config = name.partition(" ")
        if kind not in known:
            raise ValueError(f"unknown transformer {name}")
        steps.append(known[kind][back](config))

    def change(data: bytes) -> bytes:
        for step in steps:
            data = step(data)
        return data

    return change


def _names(option: str | None) -> list[str]:
    if not option:
        return []
    return json.loads(option) if option.startswith("[") else [option]


# -- chunks, blocks, records ---------------------------------------------------


def chunks_of(magic: bytes, payload: bytes) -> bytes:
    parts = [payload[a : a + PAYLOAD] for a in range(0, len(payload), PAYLOAD)] or [b""]
    out = []
    for i, part in enumerate(parts):
        fields = struct.pack("<IIII", 0, len(part), len(parts), i)
        pad = PAYLOAD - len(part)
        out += [magic, struct.pack("<I", zlib.crc32(fields + part)), fields, part, (PADDING * (pad // 4 + 1))[:pad]]
    return b"".join(out)


def read_chunk(f) -> tuple[bytes, int, int, bytes] | None:
    """(magic, total, index, payload) of the next chunk; None at the end."""
    raw = f.read(CHUNK)
    if not raw:
        return None
    if len(raw) < CHUNK:
        raise ValueError("a record file has a partial chunk")
    crc, _, size, total, index = struct.unpack("<IIIII", raw[8:HEAD])
    payload = raw[HEAD : HEAD + size]
    if size > PAYLOAD or zlib.crc32(raw[12:HEAD] + payload) != crc:
        raise ValueError("a record chunk's checksum is wrong")
    return raw[:8], total, index, payload


def read_block(f) -> tuple[int, bytes, bytes] | None:
    """(offset, magic, payload) of the next block that begins from here on; None at the end."""
    while True:
        offset = f.tell()
        if (chunk := read_chunk(f)) is None:
            return None
        magic, total, index, payload = chunk
        if index == 0:
            break
    parts = [payload]
    for i in range(1, total):
        chunk = read_chunk(f)
        if chunk is None or chunk[0] != magic or chunk[2] != i:
            raise ValueError("a record block is cut off")
        parts.append(chunk[3])
    return offset, magic, b"".join(parts)


def _open(path: str):
    fs, name = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return fs, name


def _files(path: str) -> list[tuple[str, int]]:
    fs, name = _open(path)
    info = fs.get_file_info(name)
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(name))
    return sorted((x.path, x.size) for x in found if x.is_file and not x.base_name.startswith(("_", ".")))


def _is_old(f) -> bool:
    """Whether a file is of the first version; leaves the file at its start."""
    magic = f.read(8)
    f.seek(0)
    return magic in (PLAIN_MAGIC, BODY_MAGIC)


def _header(f) -> tuple[list[tuple[str, str, str]], list[str]]:
    first = read_block(f)
    if first is None or first[1] != HEADER_MAGIC:
        raise ValueError("not a record file")
    pairs = decode_header(unpack_items(first[2])[0])
    return pairs, [v for k, _, v in pairs if k == TRANSFORMER_KEY]


def _new_blocks(f, start: int, limit: int, wanted: set[int] | None, change: Change) -> Iterator[tuple[int, list[bytes]]]:
    """(offset, items) of blocks that begin from start on and before limit, or of the wanted ones of these."""
    if wanted is None:
        f.seek(start)
        while f.tell() < limit and (block := read_block(f)) is not None and block[0] < limit:
            if block[1] == BODY_MAGIC:
                yield block[0], unpack_items(change(block[2]))
        return
    for at in sorted(w for w in wanted if start <= w < limit and w % CHUNK == 0):
        f.seek(at)
        block = read_block(f)
        if block is not None and block[0] == at and block[1] == BODY_MAGIC:
            yield at, unpack_items(change(block[2]))


def _old_blocks(f, wanted: set[int] | None, change: Change) -> Iterator[tuple[int, list[bytes]]]:
    """(offset, items) of the records of a file of the first version; data of others than the wanted are skipped."""
    while head := f.read(OLD_HEAD):
        at = f.tell() - len(head)
        if len(head) < OLD_HEAD:
            raise ValueError("a record file is cut off")
        size, crc = struct.unpack("<QI", head[8:])
        if zlib.crc32(head[8:16]) != crc:
            raise ValueError("a record's checksum is wrong")
        if wanted is not None and at not in wanted:
            f.seek(at + OLD_HEAD + size)
            continue
        data = f.read(size)
        if len(data) < size:
            raise ValueError("a record file is cut off")
        if head[:8] == PLAIN_MAGIC:
            yield at, [data]
        elif head[:8] == BODY_MAGIC:
            sizes, end = _sizes(data, 4)
            if zlib.crc32(data[4:end]) != struct.unpack("<I", data[:4])[0]:
                raise ValueError("a packed record's checksum is wrong")
            yield at, _cut(change(data[end:]), 0, sizes)
        else:
            raise ValueError("not a record file")


# -- the data source -----------------------------------------------------------


@dataclass
class Shard(InputPartition):
    path: str
    start: int
    limit: int


def _blocks(root: str, shard: Shard, wanted: set[int] | None, transform: list[str], known: dict[str, tuple[Factory, Factory]]) -> Iterator[tuple[int, list[bytes]]]:
    fs, _ = _open(root)
    with fs.open_input_file(shard.path) as f:
        if _is_old(f):
            names = transform or (["flate"] if shard.path.endswith(OLD_COMPRESSED) else [])
            if shard.start == 0:
                yield from _old_blocks(f, wanted, _chain(names, known, True))
        else:
            _, names = _header(f)
            yield from _new_blocks(f, shard.start, shard.limit, wanted, _chain(names, known, True))


class RecordReader(DataSourceReader):
    def __init__(self, options: dict, known: dict[str, tuple[Factory, Factory]]) -> None:
        self.path, self.part, self.known = options["path"], options.get("part", "items"), known
        self.step = max(1, int(options.get("shardBytes", 64 << 20)) // CHUNK) * CHUNK
        self.transform = _names(options.get("transform"))
        self.only: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("path",), ("block",)):
                values = set(f.value) if isinstance(f, In) else {f.value}
                name = f.attribute[0]
                self.only[name] = self.only[name] & values if name in self.only else values
            yield f  # Spark tests all of them again

    def partitions(self) -> list[Shard]:
        paths, wanted = self.only.get("path"), self._wanted()
        files = [(p, n) for p, n in _files(self.path) if paths is None or p in paths]
        if self.part != "items":
            return [Shard(p, 0, n) for p, n in files]
        # The first shard of a file stays, since a file of the first version is read there.
        own = lambda a: wanted is None or a == 0 or any(a <= w < a + self.step for w in wanted)
        return [Shard(p, a, min(n, a + self.step)) for p, n in files for a in range(0, n, self.step) if own(a)]

    def _wanted(self) -> set[int] | None:
        return self.only.get("block") if self.part == "items" else None

    def read(self, shard: Shard | None) -> Iterator[pa.RecordBatch]:
        if shard is None:  # Spark's call where there are no shards
            return
        if self.part == "items":
            for at, items in _blocks(self.path, shard, self._wanted(), self.transform, self.known):
                n = len(items)
                yield pa.RecordBatch.from_arrays([pa.array([shard.path] * n, pa.string()), pa.array([at] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(items, pa.binary())], names=["path", "block", "item", "value"])
            return
        fs, _ = _open(self.path)
        with fs.open_input_file(shard.path) as f:
            if _is_old(f):
                return
            pairs, names = _header(f)
            rows = [(shard.path, *p) for p in pairs] if self.part == "header" else self._trailer(f, shard, names)
        fields = ["path", "key", "type", "value"] if self.part == "header" else ["path", "value"]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=fields)

    def _trailer(self, f, shard: Shard, names: list[str]) -> list[tuple]:
        f.seek(shard.limit - CHUNK)
        _, _, index, _ = read_chunk(f)
        f.seek(shard.limit - (index + 1) * CHUNK)
        _, magic, payload = read_block(f)
        return [(shard.path, unpack_items(_chain(names, self.known, True)(payload))[0])] if magic == TRAILER_MAGIC else []


@dataclass
class Written(WriterCommitMessage):
    name: str


_INDEX = pa.schema([("key", pa.binary()), ("path", pa.string()), ("block", pa.int64()), ("item", pa.int32())])


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool, known: dict[str, tuple[Factory, Factory]]) -> None:
        self.path, self.index, self.overwrite, self.known = options["path"], options.get("index"), overwrite, known
        self.transform = _names(options.get("transform"))
        _chain(self.transform, known, False)  # an unknown name fails before anything is written
        self.most = int(options.get("maxItems", 16 << 10)) + 1
        self.header = [tuple(x) for x in json.loads(options.get("header", "[]"))]
        self.trailer = options.get("trailer")
        self.job = f"_job-{uuid.uuid4().hex}-"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = _open(self.path)
        fs.create_dir(folder, recursive=True)
        name = f"part-{uuid.uuid4().hex}"
        pairs = [*self.header, *((TRANSFORMER_KEY, t) for t in self.transform), *([(TRAILER_KEY, True)] if self.trailer is not None else [])]
        change = _chain(self.transform, self.known, False)
        index = None
        if self.index:
            index_fs, index_folder = _open(self.index)
            index_fs.create_dir(index_folder, recursive=True)
            index = pq.ParquetWriter(f"{index_folder}/{self.job}{name}", _INDEX, filesystem=index_fs)
        with fs.open_output_stream(f"{folder}/{self.job}{name}") as f:
            f.write(chunks_of(HEADER_MAGIC, pack_items([encode_header(pairs)])))
            items: list[bytes] = []
            keys: list[bytes] = []

            def flush() -> None:
                if index:
                    n = len(items)
                    index.write_table(pa.table([pa.array(keys, pa.binary()), pa.array([f"{folder}/{name}"] * n), pa.array([f.tell()] * n, pa.int64()), pa.array(range(n), pa.int32())], schema=_INDEX))
                f.write(chunks_of(BODY_MAGIC, change(pack_items(items))))
                items.clear()
                keys.clear()

            for batch in batches:
                values = batch.column("value").to_pylist()
                own = batch.column("key").cast(pa.binary()).to_pylist() if index else [None] * len(values)
                for value, key in zip(values, own, strict=True):
                    items.append(value)
                    keys.append(key)
                    if len(items) == self.most:
                        flush()
            if items:
                flush()
            if self.trailer is not None:
                f.write(chunks_of(TRAILER_MAGIC, change(pack_items([self.trailer.encode()]))))
        if index:
            index.close()
        return Written(name)

    def _folders(self) -> list:
        return [_open(p) for p in (self.path, self.index) if p]

    def commit(self, messages: list[Written | None]) -> None:
        for root, (fs, folder) in zip((self.path, self.index), self._folders(), strict=False):
            old = [p for p, _ in _files(root)] if self.overwrite else []
            for m in messages:
                if m:
                    fs.move(f"{folder}/{self.job}{m.name}", f"{folder}/{m.name}")
            for path in old:
                fs.delete_file(path)
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        """Remove what tasks that failed or ran twice have left."""
        for fs, folder in self._folders():
            for info in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
                if info.is_file and info.base_name.startswith(self.job):
                    fs.delete_file(info.path)


class RecordFile(DataSource):
    transformers = TRANSFORMERS

    @classmethod
    def name(cls) -> str:
        return "recordfile"

    def schema(self) -> str:
        return {"items": "path string, block long, item int, value binary", "header": "path string, key string, type string, value string", "trailer": "path string, value binary"}[self.options.get("part", "items")]

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options, self.transformers)

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options, overwrite, self.transformers)


def register(spark: SparkSession, transformers: dict[str, tuple[Factory, Factory]] | None = None) -> None:
    """Make the format known to a session, with further transformers by name; a name that is taken is an error."""
    if taken := set(transformers or {}) & set(TRANSFORMERS):
        raise ValueError(f"transformer {min(taken)} is registered already")

    # A class of its own goes to the workers by value, and the transformers with it.
    class Registered(RecordFile):
        pass

    Registered.transformers = {**TRANSFORMERS, **(transformers or {})}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Registered)


def read_items(locations: DataFrame, transform: str | None = None, transformers: dict[str, tuple[Factory, Factory]] | None = None) -> DataFrame:
    """path, block, item, value of the items at distinct ``locations`` (path, block, item), such as rows of an index.

    Only the blocks named are read, each once where its items meet in one task.
    A location without an item is an error.
    """
    known, names = {**TRANSFORMERS, **(transformers or {})}, _names(transform)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, items = None, []
        for batch in batches:
            values = []
            for path, block, item in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "item")), strict=True):
                if (path, block) != at:
                    _, name = _open(path)
                    found = next(_blocks(path, Shard(name, 0, block + 1), {block}, names, known), None)
                    at, items = (path, block), found[1] if found else []
                if item >= len(items):
                    raise ValueError(f"no item {item} in block {block} of {path}")
                values.append(items[item])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "block", "item")), pa.array(values, pa.binary())], names=["path", "block", "item", "value"])

    wanted = locations.select("path", "block", "item").distinct()
    sorted_ = wanted.repartitionByRange("path", "block", "item").sortWithinPartitions("path", "block", "item")
    return sorted_.mapInArrow(work, "path string, block long, item int, value binary")
