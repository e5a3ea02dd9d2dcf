"""Byte-level BPE: encode texts to ids by merge ranks, decode ids to bytes.

Each match of the split pattern (a *piece*) is merged on its own.  A segment
tree over the piece's byte positions holds, for every live position, the rank of
the pair that starts there; its root is the leftmost pair of least rank.  A
merge kills one position and changes at most three leaves (the pair itself, the
pair before it, the dead position), each a point update of logarithmic cost.
Short pieces are merged many at a time: one row of a NumPy matrix is the tree of
one piece.  Long pieces use one tree in plain lists.  Both are exact, and no
piece or text is cut, so a text of any length gives the ids it should.

The vocabulary (a bounded file, checked against ``MAX_VOCABULARY_BYTES``) is
read on the driver and broadcast; each Python worker builds its tables once.

Defined cases: a null or empty text has no ids (``[]``), decoded to ``b""``;
null ids decode to ``b""``; repeated rows each give a row; an empty table gives
an empty table; other columns pass through unless a result column has the same
name, which then replaces them.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkernels import column_bytes, hash_runs, lists, pieces

MAX_VOCABULARY_BYTES = 64 << 20
#: Pieces that a worker remembers before it starts afresh; bounds its memory.
CACHE_PIECES = 150_000
#: Pieces of up to this many bytes are merged in matrices.
MATRIX_BYTES = 64
NONE = np.int64(1 << 62)
#: Bytes of text that are split and merged in one vectorised step.
STEP_BYTES = 2 << 20
# Fixed value: the split pattern for which piece_starts() gives the matches' begins.
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER, LETTER, NUMBER, BLANK = range(4)


@functools.cache
def _classes() -> np.ndarray:
    """For each code point: letter, number, blank or other."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = (x + 0x800 * (x >= 0xD800) for x in (m.start(), m.end()))
            out[a:b] = kind
    return out


def same_bytes(a: np.ndarray, begin: np.ndarray, end: np.ndarray, b: np.ndarray, begin2: np.ndarray, end2: np.ndarray) -> np.ndarray:
    """Whether each stretch of ``a`` has the bytes of its stretch of ``b``."""
    n = end - begin
    same = n == end2 - begin2
    n = np.where(same, n, 0)
    ends = np.cumsum(n)
    step = np.arange(int(ends[-1]) if len(ends) else 0)
    differ = np.flatnonzero(a[step + np.repeat(begin - (ends - n), n)] != b[step + np.repeat(begin2 - (ends - n), n)])
    same[np.searchsorted(ends, differ, "right")] = False
    return same


def safe_cut(data: np.ndarray, offsets: np.ndarray, a: int) -> int:
    """Where a stretch from ``a`` on can end: at a text's end, or before a lone space between two other ASCII characters, where a piece always begins."""
    if len(data) - a <= STEP_BYTES:
        return len(data)
    ends = offsets[(offsets > a) & (offsets <= a + STEP_BYTES)]
    if len(ends):
        return int(ends[-1])
    at = a + STEP_BYTES
    while at + 1 < len(data):
        part = data[at - 1 : at + STEP_BYTES]
        ink = (part > 0x20) & (part < 0x7F)
        if len(hit := np.flatnonzero((part[1:-1] == 0x20) & ink[:-2] & ink[2:])):
            cut = at + int(hit[0])
            later = offsets[(offsets > a) & (offsets <= cut)]
            return int(later[0]) if len(later) else cut
        at += len(part) - 2
    later = offsets[offsets > a]
    return int(later[0])


def piece_starts(data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Where the matches of KNOWN_PATTERN begin in texts that meet at ``borders``."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    byte = data[lead]
    table = _classes()
    kind = table[byte]
    wide = np.flatnonzero(byte >= 0x80)
    if len(wide):
        at, first = lead[wide], byte[wide].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        code = first & (0xFF >> (size + 1))
        for k in (1, 2, 3):
            more = size > k
            code[more] = (code[more] << 6) | (data[at[more] + k] & 0x3F)
        kind[wide] = table[code]
    n = len(lead)
    fresh = np.zeros(n + 1, bool)  # a text begins
    fresh[np.searchsorted(lead, borders)] = True
    fresh[0] = fresh[n] = True
    run = fresh[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    blank = kind == BLANK
    # A blank is its run's last, and other characters of the same text follow.
    tail = np.zeros(n, bool)
    tail[:-1] = blank[:-1] & ~blank[1:] & ~fresh[1:n]
    begin = run | tail
    lone = np.flatnonzero(tail & (byte == 0x20))
    begin[lone + 1] = False  # this space goes to what follows
    # Contractions: an apostrophe that begins a piece and the letters after it.
    quote = np.flatnonzero(begin & (byte == 0x27))
    if len(quote):
        padded = np.append(byte, np.zeros(3, np.uint8))
        ended = np.append(fresh, np.ones(3, bool))
        one, two = padded[quote + 1], padded[quote + 2]
        near = ~ended[quote + 1]
        short = near & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        pair = near & ~ended[quote + 2] & np.isin(one.astype(np.int64) * 256 + two, [ord(x) * 256 + ord(y) for x, y in ("re", "ve", "ll")])
        for some, k in ((quote[short], 2), (quote[pair & ~short], 3)):
            begin[some + 1] = False
            begin[(some + k)[some + k < n]] = True
    return lead[begin]


class Vocabulary:
    """Merge tables of one ranks file; lives in a Python worker."""

    def __init__(self, raw: bytes, pattern: str) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        self.pattern = regex.compile(pattern)
        size = max(ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[(left << 32) | right] = rank
        self.pairs = pairs
        self._hash_pairs(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64))
        raw2 = np.arange(65536)
        self.byte_pair_ranks = self.pair_ranks(self.byte_ids[raw2 >> 8], self.byte_ids[raw2 & 255])
        self.fast = pattern == KNOWN_PATTERN
        self._forget()

    def _hash_pairs(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        bits = max(4, int(len(keys)).bit_length() + 2)
        self.shift, self.slots_mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slot_key, self.slot_rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int64)
        slot, self.probes = self._slot(keys), 0
        while len(keys):
            free = self.slot_key[slot] < 0
            self.slot_key[slot[free]] = keys[free]  # of several, one stays
            placed = self.slot_key[slot] == keys
            self.slot_rank[slot[placed]] = ranks[placed]
            keys, ranks, slot = keys[~placed], ranks[~placed], (slot[~placed] + 1) & self.slots_mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it can't merge; ids below 0 never merge."""
        keys = (left << np.int64(32)) | right
        bad = (left < 0) | (right < 0)
        slot = self._slot(keys)
        found = self.slot_key[slot]
        out = np.where(found == keys, self.slot_rank[slot], NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0) & ~bad)
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self.slots_mask
            found = self.slot_key[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.slot_rank[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        out[bad] = NONE
        return out

    # -- merging ---------------------------------------------------------

    def merge_matrix(self, data: np.ndarray, start: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each piece) of pieces of at most ``width`` bytes, a power of two."""
        n = len(start)
        place = np.arange(width)
        inside = place < lengths[:, None]
        raw = data[np.minimum(start[:, None] + place, len(data) - 1)]
        # Flat arrays, a stretch of each for each piece: ids, live neighbours, and the tree of pair keys.
        ids = np.where(inside, self.byte_ids[raw], -1).ravel()
        after = np.tile(np.arange(1, width + 1), n)  # next live position; width: none
        before = np.tile(np.arange(-1, width - 1), n)
        tree2 = np.full((n, 2 * width), NONE, np.int64)
        rank = np.where(inside[:, 1:], self.byte_pair_ranks[raw[:, :-1].astype(np.int64) * 256 + raw[:, 1:]], NONE)
        tree2[:, width : 2 * width - 1] = np.where(rank < NONE, rank * width + place[:-1], NONE)
        level = width
        while level > 1:
            half = level // 2
            np.minimum(tree2[:, level : 2 * level : 2], tree2[:, level + 1 : 2 * level : 2], out=tree2[:, half:level])
            level = half
        tree = tree2.ravel()
        live = np.flatnonzero(tree2[:, 1] < NONE)
        best = tree2[live, 1]
        bits = width.bit_length() - 1
        while len(live):
            at, here = best & (width - 1), best >> bits
            base = live << bits
            dead = after[base + at]
            then = after[base + dead]
            ids[base + at] = here
            ids[base + dead] = -1
            after[base + at] = then
            inner = then < width
            before[(base + then)[inner]] = at[inner]
            ahead = before[base + at]
            has = ahead >= 0
            right = np.where(inner, ids[base + np.minimum(then, width - 1)], -1)
            left = np.where(has, ids[base + np.maximum(ahead, 0)], -1)
            fresh = self.pair_ranks(np.concatenate([here, left]), np.concatenate([right, here]))
            key = np.where(fresh < NONE, (fresh << bits) + np.concatenate([at, ahead]), NONE)
            k, top = len(live), base << 1
            # Three leaves change; then the nodes above them, level by level.
            tree[top + width + dead] = NONE
            tree[top + width + at] = key[:k]
            tree[(top + width + ahead)[has]] = key[k:][has]
            node = np.concatenate([width + at, width + dead, width + np.where(has, ahead, at)])
            top3 = np.concatenate([top, top, top])
            for _ in range(bits):
                node >>= 1
                below = top3 + (node << 1)
                tree[top3 + node] = np.minimum(tree[below], tree[below + 1])
            best = tree[top + 1]
            on = best < NONE
            live, best = live[on], best[on]
        keep = ids >= 0
        return ids[keep], keep.reshape(n, width).sum(axis=1)

    def merge_long(self, piece: bytes) -> list[int]:
        """The ids of one piece of any length."""
        n, none, pairs = len(piece), int(NONE), self.pairs
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        width = 1 << max(1, (n - 1).bit_length())
        tree = [none] * (2 * width)
        for i in range(n - 1):
            if (rank := pairs.get((ids[i] << 32) | ids[i + 1])) is not None:
                tree[width + i] = rank * width + i
        for node in range(width - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(leaf: int, key: int) -> None:
            node = leaf + width
            tree[node] = key
            while node > 1:
                other = tree[node ^ 1]
                key = key if key < other else other
                node >>= 1
                if tree[node] == key:
                    break
                tree[node] = key

        while (best := tree[1]) < none:
            rank, at = divmod(best, width)
            dead = after[at]
            then = after[at] = after[dead]
            ids[at], ids[dead] = rank, -1
            put(dead, none)
            if then < n:
                before[then] = at
                fresh = pairs.get((rank << 32) | ids[then])
                put(at, none if fresh is None else fresh * width + at)
            else:
                put(at, none)
            if (ahead := before[at]) >= 0:
                fresh = pairs.get((ids[ahead] << 32) | rank)
                put(ahead, none if fresh is None else fresh * width + ahead)
        return [x for x in ids if x >= 0]

    # -- whole texts -----------------------------------------------------

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.all_flat, self.all_starts = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.all_bytes, self.byte_starts = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def _learn(self, data: np.ndarray, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Merge pieces not seen yet; afterwards ``known`` has their rows in ``all_starts``."""
        lengths = end - start
        width = np.left_shift(1, np.maximum(1, np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64)))
        width[lengths > MATRIX_BYTES] = 0
        flats, counts, names, order = [], [], [], []
        for w in np.unique(width).tolist():
            members = np.flatnonzero(width == w)
            step = max(1, (1 << 19) // w) if w else len(members)
            for a in range(0, len(members), step):
                some = members[a : a + step]
                if w:
                    flat, n = self.merge_matrix(data, start[some], lengths[some], w)
                else:
                    each = [self.merge_long(data[start[i] : end[i]].tobytes()) for i in some]
                    flat, n = np.array([x for y in each for x in y]), np.array([len(y) for y in each])
                flats.append(flat.astype(np.int32))
                counts.append(n)
                names.append(hashes[some])
                order.append(some)
        fresh = np.concatenate(names).tolist()
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        self.all_flat = np.concatenate([self.all_flat, *flats])
        self.all_starts = np.concatenate([self.all_starts, self.all_starts[-1] + np.cumsum(np.concatenate(counts))])
        own = np.concatenate(order)
        n, ends = lengths[own], np.cumsum(lengths[own])
        self.all_bytes = np.concatenate([self.all_bytes, data[np.arange(int(ends[-1])) + np.repeat(start[own] - (ends - n), n)]])
        self.byte_starts = np.concatenate([self.byte_starts, self.byte_starts[-1] + ends])

    def encode_pieces(self, data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each piece); the pieces tile ``data`` and begin at ``start``."""
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        end = np.append(start[1:], len(data))
        hashes, first, back = np.unique(hash_runs(data, start, end), return_index=True, return_inverse=True)
        if len(self.known) > CACHE_PIECES:
            self._forget()
        get = self.known.get
        rows = np.array([get(h, -1) for h in hashes.tolist()], np.int64)
        new = np.flatnonzero(rows < 0)
        if len(new):
            self._learn(data, hashes[new], start[first[new]], end[first[new]])
            rows[new] = [self.known[h] for h in hashes[new].tolist()]
        rows = rows[back]
        # An equal hash is no proof: pieces with other bytes than the known ones are merged on their own.
        other = np.flatnonzero(~same_bytes(data, start, end, self.all_bytes, self.byte_starts[rows], self.byte_starts[rows + 1]))
        begin = self.all_starts[rows]
        n = self.all_starts[rows + 1] - begin
        flat = self.all_flat
        for i in other.tolist():
            own = np.array(self.merge_long(data[start[i] : end[i]].tobytes()), np.int32)
            begin[i], n[i] = len(flat), len(own)
            flat = np.concatenate([flat, own])
        ends = np.cumsum(n)
        return flat[np.repeat(begin - (ends - n), n) + np.arange(int(ends[-1]))], n

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each text) of UTF-8 texts that lie one after another."""
        flats, counts = [], np.zeros(len(offsets), np.int64)
        for a, b, start in self._starts(data, offsets):
            flat, n = self.encode_pieces(data[a:b], start)
            flats.append(flat)
            text = np.searchsorted(offsets, start + a, "right") - 1
            counts += np.bincount(text, weights=n, minlength=len(offsets)).astype(np.int64)
        return np.concatenate(flats) if flats else np.zeros(0, np.int32), counts[:-1]

    def _starts(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Stretches of ``data`` and where pieces begin in each, from its begin."""
        if self.fast:
            a = 0
            while a < len(data):
                b = safe_cut(data, offsets, a)
                yield a, b, piece_starts(data[a:b], offsets[(offsets > a) & (offsets < b)] - a)
                a = b
        else:
            found = self.pattern.findall
            for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
                text = data[a:b].tobytes()
                sizes = [len(p.encode()) for p in found(text.decode())]
                if sum(sizes) != b - a:
                    raise ValueError("a split pattern has to match every character of a text")
                yield a, b, np.cumsum([0, *sizes])[:-1]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def decode_each(self, column: pa.ListArray) -> list[bytes]:
        starts, flat = column.offsets.to_numpy(), column.values.to_numpy()
        return [self.decode(flat[a:b]) for a, b in zip(starts, starts[1:], strict=False)]


_loaded: dict[str, Vocabulary] = {}


def _vocabulary(raw: bytes, pattern: str) -> Vocabulary:
    key = hashlib.sha256(raw + pattern.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(raw, pattern)
    return _loaded[key]


def _defaults(path: str | None, pattern: str | None) -> tuple[bytes, str]:
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"a ranks file of over {MAX_VOCABULARY_BYTES} bytes isn't broadcast")
    return raw, pattern or public_tokenizers.PATTERN


def _with_column(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, pattern: str | None = None, decoded: str | None = None) -> DataFrame:
    """``df`` without ``text``, with ``ids`` (array<int>) of each whole text; see the module for special cases.

    With a name for ``decoded``, the ids are also decoded to bytes in the same
    task, which spares it a second Python worker.
    """
    raw, pattern = _defaults(path, pattern)
    shared = df.sparkSession.sparkContext.broadcast(raw)
    out = [c for c in df.columns if c not in (text, ids, decoded)]
    made = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.BinaryType())] if decoded else [])
    schema = T.StructType([*(df.schema[c] for c in out), *made])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared.value, pattern)
        for batch in pieces(batches, text, 2 << 20):
            flat, n = vocabulary.encode(*column_bytes(batch.column(text)))
            columns = [*(batch.column(c) for c in out), lists(flat, n, pa.int32())]
            if decoded:
                columns.append(pa.array(vocabulary.decode_each(columns[-1]), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(work, schema)


def decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the bytes (binary) that ``ids`` stand for."""
    raw, pattern = _defaults(path, None)
    shared = df.sparkSession.sparkContext.broadcast(raw)
    out = [c for c in df.columns if c != decoded]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared.value, pattern)
        for batch in batches:
            texts = vocabulary.decode_each(batch.column(ids))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), pa.array(texts, pa.binary())], names=[*out, decoded])

    return df.mapInArrow(work, _with_column(df, decoded, T.BinaryType()))


def digests(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` without ``ids``, with n_tokens, ids_sha256 (of little-endian uint32 ids), decoded_sha256 (of the decoded bytes)."""
    raw, pattern = _defaults(path, None)
    shared = df.sparkSession.sparkContext.broadcast(raw)
    made = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    out = [c for c in df.columns if c != ids and c not in made]
    schema = T.StructType([*(df.schema[c] for c in out), *(T.StructField(c, t) for c, t in made.items())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared.value, pattern)
        for batch in batches:
            column = batch.column(ids)
            starts = column.offsets.to_numpy()
            flat = column.values.to_numpy().astype("<u4")
            spans = list(zip(starts, starts[1:], strict=False))
            n = pa.array(np.diff(starts), pa.int64())
            a = [hashlib.sha256(flat[x:y].tobytes()).hexdigest() for x, y in spans]
            b = [hashlib.sha256(vocabulary.decode(flat[x:y])).hexdigest() for x, y in spans]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), n, pa.array(a), pa.array(b)], names=[*out, *made])

    return df.mapInArrow(work, schema)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document, as counts and digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    return digests(encode(docs))
