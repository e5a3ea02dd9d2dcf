"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are lower-cased and white space is made single spaces.  An item of ``m``
characters leaks into a document where some passage is within ``e`` edits
(``max_edit`` of m, rounded down).  Such a passage shares at least
``m + 1 - q (e + 1)`` q-grams with the item, on diagonals (position in the
document less position in the item) at most ``e`` apart.  Shared q-grams are
counted in bands of 2 (e + 1) diagonals that overlap by half, so one band holds
them all; bands that reach the bound are merged where they touch, and each is
verified by an alignment of the item inside that stretch of the document.

The benchmark is small and the documents are not: items are cut into blocks of
at most ``BLOCK_CHARS`` characters (checked by counting), one block at a time is
broadcast, and each document is read where it lies.  Nothing is shuffled.

Defined cases: null or empty texts leak nothing and nothing leaks into them;
items of under 20 characters are only found exactly, items of under ``MIN_CHARS``
never; equal items, and items in several places, each give a row; repeated
documents each give their rows; empty tables give none; other columns pass
through ``with_leaks``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkernels import mix, pieces

Q = 8
MAX_EDIT = 0.1
MIN_CHARS = 12
BLOCK_CHARS = 2_000_000
BITS = 22
#: No character; stands between documents.
GAP = np.uint32(0x110000)
LEAK = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("edits", T.IntegerType())]))


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(code: np.ndarray, q: int) -> np.ndarray:
    n = len(code) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = code.astype(np.uint64)
    out = wide[:n].copy()
    for k in range(1, q):
        out *= np.uint64(0x100000001B3)
        out += wide[k : n + k]
    return mix(out)


class Items:
    """The q-gram index of one block of items; lives in a Python worker."""

    def __init__(self, items: list[tuple[int, str]], max_edit: float) -> None:
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        self.codes = [codes(t) for t in self.texts]
        self.edits = [int(len(t) * max_edit) if len(t) >= 20 else 0 for t in self.texts]
        by_q: dict[int, list[int]] = {}
        for k, (t, e) in enumerate(zip(self.texts, self.edits, strict=True)):
            by_q.setdefault(max(1, min(Q, (len(t) - 3) // (e + 1))), []).append(k)
        self.index = {q: self._index(q, members) for q, members in by_q.items()}

    def _index(self, q: int, members: list[int]) -> tuple[np.ndarray, ...]:
        gram = [grams(self.codes[k], q) for k in members]
        item = np.repeat(np.array(members), [len(g) for g in gram])
        pos = np.concatenate([np.arange(len(g)) for g in gram])
        gram = np.concatenate(gram)
        order = np.argsort(gram, kind="stable")
        gram, item, pos = gram[order], item[order], pos[order]
        known, first = np.unique(gram, return_index=True)
        flags = np.zeros(1 << BITS, bool)
        flags[(known >> np.uint64(64 - BITS)).astype(np.int64)] = True
        return flags, known, np.append(first, len(gram)), item, pos

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(document, item, start, end, edits) of leaks into normal texts."""
        each = [codes(t) for t in texts]
        gap = np.array([GAP], np.uint32)
        joined = np.concatenate([x for c in each for x in (c, gap)]) if each else gap
        begins = np.concatenate([[0], np.cumsum([len(c) + 1 for c in each])])
        found: set[tuple[int, int, int, int, int]] = set()
        edits = np.array(self.edits)
        sizes = np.array([len(t) for t in self.texts])
        for q, (flags, known, first, item, pos) in self.index.items():
            gram = grams(joined, q)
            near = np.flatnonzero(flags[(gram >> np.uint64(64 - BITS)).astype(np.int64)])
            at = np.minimum(np.searchsorted(known, gram[near]), len(known) - 1)
            hit = known[at] == gram[near]
            near, at = near[hit], at[hit]
            n = first[at + 1] - first[at]
            ends = np.cumsum(n)
            entry = np.repeat(first[at] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
            place, who = np.repeat(near, n), item[entry]
            diagonal = place - pos[entry]
            half = edits[who] + 1
            band = diagonal // half
            # Both bands that a diagonal lies in, each band named by its first half.
            who2, band2 = np.concatenate([who, who]), np.concatenate([band, band - 1])
            key, counts = np.unique((who2.astype(np.int64) << 40) + (band2 + (1 << 20)), return_counts=True)
            whose, bands = key >> 40, (key & ((1 << 40) - 1)) - (1 << 20)
            enough = counts >= sizes[whose] + 1 - q * (edits[whose] + 1)
            whose, bands = whose[enough], bands[enough]
            # Bands of one item that touch are verified at once.
            cut = np.flatnonzero((np.diff(whose) != 0) | (np.diff(bands) > 1)) + 1
            for a, b in zip(np.append(0, cut), np.append(cut, len(whose)), strict=True):
                if b > a:
                    k = int(whose[a])
                    e = self.edits[k]
                    low = int(bands[a]) * (e + 1) - e
                    high = (int(bands[b - 1]) + 2) * (e + 1) + len(self.texts[k]) + e
                    self._verify(k, low, high, texts, begins, found)
        return sorted(found)

    def _verify(self, k: int, low: int, high: int, texts: list[str], begins: np.ndarray, found: set) -> None:
        d = max(0, int(np.searchsorted(begins, low, "right")) - 1)
        while d < len(texts) and begins[d] < high:
            a, b = max(0, low - int(begins[d])), min(len(texts[d]), high - int(begins[d]))
            if b > a:
                part = texts[d][a:b]
                if (at := part.find(self.texts[k])) >= 0:
                    found.add((d, self.ids[k], a + at, a + at + len(self.texts[k]), 0))
                else:
                    e, end = align(self.codes[k], codes(part), self.edits[k])
                    if e <= self.edits[k]:
                        _, back = align(self.codes[k][::-1], codes(part[:end])[::-1], self.edits[k])
                        found.add((d, self.ids[k], a + end - back, a + end, e))
            d += 1


def align(item: np.ndarray, part: np.ndarray, most: int) -> tuple[int, int]:
    """(edits, end) of the best match of ``item`` that ends first in ``part``; stops where all exceed ``most``.

    The band is the stretch of ``part`` around the diagonals that reached the
    bound, so whole rows of it are the banded matrix.
    """
    n = len(part)
    step = np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    for i, c in enumerate(item.tolist()):
        new = np.empty(n + 1, np.int64)
        new[0] = i + 1
        np.minimum(row[:-1] + (part != c), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - step) + step
        if row.min() > most:
            return most + 1, 0
    end = int(row.argmin())
    return int(row[end]), end


_loaded: dict[int, Items] = {}


def with_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", leaks: str = "leaks", max_edit: float = MAX_EDIT) -> DataFrame:
    """``docs`` and ``leaks``: array of (item_id, start, end, edits), positions in the normal form of the text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = 1 + total // BLOCK_CHARS
    df = docs.withColumn(leaks, F.array().cast(LEAK))
    for block in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else items
        rows = sorted({(r["item_id"], x) for r in some.collect() if len(x := normal(r["text"])) >= MIN_CHARS})
        if rows:
            df = _with_block(df, rows, text, leaks, max_edit)
    return df


def _with_block(df: DataFrame, rows: list[tuple[int, str]], text: str, leaks: str, max_edit: float) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(rows)
    key = hash((tuple(rows), max_edit))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = Items(shared.value, max_edit)
        items = _loaded[key]
        for batch in pieces(batches, text, 2 << 20):
            texts = [normal(t) for t in batch.column(text).to_pylist()]
            lists = batch.column(leaks).to_pylist()
            for d, item, start, end, edits in items.find(texts):
                lists[d].append({"item_id": item, "start": start, "end": end, "edits": edits})
            at = batch.schema.get_field_index(leaks)
            yield batch.set_column(at, leaks, pa.array(lists, kind))

    return df.mapInArrow(work, df.schema)


def leak_rows(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per leak: doc_id, item_id, start, end, edits."""
    found = with_leaks(docs.select(id_column, text), benchmark, text)
    return found.select(id_column, F.explode("leaks").alias("l")).select(id_column, "l.*")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak of a benchmark item into a document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return leak_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
