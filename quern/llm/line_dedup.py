"""Line dedup by pairwise alignment.

Documents that share rare line hashes are found by joins, aligned by patience
diff, and the aligned common blocks are deleted from the later document (the one
of greater id).  A line of ``EVIDENCE_WORDS`` or more words in at most ``RARE``
documents pairs each of its documents with all earlier ones, at most ``RARE`` - 1.
What is in more documents pairs by longer things, whatever their number: from each
line the shortest run of lines with ``BLOCK_WORDS`` words, onwards and backwards,
and the list of all lines pair a document with the least one that holds them, found
as a minimum before the shuffle, so a block in a third of all documents costs one
row a run and document and never a pair of each two.  Any block of that many words
that a document shares with an earlier one is covered by such runs, each of which
the earlier document or one before it holds.

Deleted are blocks of consecutive aligned lines that hold a rare line of the pair,
or ``BLOCK_WORDS`` words or more; and everything in a document whose lines are
those of an earlier one.  Alignment is against documents as they came, so the
result doesn't depend on an order of work.

Defined cases: a null or empty text has no lines; empty lines don't take part
and stay; texts of any length count whole; equal lines in one document are told
apart by their place; of alignments of equal length one is taken, the same each
time; rows of one id and text are one document, rows of one id with other texts
are documents of their own, ordered by a hash of the text; null ids are left out
of the pairs and kept as they are; an empty table gives an empty one; other
columns, of any name, pass through ``dedup_lines``, which leaves out documents
that lose all lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .apart import apart
from .durable import drop_durable, durable
from .textkernels import BASE, NEWLINE, column_bytes, lists, mix, pieces, runs

RARE = 16
EVIDENCE_WORDS, BLOCK_WORDS = 5, 20
_ROW = "struct<doc_id:long,key:long>"


def _row() -> Column:
    return F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key")).alias("row")


def line_table(docs: DataFrame) -> DataFrame:
    """row (doc_id, key), hashes, words, places (line numbers) of the lines of each document (doc_id, text) that aren't empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            data, offsets = column_bytes(batch.column("text"))
            start, end, hashes, first = runs(data, offsets, NEWLINE)
            word, _, _, _ = runs(data, offsets)
            words = np.searchsorted(word, end) - np.searchsorted(word, start)
            breaks = np.flatnonzero(data == 0x0A)
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            places = np.searchsorted(breaks, start) - np.searchsorted(breaks, offsets[:-1])[doc]
            n = np.diff(first)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), lists(hashes.view(np.int64), n, pa.int64()), lists(words, n, pa.int32()), lists(places, n, pa.int32())],
                names=["row", "hashes", "words", "places"],
            )

    return docs.select(_row(), "text").mapInArrow(work, f"row {_ROW}, hashes array<long>, words array<int>, places array<int>")


#: Inverse of the odd ``BASE``: hashes of any run of lines come from one running sum.
_INVERSE = pow(BASE, -1, 1 << 64)


def shortest_runs(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the shortest runs of ``BLOCK_WORDS`` words that begin or end at each line, inside the documents that begin at ``offsets``."""
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    n = np.diff(offsets)
    each = np.arange(len(words))
    onwards = np.searchsorted(total, total[:-1] + BLOCK_WORDS)
    backwards = np.searchsorted(total, total[1:] - BLOCK_WORDS, "right") - 1
    inside, after = onwards <= np.repeat(offsets[1:], n), backwards >= np.repeat(offsets[:-1], n)
    both = np.column_stack([np.concatenate([each[inside], backwards[after]]), np.concatenate([onwards[inside], each[after] + 1])])
    first, end = np.unique(both, axis=0).T
    return first, end


def _parts(lines: DataFrame) -> DataFrame:
    """row, part: hashes of each document's shortest runs of enough words, and of all its lines."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("hashes")
            offsets = column.offsets.to_numpy().astype(np.int64)
            hashes = column.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)
            words = batch.column("words").flatten().to_numpy()
            offsets = offsets - offsets[0]
            first, end = shortest_runs(words, offsets)
            full = np.flatnonzero(np.diff(offsets))
            first, end = np.concatenate([first, offsets[full]]), np.concatenate([end, offsets[full + 1]])
            kind = np.repeat(np.array([0, 1], np.uint64), [len(first) - len(full), len(full)])
            power, back = (np.cumprod(np.repeat(np.array([1, x], np.uint64), [1, len(hashes)])) for x in (BASE, _INVERSE))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes) * power[:-1], dtype=np.uint64)])
            part = mix((total[end] - total[first]) * back[first] + (end - first).astype(np.uint64) * np.uint64(2) + kind)
            doc = np.searchsorted(offsets, first, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(doc)), pa.array(part.view(np.int64))], names=["row", "part"])

    return lines.where(F.size("hashes") > 0).select("row", "hashes", "words").mapInArrow(work, f"row {_ROW}, part long")


def pairs(lines: DataFrame) -> DataFrame:
    """row, earlier, evidence (rare line hashes): the pairs to align, from a line table of unique rows."""
    wordy = F.filter(F.arrays_zip("hashes", "words"), lambda x: x["words"] >= EVIDENCE_WORDS)
    each = lines.select("row", F.explode(F.array_distinct(F.transform(wordy, lambda x: x["hashes"]))).alias("h"))
    rare = each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where((F.col("df") > 1) & (F.col("df") <= RARE)).select("h")
    # At most RARE rows in a list.
    lists_ = each.join(rare, "h").groupBy("h").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    both = lists_.select("h", "rows", F.posexplode("rows").alias("i", "row")).where("i > 0")
    by_line = both.select("row", F.explode(F.slice("rows", F.lit(1), F.col("i"))).alias("earlier"), "h").groupBy("row", "earlier").agg(F.collect_list("h").alias("evidence"))

    held = _parts(lines)
    first = held.groupBy("part").agg(F.min("row").alias("earlier"), F.max("row").alias("last")).where("earlier < last").drop("last")
    by_part = held.join(first, "part").where("row > earlier").select("row", "earlier").distinct()
    return by_part.join(by_line, ["row", "earlier"], "full").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<long>")))


def _increasing(js: list[int]) -> list[int]:
    """Indices of a longest increasing run of ``js``, by patience piles."""
    from bisect import bisect_left

    tops: list[int] = []
    pile: list[int] = []
    back = [-1] * len(js)
    for k, j in enumerate(js):
        at = bisect_left(tops, j)
        back[k] = pile[at - 1] if at else -1
        if at == len(tops):
            tops.append(j)
            pile.append(k)
        else:
            tops[at], pile[at] = j, k
    out = []
    k = pile[-1] if pile else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned (index in a, index in b) of equal lines, both increasing."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, ii, j, jj = work.pop()
        while i < ii and j < jj and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < ii and j < jj and a[ii - 1] == b[jj - 1]:
            ii, jj = ii - 1, jj - 1
            out.append((ii, jj))
        if i == ii or j == jj:
            continue
        seen: dict[int, int] = {}
        for k in range(i, ii):
            seen[a[k]] = -1 if a[k] in seen else k
        there: dict[int, int] = {}
        for k in range(j, jj):
            if seen.get(b[k], -1) >= 0:
                there[b[k]] = -1 if b[k] in there else k
        both = sorted((seen[h], k) for h, k in there.items() if k >= 0)
        if not both:
            continue
        anchors = [both[k] for k in _increasing([y for _, y in both])]
        for (x, y), (xx, yy) in zip([(i - 1, j - 1), *anchors], [*anchors, (ii, jj)], strict=True):
            if x + 1 < xx and y + 1 < yy:
                work.append((x + 1, xx, y + 1, yy))
        out += anchors
    return sorted(out)


def common_blocks(a: list[int], b: list[int], evidence: set[int], words: list[int]) -> list[int]:
    """Lines of ``b`` in aligned blocks that hold an evidence line or enough words; all of them if the lists are equal."""
    if a == b:
        return list(range(len(b)))
    gone: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if any(b[k] in evidence for k in block) or sum(words[k] for k in block) >= BLOCK_WORDS:
                gone += block
            block = []
        block.append(j)
        last = (i, j)
    return gone


def deletions(lines: DataFrame) -> DataFrame:
    """row, gone (sorted line numbers): what each document loses, from a line table of unique rows."""
    later = lines.select("row", F.col("hashes").alias("b"), "words", "places")
    earlier = lines.select(F.col("row").alias("earlier"), F.col("hashes").alias("a"))
    joined = pairs(lines).join(later, "row").join(earlier, "earlier").select("row", "a", "b", "words", "places", "evidence")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "evidence", "words", "places")), strict=True)
            gone = [[places[k] for k in common_blocks(a, b, set(evidence), words)] for a, b, evidence, words, places in rows]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(gone, pa.list_(pa.int32()))], names=["row", "gone"])

    found = joined.mapInArrow(work, f"row {_ROW}, gone array<int>").select("row", F.explode("gone").alias("line"))
    return found.groupBy("row").agg(F.array_sort(F.collect_set("line")).alias("gone"))


def _prepared(docs: DataFrame) -> DataFrame:
    # Rows of one id and text are one; this moves line hashes only.
    lines = line_table(docs.select("doc_id", "text").where("CAST(doc_id AS long) IS NOT NULL"))
    return durable(lines.dropDuplicates(["row"]), "line-table")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with common blocks deleted from ``text``; documents that lose all their lines are left out."""
    lines = _prepared(docs)
    gone = durable(deletions(lines), "line-deletions")
    drop_durable(lines)
    mine, lost = (next(n for k in range(99) if (n := f"{x}{k}") not in docs.columns) for x in ("_row", "_lost"))
    may, rest = apart(docs, _row(), gone.select("row"))
    joined = may.withColumn(mine, _row()).join(gone.select(F.col("row").alias(mine), F.col("gone").alias(lost)), mine, "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(lost, i))
    cut = joined.withColumn("text", F.when(F.col(lost).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    return cut.where(F.col(lost).isNull() | F.col("text").rlike(r"[^\n]")).select(*docs.columns).union(rest)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, deleted lines and their numbers for every document of one id and text."""
    lines = _prepared(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = lines.select("row", F.size("hashes").cast("long").alias("n_lines")).join(deletions(lines), "row", "left")
    return out.select("row.doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"), F.array_join(F.coalesce("gone", F.array().cast("array<int>")), ",").alias("deleted"))
