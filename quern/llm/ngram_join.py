"""Exact n-gram Jaccard join by prefix filters under several token orders.

Two documents link when the Jaccard similarity of their sets of word n-grams
reaches a threshold; the result is each document's set size and connected
component.  In any global order of tokens, similar sets share a token among their
first ones (their prefixes).  Three orders are used and a pair has to pass all:

1. by level, then hash: a token's level is the logarithm of the number of
   documents that hold it, so that the prefix has a document's own tokens first
   and those of passages and groups of copies last; prefix tokens that two
   documents share make the pairs;
2. by level, then another hash;
3. by hash, descending.

A pair is verified only if its documents' prefixes meet in orders 2 and 3 too and
a lower bound of their difference allows a link: the parities of tokens per hash
class, about two bits a token, differ in no more bits than the sets in tokens.  Then sets are intersected and compared in integers.

Levels come from counts of all tokens in all documents.  Any table gives a
consistent order, so results are exact whatever it holds; it has a fixed number
of slots, and the least counted level rises with the corpus so that few slots are
taken.

Work is bounded as follows.  Equal sets are first made one.  Tokens that one set
alone has in its prefix never leave the counting step.  Of the documents that
share a prefix token, all are compared with one *pivot*, that whose tokens are the
most frequent around; what links then forms components.  Only where a token still
joins different components, documents of different components meet, in blocks of
bounded size, and only pairs whose sizes and parity sketches allow a link leave a
block.  No pair that could link two components is skipped, so components are
those of all links.  Documents that share rare tokens, don't link and pass every
bound are the pairs that remain; their number is quadratic in such a family.

Hashes have 64 bits; sets count as equal when their 64-bit digests are.

Defined cases: each row is a document of its own, so repeated ids with different
texts can be in different components, and rows of equal texts are in one; a null
or empty text, or one of separators only, has an empty set, 0 shingles, and is
its own component; fewer words than ``n`` make one shingle of the whole sequence;
rows with a null id link with nothing and have a null component; texts of any
length count whole; pairs just at
the threshold link; an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .apart import apart
from .components import components
from .durable import drop_durable, durable
from .textkernels import MIX_1, column_bytes, lists, mix, pieces, runs, shingles

#: Bits of a parity sketch: a power of two from a token's two bits on, within these bounds.
LEAST_BITS, MOST_BITS = 64, 1 << 16
#: Documents of one list that meet in one block.
BLOCK = 4096
#: Slots of the level table, the most tokens that get a level, and the least count that does.
SLOT_BITS, MOST_COUNTED, LEAST_COUNT = 24, 1 << 20, 16
#: Leading bits of a hash that are counted apart; what shares them shares a level. The rest of a long holds a batch's count.
COUNTED_BITS = 40


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any set it links with."""
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int) -> int:
    return n - needed(n, percent) + 1


def sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = column_bytes(column)
    _, _, words, first = runs(data, offsets, lower=True)
    every = shingles(words, width) if len(words) >= width else words
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        yield np.unique(every[a : b - width + 1] if b - a >= width else shingles(words[a:b], width))


def node_of(s: np.ndarray) -> int:
    """A digest of a whole set, as a signed long."""
    both = mix(np.array([mix(s, 1).sum(dtype=np.uint64)]) * np.uint64(MIX_1) + mix(s, 2).sum(dtype=np.uint64) + np.uint64(len(s)))
    return int(both.view(np.int64)[0])


# -- levels --------------------------------------------------------------------


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _levels(docs: DataFrame, width: int) -> np.ndarray:
    """The level of each slot of token hashes: 0, or 1 + log2 of the documents that hold its most frequent token over the least counted number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 8 << 20):
            every = list(sets(batch.column("text"), width))
            h, n = np.unique(np.concatenate(every) >> np.uint64(64 - COUNTED_BITS), return_counts=True)
            # A batch has fewer texts with words than the other bits can count.
            packed = h.astype(np.int64) << (64 - COUNTED_BITS) | n
            yield pa.RecordBatch.from_arrays([pa.array(packed)], names=["packed"])

    # Batches have added up what repeats in them; dealing rows by token first spares a map of all tokens in each reading task.
    h = F.shiftrightunsigned("packed", 64 - COUNTED_BITS)
    dealt = docs.select("text").mapInArrow(work, "packed long").repartition(h)
    counted = dealt.groupBy(h.alias("h")).agg(F.sum(F.col("packed").bitwiseAND((1 << (64 - COUNTED_BITS)) - 1)).alias("n")).where(F.col("n") >= LEAST_COUNT)
    counted = durable(counted.select("h", F.floor(F.log2(F.col("n") / LEAST_COUNT)).cast("int").alias("level")), "ngram-counts")
    # At most 64 rows.
    have = {r["level"]: r["n"] for r in counted.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    least = next(k for k in range(65) if sum(n for level, n in have.items() if level >= k) <= MOST_COUNTED)
    table = np.zeros(1 << SLOT_BITS, np.uint8)
    # At most MOST_COUNTED rows of two ints, whatever the corpus.
    slot = F.shiftrightunsigned("h", COUNTED_BITS - SLOT_BITS).cast("int").alias("slot")
    top = counted.where(F.col("level") >= least).groupBy(slot).agg(F.max("level").alias("level")).toArrow()
    table[top.column("slot").to_numpy()] = top.column("level").to_numpy() - least + 1
    drop_durable(counted)
    return table


# -- signatures ----------------------------------------------------------------

def _signatures(docs: DataFrame, width: int, percent: int, levels: np.ndarray) -> DataFrame:
    """doc_id, node, n, head (prefix in order 1), sketch (parities per hash class), second and third (prefixes in orders 2 and 3, 32 bits a token)."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in pieces(batches, "text", 2 << 20):
            nodes, n, heads, sketches, second, third = [], [], [], [], [], []
            for s in sets(batch.column("text"), width):
                k = prefix_length(len(s), percent) if len(s) else 0
                level = table[_slots(s)]
                order = np.argsort(level, kind="stable")[:k]
                other = np.lexsort((mix(s, 5), level))[:k]
                nodes.append(node_of(s))
                n.append(len(s))
                heads.append(s[order])
                sketches.append(sketch(s).tobytes())
                second.append(np.sort(s[other].astype(np.uint32)).tobytes())
                third.append(np.sort(s[len(s) - k :].astype(np.uint32)).tobytes())
            flat = np.concatenate(heads).view(np.int64)
            columns = [batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(n, pa.int64()), lists(flat, np.array([len(h) for h in heads], np.int64), pa.int64())]
            columns += [pa.array(x, pa.binary()) for x in (sketches, second, third)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "n", "head", "sketch", "second", "third"])

    return docs.mapInArrow(work, "doc_id long, node long, n long, head array<long>, sketch binary, second binary, third binary")


def _full_sets(docs: DataFrame, width: int) -> DataFrame:
    """node, tokens (sorted uint64)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            each = list(sets(batch.column("text"), width))
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in each], pa.int64()), pa.array([s.tobytes() for s in each], pa.binary())], names=["node", "tokens"])

    return docs.select("text").mapInArrow(work, "node long, tokens binary").dropDuplicates(["node"])


# -- filters -------------------------------------------------------------------


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the tokens per hash class, in 64-bit words; halves of a longer sketch make a shorter one by exclusive or."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(2 * len(s)).bit_length()))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _folded(x: np.ndarray, words: int) -> np.ndarray:
    while x.shape[-1] > words:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def _most_common(x: np.ndarray, y: np.ndarray, n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray:
    """Upper bound of the overlap of sets of n and m tokens with sketches of one length."""
    return (n + m - np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)) // 2


class _Sketches:
    """Sketches of many sets, one array for each length."""

    def __init__(self, column: pa.Array) -> None:
        each = [np.frombuffer(x.as_buffer(), np.uint64) for x in column]
        self.words = np.array([len(x) for x in each])
        self.row = np.zeros(len(each), np.int64)
        self.of: dict[int, np.ndarray] = {}
        for w in np.unique(self.words).tolist():
            at = np.flatnonzero(self.words == w)
            self.row[at] = np.arange(len(at))
            self.of[w] = np.stack([each[i] for i in at.tolist()])

    def most_common(self, i: int, to: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.zeros(len(to), np.int64)
        own = self.of[w := int(self.words[i])][self.row[i]]
        there = self.words[to]
        for v in np.unique(there).tolist():
            at = np.flatnonzero(there == v)
            least = min(v, w)
            out[at] = _most_common(_folded(self.of[v][self.row[to[at]]], least), _folded(own, least), n[to[at]], n[i])
        return out


def _may_link(n: np.ndarray, m: np.ndarray, overlap: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m with at most this overlap can reach the threshold."""
    o = np.minimum(overlap, np.minimum(n, m))
    return 100 * o >= percent * (n + m - o)


def _meet(x: pa.Scalar, y: pa.Scalar) -> bool:
    p, q = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
    if len(p) > len(q):
        p, q = q, p
    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
    return bool((q[at] == p).any())


def _filtered(pairs: DataFrame, narrow: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes whose sketches let them link and whose prefixes meet in orders 2 and 3."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(c).to_numpy() for c in ("an", "bn"))
            side = {c: batch.column(c) for c in ("asketch", "bsketch", "asecond", "bsecond", "athird", "bthird")}
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(side[c][i].as_buffer(), np.uint64) for c in ("asketch", "bsketch"))
                least = min(len(x), len(y))
                may = _may_link(n[i], m[i], _most_common(_folded(x, least), _folded(y, least), n[i], m[i]), percent)
                keep.append(bool(may) and _meet(side["asecond"][i], side["bsecond"][i]) and _meet(side["athird"][i], side["bthird"][i]))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (narrow.select(*(F.col(c).alias(k if c == "node" else k + c) for c in ("node", "n", "sketch", "second", "third"))) for k in "ab")
    return pairs.join(right, "b").join(left, "a").mapInArrow(work, "a long, b long")


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    """Links among pairs (a, b, ta, tb) of token sets, as (a, b)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ta"), batch.column("tb"), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (s, t) if len(s) <= len(t) else (t, s)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                o = int((large[at] == small).sum())
                keep.append(100 * o >= percent * (len(s) + len(t) - o))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(work, "a long, b long")


def _links(pairs: DataFrame, docs: DataFrame, narrow: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that link; texts are read again only of nodes in pairs that pass all filters."""
    pairs = durable(_filtered(pairs, narrow, percent), "ngram-passing")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = durable(narrow.join(nodes, "node", "left_semi").select("doc_id"), "ngram-wanted")
    may, _ = apart(docs, F.col("doc_id"), wanted)
    full = durable(_full_sets(may.join(wanted, "doc_id", "left_semi"), width), "ngram-sets")
    left, right = (full.select(F.col("node").alias(k), F.col("tokens").alias(f"t{k}")) for k in ("a", "b"))
    links = durable(_verified(pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb"), percent), "ngram-links")
    for table in (pairs, wanted, full):
        drop_durable(table)
    return links


def _block_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a token (h) and may link, from entries (h, node, n, component, sketch)."""
    sizes = entries.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = entries.join(sizes, "h").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grouped = placed.groupBy("h", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")).agg(
        F.collect_list(F.struct("node", "n", "component", (F.col("own") > F.col("other")).alias("second"), "sketch")).alias("x")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros((0, 2), np.int64)]
            column = batch.column("x")
            starts, fields = column.offsets.to_numpy(), column.values
            nodes, n, comp, second = (fields.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            sketches = _Sketches(fields.field(4))
            same = (batch.column("p").to_numpy() == batch.column("q").to_numpy()).tolist()
            for a, b, one in zip(starts.tolist(), starts[1:].tolist(), same, strict=False):
                rows = np.arange(a, b)
                rows = rows[np.argsort(n[a:b], kind="stable")]  # those of sizes that may link follow each other
                mine, theirs = (rows, rows) if one else (rows[~second[rows]], rows[second[rows]])
                sizes = n[theirs]
                low = np.searchsorted(sizes, n[mine] * percent / 100.0 - 1e-6)
                high = np.searchsorted(sizes, n[mine] * 100.0 / percent + 1e-6, "right")
                for k, i in enumerate(mine.tolist()):
                    to = theirs[k + 1 : high[k]] if one else theirs[low[k] : high[k]]
                    to = to[comp[to] != comp[i]]
                    if len(to):
                        to = to[_may_link(n[to], n[i], sketches.most_common(i, to, n), percent)]
                        found.append(np.column_stack([np.full(len(to), nodes[i]), nodes[to]]))
            ab = np.concatenate(found)
            ab = np.unique(np.column_stack([ab.min(axis=1), ab.max(axis=1)]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

    return grouped.select("p", "q", "x").mapInArrow(work, "a long, b long").distinct()


def join_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs`` (doc_id, text); ``percent`` of 60 to 100."""
    if not 60 <= percent <= 100:
        raise ValueError("percent has to be from 60 to 100")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = durable(_signatures(docs, width, percent, _levels(docs, width)), "ngram-signatures")
    # One row for each distinct set, with the least document that has it.
    real = signed.where("n > 0 AND doc_id IS NOT NULL")
    first = real.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    chosen = real.join(first, ["node", "doc_id"], "left_semi")

    # Order 1: the tokens that several sets have in their prefixes.
    # Dealt by token once, for all three steps; otherwise each shuffles all tokens its own way.
    tokens = chosen.select("node", "n", F.explode("head").alias("h")).repartition("h").distinct()
    shared = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    met = durable(tokens.join(shared, "h"), "ngram-entries")
    narrow = durable(chosen.select("node", "doc_id", "n", "sketch", "second", "third").join(met.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "ngram-narrow")
    member = durable(signed.select("doc_id", "n", "node"), "ngram-members")
    drop_durable(signed)

    # The pivot has the greatest share of its set in company.
    central = met.groupBy("node").agg((F.sum("k") / F.max("n")).alias("c"))
    placed = met.join(central, "node")
    top = F.max(F.struct("c", (-F.col("node")).alias("d"), F.col("n").alias("n")))
    pivots = placed.groupBy("h").agg(top.alias("top")).select("h", (-F.col("top.d")).alias("b"), F.col("top.n").alias("bn"))
    pairs = met.join(pivots, "h").where("node <> b").where(F.least("n", "bn") * 100 >= F.greatest("n", "bn") * percent)
    links = _links(pairs.select(F.col("node").alias("a"), "b").distinct(), docs, narrow, width, percent)
    labels = durable(components(links), "ngram-labels")

    rest = met.select("h", "node", "n").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = rest.groupBy("h").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("h")
    open_entries = rest.join(split, "h", "left_semi").join(narrow.select("node", "sketch"), "node")
    more = _links(_block_pairs(open_entries, percent), docs, narrow, width, percent)
    labels2 = durable(components(links.union(more)), "ngram-labels")
    for table in (met, narrow, labels, links, more):
        drop_durable(table)

    # A component is named by the least document in it.
    named = member.where("n > 0 AND doc_id IS NOT NULL").join(labels2, "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    lone = member.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("own_id"))
    names = lone.join(labels2.join(named, "component").select("node", "component_id"), "node", "left").select("node", F.coalesce("component_id", "own_id").alias("component_id"))
    out = member.join(names, "node", "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes and components of all documents: 4-word shingles, similarity of 0.85 or more."""
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=85)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 4 THEN hash(ws[i], ws[i + 1], ws[i + 2], ws[i + 3]) ELSE hash(ws) END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(doc_id, other) AS (SELECT a, b FROM e UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON reach.other = e.a),
c AS (SELECT doc_id, least(doc_id, min(other)) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""
