"""Personal data by fixed forms and by bootstrapped context.

Base entities are found by their form (see ``base_spans``).  They seed the
method: the one and two words before and after a mention are lexical patterns.  A
pattern is trusted for a kind as far as its occurrences in the whole corpus are
beside entities of that kind; an unseen identifier (a number, address or mailbox
in another form) is trusted by the patterns it stands beside (noisy or);
identifiers in turn lend their trust to all patterns beside which they are
mentioned, so what one round finds induces patterns in the next.  Spark runs
``ROUNDS`` such rounds over the pattern-instance graph, and mentions beside
patterns that reach ``TRUST`` are added.  Frequent words never become patterns:
their occurrences are counted in all texts, not only beside identifiers.

Edges of the graph are distinct pairs with their number of mentions, aggregated
before each shuffle; an edge is 5 numbers whatever the text's length.  What is broadcast is a bitmap of fixed
size over pattern hashes, which only thins the counting pass.

Defined cases: a null or empty text has no spans; texts of any length count
whole; repeated rows each give a row; spans are found for each row's own text,
whatever its id, so rows with equal ids and other texts, and null ids, have their
own; a pattern or mention just at ``TRUST`` counts; where a mention may be of two
kinds the first listed is taken; copies of a text are one edge, whose mentions count as often as the pattern's
occurrences do; an empty table gives an empty one; other
columns aren't read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import drop_durable, durable
from .textkernels import MIX_1, column_bytes, mix, pieces, runs

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 4
#: Distinct trusted identifiers a pattern needs; trust from which a pattern extracts and a mention is added.
SUPPORT, TRUST = 3, 0.5
BITS = 20

# Starts are looked for where a run of first characters begins; quantifiers are
# possessive where giving back can't help.  Both keep long runs linear.
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = re.compile(rf"(?<!{_LOCAL[:-1]}]){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
EMAIL_HERE = re.compile(rf"{_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Identifiers in other forms, with the kinds they may be.
OTHER_MAIL = re.compile(rf"(?<!{_LOCAL[:-1]}]){_LOCAL}++(?:@|\(at\)|\[at\])[A-Za-z0-9.-]*[A-Za-z0-9]")
OTHER_NUMBER = re.compile(r"(?<![0-9])\(?[0-9]++(?:[\x20().\-/]{1,2}[0-9]++)*+")
OTHER_ADDRESS = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]++(?::[0-9A-Fa-f]*+){3,7}")
_WORD = re.compile(r"[^\x20\x09-\x0d]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if k % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while m := EMAIL.search(text, at):
        while m:  # what follows a match at once may begin another within the same run
            yield m.span()
            at = m.end()
            m = EMAIL_HERE.match(text, at)


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; leftmost matches that don't overlap within a kind, of which those that fail the kind's check are dropped."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def other_mentions(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
    """(mask of possible kinds, start, end) of identifiers in other forms that no taken span overlaps."""
    found = []
    if "@" in text or "at)" in text or "at]" in text:
        found += [(1, *m.span()) for m in OTHER_MAIL.finditer(text)]
    if ":" in text:
        found += [(2, *m.span()) for m in OTHER_ADDRESS.finditer(text)]
    for m in OTHER_NUMBER.finditer(text):
        n = len(_digits(m[0]))
        if n >= 7 and (kinds := 4 * (12 <= n <= 19) + 8 * (n <= 15)):
            found.append((kinds, *m.span()))
    spans = sorted((a, b) for _, a, b in taken)
    out, k, reach = [], 0, 0
    for kinds, a, b in sorted(found, key=lambda x: x[1]):
        while k < len(spans) and spans[k][0] < b:
            reach = max(reach, spans[k][1])
            k += 1
        if a >= reach:
            out.append((kinds, a, b))
            reach = b
    return out


def _hash_words(words: list[str]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return runs(data, np.array([0, len(data)]), lower=True)[2]


def _one(h: np.ndarray, salt: int = 21) -> np.ndarray:
    return mix(h, salt)


def _two(before: np.ndarray, last: np.ndarray, salt: int = 22) -> np.ndarray:
    return mix(before * np.uint64(MIX_1) + last, salt)


#: Salts of one and two words after a mention.
AFTER_ONE, AFTER_TWO = 23, 24


def beside(text: str, spans: list[tuple[int, int]]) -> list[tuple[list[str], list[str]]]:
    """For each span, up to two words before and up to two after it; a word that the span cuts counts as far as it lies outside."""
    found = [m.span() for m in _WORD.finditer(text)] if spans else []
    starts, ends = [a for a, _ in found], [b for _, b in found]
    out = []
    for a, b in spans:
        k = bisect_left(starts, a) - 1
        left = [text[starts[i] : min(ends[i], a)] for i in range(max(0, k - 1), k + 1)]
        k = bisect_right(ends, b)
        right = [text[max(starts[i], b) : ends[i]] for i in range(k, min(len(found), k + 2))]
        out.append((left, right))
    return out


_KEY = "struct<id:long,none:boolean,hash:long>"
_MENTION = pa.struct([("kinds", pa.int32()), ("seed", pa.bool_()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))])
_MENTIONS = "array<struct<kinds:int,seed:boolean,start:int,end:int,instance:long,patterns:array<long>>>"


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the row's id and text), mentions: base entities (seeds) and other identifiers with the hashes of the words beside them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            rows, words, at = [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                every = [(1 << KINDS.index(k), True, a, b) for k, a, b in base] + [(k, False, a, b) for k, a, b in other_mentions(text, base)]
                row = []
                for (kinds, seed, a, b), (left, right) in zip(every, beside(text, [(a, b) for _, _, a, b in every]), strict=True):
                    at.append((len(left), len(right)))
                    words += left + right
                    row.append({"kinds": kinds, "seed": seed, "start": a, "end": b, "instance": xxhash.xxh64_intdigest(text[a:b].lower()) - (1 << 63)})
                rows.append(row)
            hashed, done = _hash_words(words), 0
            one, two = _one(hashed).view(np.int64), _two(hashed[:-1], hashed[1:]).view(np.int64)
            after, after2 = _one(hashed, AFTER_ONE).view(np.int64), _two(hashed[:-1], hashed[1:], AFTER_TWO).view(np.int64)
            for m, (n, k) in zip((m for row in rows for m in row), at, strict=True):
                mid = done + n
                m["patterns"] = [int(one[mid - 1])] * (n > 0) + [int(two[mid - 2])] * (n > 1) + ([int(after[mid])] if k > 0 else []) + ([int(after2[mid])] if k > 1 else [])
                done = mid + k
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(rows, pa.list_(_MENTION))], names=["doc_id", "key", "mentions"])

    key = F.struct(F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.col("doc_id").isNull().alias("none"), F.xxhash64("text").alias("hash"))
    return docs.select("doc_id", key.alias("key"), "text").mapInArrow(work, f"doc_id long, key {_KEY}, mentions {_MENTIONS}")


def _occurrences(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """pattern, occurrences: how often the words of a pattern occur, for all patterns in the bitmap ``wanted``."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = shared.value
        for batch in pieces(batches, "text", 4 << 20):
            _, _, words, first = runs(*column_bytes(batch.column("text")), lower=True)
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            if len(words):
                follows = doc[1:] == doc[:-1]
                before, last = words[:-1][follows], words[1:][follows]
                words = np.concatenate([_one(words), _two(before, last), _one(words, AFTER_ONE), _two(before, last, AFTER_TWO)])
            both = words
            pattern, n = np.unique(both[flags[(both >> np.uint64(64 - BITS)).astype(np.int64)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pattern.view(np.int64)), pa.array(n.astype(np.int64))], names=["pattern", "n"])

    return docs.select("text").mapInArrow(work, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("occurrences"))


def bootstrap(docs: DataFrame, found: DataFrame) -> DataFrame:
    """key, kind (number), start, end of the mentions that trusted patterns add."""
    each = found.select("key", F.explode("mentions").alias("m")).select("key", "m.*")
    edges = each.select(F.explode("patterns").alias("pattern"), "instance", "kinds", "seed").groupBy("pattern", "instance", "kinds", "seed").agg(F.count(F.lit(1)).alias("n"))
    kind = F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(KINDS) - 1)), lambda k: F.expr("kinds").bitwiseAND(F.call_function("shiftleft", F.lit(1), k)) > 0))
    edges = durable(edges.withColumn("kind", kind).select("pattern", "instance", "kind", "seed", "n"), "pii-edges")
    # Any pattern beside enough distinct identifiers may come to be trusted, by seeds or by what later rounds trust.
    supported = edges.groupBy("pattern", "kind").agg(F.count_distinct("instance").alias("several"), F.sum("n").alias("seen")).where(F.col("several") >= SUPPORT).drop("several")
    supported = durable(supported, "pii-patterns")
    # At most 2^BITS numbers, however many patterns there are.
    slots = [r["slot"] for r in supported.select(F.shiftrightunsigned("pattern", 64 - BITS).alias("slot")).distinct().toLocalIterator()]
    wanted = np.zeros(1 << BITS, bool)
    wanted[slots] = True
    totals = _occurrences(docs, wanted)
    patterns = durable(supported.join(totals, "pattern", "left").select("pattern", "kind", F.greatest(F.coalesce("occurrences", F.lit(0)), "seen").alias("total")), "pii-totals")
    live = durable(edges.join(patterns, ["pattern", "kind"]).groupBy("pattern", "kind", "instance").agg(F.max(F.col("seed").cast("double")).alias("seed"), F.sum("n").alias("n"), F.max("total").alias("total")), "pii-live")
    for table in (edges, supported, patterns):
        drop_durable(table)
    trust = live.groupBy("instance", "kind").agg(F.max("seed").alias("trust"))
    for _ in range(ROUNDS):
        # One more occurrence than seen keeps a pattern short of certainty.
        score = live.join(trust, ["instance", "kind"]).groupBy("pattern", "kind").agg((F.sum(F.col("trust") * F.col("n")) / (F.greatest(F.max("total"), F.sum("n")) + 1)).alias("score"), F.count_if(F.col("trust") >= TRUST).alias("by"))
        score = score.where((F.col("score") >= TRUST / 2) & (F.col("by") >= SUPPORT)).drop("by")
        doubt = live.join(score, ["pattern", "kind"]).groupBy("instance", "kind").agg(F.max("seed").alias("seed"), F.sum(F.log(1 - F.least("score", F.lit(0.999)))).alias("doubt"))
        fresh = live.select("instance", "kind", "seed").groupBy("instance", "kind").agg(F.max("seed").alias("seed")).join(doubt.drop("seed"), ["instance", "kind"], "left")
        trust = durable(fresh.select("instance", "kind", F.greatest("seed", 1 - F.exp(F.coalesce("doubt", F.lit(0.0)))).alias("trust")), "pii-trust")
    good = score.where(F.col("score") >= TRUST).select("pattern", "kind")
    new = each.where(~F.col("seed")).withColumn("kind", kind).withColumn("pattern", F.explode("patterns"))
    return new.join(good, ["pattern", "kind"], "left_semi").groupBy("key", "start", "end").agg(F.min("kind").alias("kind"))


def _joined(spans: str) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, base and added spans (arrays of (kind number, start, end)) of each row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = durable(mentions(docs), "pii-mentions")
    span = lambda k, a, b: F.struct(k.cast("int").alias("kind"), a.alias("start"), b.alias("end"))
    added = bootstrap(docs, found).groupBy("key").agg(F.collect_set(span(F.col("kind"), F.col("start"), F.col("end"))).alias("added"))
    seeds = F.filter("mentions", lambda m: m["seed"])
    base = F.transform(seeds, lambda m: span(F.round(F.log2(m["kinds"])), m["start"], m["end"]))
    nothing = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return found.select("doc_id", "key", F.array_sort(base).alias("base")).join(added, "key", "left").drop("key").withColumn("added", F.coalesce("added", nothing))


def _of_kind(k: int):
    return lambda s: s["kind"] == k


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of base entities, and all spans, of every document."""
    spans = extract(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    every = spans.withColumn("every", F.array_sort(F.concat("base", "added")))
    return every.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("every").alias("spans"))
