"""Quality classification by importance resampling.

Two generative models of hashed word n-grams - of a target (labelled good
documents) and of the raw corpus (all documents), both with Laplace smoothing -
give each document an importance weight, the ratio of its probabilities; ``k``
documents are then drawn without replacement in proportion to their weights by
Gumbel top-k: the k largest of ``log weight + Gumbel noise``, the noise being a
hash of the id.

N-grams are single words and pairs of words, every occurrence counted.  The log
ratio is taken as the mean of the single words' plus ``PAIRS`` times the mean of
the pairs', for a document of ``LENGTH`` words, so that a long text is no more or
less probable for its length.  No n-gram is left out.

Raw counts cover every document: each task sends its bucket sums, so the shuffle
is bounded by tasks times buckets, and the model that is broadcast has a fixed
number of buckets.  ``k`` is, unless given, the number of documents whose weight
is one that ``RECALL`` of the target documents held back from the fit reach.  The
k-th key is found by counting keys in bins, narrowing to the bin that holds it,
never by a global sort.

The fit reads at most ``most_labelled`` labelled documents (a documented bound;
those with the least hash of their id, a quarter held back), everything else all
documents.

Defined cases: a null or empty text has no n-grams and log weight 0; texts of any
length count whole; null labels don't count; a label whose document is missing
neither; bad labels aren't needed; repeated rows are drawn on the same key, equal
keys by id; without any labelled target document every log weight is 0 and all
are drawn; null ids get noise like the id 0; an empty table gives an empty one;
other columns pass through, but for ``log_weight`` and ``kept``, which are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .durable import drop_durable, durable
from .textkernels import MIX_1, column_bytes, mix, pieces, runs

#: Buckets of single words and of pairs.
WORDS, PAIR_BUCKETS = 1 << 18, 1 << 14
BUCKETS = WORDS + PAIR_BUCKETS
PAIRS, LENGTH, RECALL = 0.3, 256, 0.97
#: Keys are compared as integers in steps of one part in so many.
STEPS = 1 << 20
BINS = 1024

class Model(NamedTuple):
    """The log ratio of every bucket, and the least log weight of a document that counts towards k."""

    ratio: np.ndarray
    least: float


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket) of every single word, then (document, bucket) of every pair of words."""
    _, _, words, first = runs(*column_bytes(column), lower=True)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = np.flatnonzero(doc[1:] == doc[:-1])
    one = (mix(words, 11) % np.uint64(WORDS)).astype(np.int64)
    two = (mix(words[inside] * np.uint64(MIX_1) + words[inside + 1], 13) % np.uint64(PAIR_BUCKETS)).astype(np.int64)
    return doc, one, doc[inside], WORDS + two


def weights(column: pa.Array, ratio: np.ndarray) -> np.ndarray:
    """The log importance weight of each text."""
    doc, one, doc2, two = features(column)
    total = np.zeros(len(column))
    for d, bucket, share in ((doc, one, 1.0), (doc2, two, PAIRS)):
        n = np.bincount(d, minlength=len(column))
        total += LENGTH * share * np.bincount(d, weights=ratio[bucket], minlength=len(column)) / np.maximum(n, 1)
    return np.round(total, 9)


def _bucket_counts(docs: DataFrame, text: str) -> DataFrame:
    """bucket, n: how often each bucket occurs; one sum for each task before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in pieces(batches, text, 1 << 20):
            _, one, _, two = features(batch.column(text))
            total += np.bincount(one, minlength=BUCKETS) + np.bincount(two, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return docs.select(text).mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 30_000, text: str = "text") -> Model:
    """The model of the target (labels with quality 1 and toxic 0) against all of ``docs``."""
    labelled = labels.where("quality IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    # The bound: labels are thinned by a hash of their id, in proportion to their number.
    n = labelled.count()
    if n > most_labelled:
        labelled = labelled.where(F.pmod(F.xxhash64(F.lit("label"), "doc_id"), F.lit(1 << 20)) < int((1 << 20) * most_labelled / n))
    back = F.pmod(F.xxhash64(F.lit("held back"), "doc_id"), F.lit(4)) == 0
    # About ``most_labelled`` rows of two numbers at most.
    target = F.broadcast(labelled.where("good").select("doc_id", back.alias("back")))
    sample = durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).join(target, "doc_id").select("back", "text"), "quality-labelled")
    good = _bucket_counts(sample.where("NOT back"), "text").withColumnRenamed("n", "good")
    # Two counts for each of a fixed number of buckets; this size doesn't grow with the corpus.
    counts = good.join(_bucket_counts(docs, text), "bucket", "full").fillna(0).toArrow()
    target_n, raw_n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = counts.column("bucket").to_numpy()
    target_n[at], raw_n[at] = counts.column("good").to_numpy(), counts.column("n").to_numpy()
    ratio = log_ratio(target_n, raw_n)
    least = float("-inf")
    if ratio.any():
        held = score(sample.where("back").select("text"), Model(ratio, least)).agg(F.percentile_approx("log_weight", 1 - RECALL, 10_000).alias("p")).first()["p"]
        least = least if held is None else held
    drop_durable(sample)
    return Model(ratio, least)


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of the ratio of two Laplace-smoothed models of each kind of n-gram; all 0 where there is no target."""
    ratio = np.zeros(BUCKETS)
    for part in (slice(0, WORDS), slice(WORDS, BUCKETS)):
        t, r = target[part], raw[part]
        if t.sum():
            ratio[part] = np.log((t + 1) / (t.sum() + len(t))) - np.log((r + 1) / (r.sum() + len(r)))
    return ratio


def score(docs: DataFrame, model: Model, text: str = "text", log_weight: str = "log_weight") -> DataFrame:
    """``docs`` and the log importance weight of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model.ratio)
    out = [c for c in docs.columns if c != log_weight]
    schema = T.StructType([*(docs.schema[c] for c in out), T.StructField(log_weight, T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, 1 << 20):
            made = weights(batch.column(text), shared.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), pa.array(made)], names=[*out, log_weight])

    return docs.mapInArrow(work, schema)


def gumbel_key(log_weight: Column, id_column: Column, seed: int = 7) -> Column:
    """The draw's key as a long: (log weight + Gumbel noise), in steps."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.coalesce(id_column, F.lit(0))), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return F.floor((log_weight - F.log(-F.log(uniform))) * STEPS).cast("long")


def _kth_key(keys: DataFrame, k: int) -> tuple[int, int]:
    """(key, rows): the k-th largest of ``key`` and how many rows with just that key are among the first k."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0  # rows over ``high``
    while low < high:
        width = -(-(high - low + 1) // BINS)
        bins = keys.where(F.col("key").between(low, high)).groupBy(F.floor((F.col("key") - low) / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        for bin_, n in sorted(((r["bin"], r["n"]) for r in bins.collect()), reverse=True):  # at most BINS rows
            if above + n >= k:
                low, high = low + bin_ * width, min(high, low + (bin_ + 1) * width - 1)
                break
            above += n
    return low, k - above


def threshold(scored: DataFrame, k: int | None = None, least: float = float("-inf"), id_column: str = "doc_id", seed: int = 7) -> tuple[int, int | None]:
    """The last of the k largest keys and the last id that is drawn with just that key (None: all)."""
    keyed = scored.select(id_column, "log_weight", gumbel_key(F.col("log_weight"), F.col(id_column), seed).alias("key"))
    every, clean = keyed.agg(F.count(F.lit(1)), F.count_if(F.col("log_weight") >= least)).first()
    k = clean if k is None else k
    if k <= 0:
        return 1 << 62, None
    if k >= every:
        return -(1 << 62), None
    key, ties = _kth_key(keyed.select("key"), k)
    last = keyed.where(F.col("key") == key).select(id_column).orderBy(F.col(id_column).asc_nulls_first()).limit(ties).agg(F.max(id_column).alias("i")).first()["i"]
    return key, last


def drawn(scored: DataFrame, cut: tuple[int, int | None], id_column: str = "doc_id", seed: int = 7) -> Column:
    """Whether a row of a scored table is drawn; needs no join, so texts may ride along."""
    key, last = gumbel_key(F.col("log_weight"), F.col(id_column), seed), cut[1]
    tied = F.lit(True) if last is None else F.coalesce(F.col(id_column), F.lit(last)) <= last
    return (key > cut[0]) | ((key == cut[0]) & tied)


def resample(scored: DataFrame, k: int | None = None, least: float = float("-inf"), id_column: str = "doc_id", seed: int = 7) -> DataFrame:
    """``scored`` (with log_weight) and ``kept``: drawn by Gumbel top-k; equal keys by id."""
    return scored.withColumn("kept", drawn(scored, threshold(scored, k, least, id_column, seed), id_column, seed))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log weight and draw of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels)
    scored = durable(score(docs, model).select("doc_id", "log_weight"), "quality-scores")
    return resample(scored, least=model.least)
