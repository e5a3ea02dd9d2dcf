"""A training-text pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir), works on all rows it gets and returns a
DataFrame; ``run`` writes it as Parquet to the session's shared folder and reads
it again for the next stage.

Defined cases, beyond those of the operators: null texts stay until the last stage,
which gives them no ids; null ids are never near copies and stay; rows of one id
are judged each by its own text; an empty table runs through as one; further
columns, of any name, pass all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, decontaminate, line_dedup, ngram_join, quality_classifier
from quern.llm.apart import apart
from quern.llm.durable import durable


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling; the others go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.fit(docs, labels)
    scored = quality_classifier.score(docs, model)
    cut = quality_classifier.threshold(durable(scored.select("doc_id", "log_weight"), "quality-scores"), least=model.least)
    return scored.where(quality_classifier.drawn(scored, cut)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has in an aligned block are cut from the later one."""
    return line_dedup.dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id.

    Rows with a null id, or one that isn't a number, belong to no group and stay; rows of one id stay together.
    """
    own = F.col("doc_id").cast("long")
    groups = ngram_join.join_components(docs.where(own.isNotNull()), width=5, percent=80)
    # Rows, not ids, are in groups: an id stays where any of its rows leads a group.
    led = groups.groupBy(F.col("doc_id").alias("_gone")).agg(F.max(F.expr("doc_id = component_id")).alias("led"))
    gone = durable(led.where("NOT led").select("_gone"), "near-gone")
    may, rest = apart(docs, own, gone)
    return may.join(gone, own == gone["_gone"], "left_anti").union(rest)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item leaks into."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.with_leaks(docs, items).where(F.size("leaks") == 0).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, the ids of the whole text, and the digest of what they decode to."""
    ids = bpe.encode(docs, decoded="decoded")
    counted = ids.withColumn("n_tokens", F.size("ids").cast("long")).withColumn("decoded_sha256", F.sha2("decoded", 256))
    return counted.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "decoded_sha256")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark),
    ("byte-level BPE", tokens),
]

#: No SQL can express the stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
