"""Streams and state: polled feeds, event sinks, ordered release, expiry, snapshot and log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.usage import parse_lines

# Types of state entries.
UPDATE, SNAPSHOT = 1, 2


def stream_feed(spark: SparkSession, root: str, tolerate: bool = False) -> DataFrame:
    """Entries of files as they arrive in a feed folder; each file once.  Start it with ``trigger(processingTime='30 minutes')``."""
    lines = spark.readStream.text(root).select("value", F.col("_metadata.file_name").alias("file_name"))
    return parse_lines(lines, tolerate)


def event_json(event_type: Column, pairs: dict[str, Column]) -> Column:
    """One JSON object with the event's type and pairs, keys sorted."""
    named = {**pairs, "event_type": event_type}
    return F.to_json(F.struct(*(named[k].alias(k) for k in sorted(named))))


def write_events(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append event JSON lines (value) in micro-batches, by default each second."""
    return events.select("value").writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def batches(df: DataFrame, key: str = "id") -> DataFrame:
    """Pending items with equal ids as one."""
    return df.dropDuplicates([key])


def live(df: DataFrame, now: Column, ttl_seconds: int, set_at: str = "set_at") -> DataFrame:
    """Cache entries that haven't expired: the last set of each key, younger than ``ttl_seconds``."""
    last = df.groupBy("key").agg(F.max_by("value", set_at).alias("value"), F.max(set_at).alias(set_at))
    return last.where(F.col(set_at) + F.expr(f"INTERVAL {ttl_seconds} SECONDS") > now)


def released(df: DataFrame, index: str = "index", keys: list[str] | None = None, last: str | None = None) -> DataFrame:
    """Items that an ordered queue lets go: those of each key whose indices have no gap from 0 on.

    Of repeats of an index the one with the greatest ``last`` goes, or all where no column is named.
    """
    if last:
        newest = Window.partitionBy(*(keys or []), index).orderBy(F.desc(last))
        df = df.withColumn("_newest", F.row_number().over(newest)).where("_newest = 1").drop("_newest")
    order = Window.partitionBy(*(keys or [])).orderBy(index)
    return df.withColumn("_at", F.dense_rank().over(order) - 1).where(F.col("_at") == F.col(index)).drop("_at")


def restore(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The last snapshot and the updates after it, from a log (off, typ, epoch, data); all updates where there is no snapshot.

    An update's epoch is the offset of the snapshot it is based on, or 0; another one is an error.
    """
    if not keys:
        return restore(log.withColumn("_log", F.lit(0)), ["_log"]).drop("_log")
    last = log.where(F.col("typ") == SNAPSHOT).groupBy(*keys).agg(F.max("off").alias("_from"))
    joined = log.join(last, keys, "left").withColumn("_from", F.coalesce("_from", F.lit(0)))
    wrong = F.raise_error(F.lit("an update's epoch isn't its snapshot's")).cast("long")
    tail = joined.where(F.col("off") >= F.col("_from"))
    right = (F.col("typ") == SNAPSHOT) | (F.col("epoch") == F.col("_from"))
    return tail.withColumn("epoch", F.when(right, F.col("epoch")).otherwise(wrong)).drop("_from")


def epochs(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The log (off, typ) with the epoch of each entry: the offset of the last snapshot before it, or 0."""
    before = Window.partitionBy(*(keys or [])).orderBy("off").rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("epoch", F.coalesce(F.max(F.when(F.col("typ") == SNAPSHOT, F.col("off"))).over(before), F.lit(0).cast("long")))


def operation_metrics(df: DataFrame, op: str, n_bytes: str, retries: str, millis: str, minutes: float) -> DataFrame:
    """Counts, bytes, histograms of retries and durations, and rates a minute, of each operation.

    Classes exclude each other: ``retries_2`` has those of 2 and 3 retries, ``over_10_ms``
    those over 10 and up to 100 ms, and ``fast`` those of up to 1 ms.
    """
    r, m = F.col(retries), F.col(millis)
    hist = [F.count_if((r >= low) & (r < high)).alias(f"retries_{low}") for low, high in ((1, 2), (2, 4), (4, 8))] + [F.count_if(r >= 8).alias("retries_8")]
    hist += [F.count_if(m <= 1).alias("fast")]
    hist += [F.count_if((m > low) & (m <= 10 * low)).alias(f"over_{low}_ms") for low in (1, 10, 100, 1_000, 10_000)] + [F.count_if(m > 100_000).alias("over_100000_ms")]
    out = df.groupBy(op).agg(F.count(F.lit(1)).alias("n"), F.sum(n_bytes).alias("bytes"), *hist)
    return out.withColumn("per_minute", F.col("n") / minutes).withColumn("bytes_per_minute", F.col("bytes") / minutes)


def time_left(done: Column, running_seconds: Column, queued: Column, workers: Column) -> Column:
    """Estimate in seconds: mean time of what is done, times what is queued for each worker."""
    return F.when(done > 0, running_seconds / done * queued / workers)
