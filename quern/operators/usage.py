"""Usage feeds: parsing, filters, deduplication and time-prorated cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The file name and line formats of a feed.
FILE_NAME = r"^([0-9]{12})\.([0-9]{4}-[0-9]{2}-[0-9]{2}-[0-9]{2})\.([0-9]{3})\.[a-z0-9]{8}(\.gz)?$"
LINE_COLUMNS = ("timestamp", "usage_type", "operation", "instance_id", "my_bid_id", "my_max_price", "market_price", "charge", "version")
DEFAULT_INSTANCE = "m1.small"


def file_meta(name: Column) -> Column:
    """struct<account_id, hour, version, gzip> of a feed file's base name; null for other names."""
    get = lambda i: F.regexp_extract(name, FILE_NAME, i)
    meta = F.struct(get(1).alias("account_id"), F.try_to_timestamp(get(2), F.lit("yyyy-MM-dd-HH")).alias("hour"), get(3).cast("long").alias("version"), (get(4) != "").alias("gzip"))
    return F.when(name.rlike(FILE_NAME), meta)


def instance_of(usage_type: Column) -> Column:
    """The part after the one colon; the default without a colon; null (an error) with more."""
    parts = F.split(usage_type, ":")
    return F.when(F.size(parts) == 1, F.lit(DEFAULT_INSTANCE)).when(F.size(parts) == 2, parts[1])


def price_of(text: Column) -> Column:
    """'6.669 USD' as a double; null (an error) in another form."""
    return F.when(text.endswith(" USD"), F.regexp_replace(text, " USD$", "").try_cast("double"))


def parse_lines(lines: DataFrame, tolerate: bool = False) -> DataFrame:
    """Entries of feed lines (value, file_name): account_id, ts, usage_type, instance, operation, instance_id, my_bid_id, three prices, version.

    Comment lines ('#') don't count.  A line that can't be parsed is an error; with
    ``tolerate`` all lines of its file are left out instead.
    """
    f = F.split("value", "\t")
    meta = file_meta(F.col("file_name"))
    rows = lines.where(~F.col("value").startswith("#")).select(
        "file_name",
        (F.size(f) == len(LINE_COLUMNS)).alias("_nine"),
        meta["account_id"].alias("account_id"),
        F.try_to_timestamp(F.get(f, F.lit(0)), F.lit("yyyy-MM-dd HH:mm:ss z")).alias("ts"),
        F.get(f, F.lit(1)).alias("usage_type"),
        instance_of(F.get(f, F.lit(1))).alias("instance"),
        F.get(f, F.lit(2)).alias("operation"),
        F.get(f, F.lit(3)).alias("instance_id"),
        F.get(f, F.lit(4)).alias("my_bid_id"),
        price_of(F.get(f, F.lit(5))).alias("my_max_price_usd"),
        price_of(F.get(f, F.lit(6))).alias("market_price_usd"),
        price_of(F.get(f, F.lit(7))).alias("charge_usd"),
        F.get(f, F.lit(8)).try_cast("long").alias("version"),
    )
    parsed = ("ts", "instance", "my_max_price_usd", "market_price_usd", "charge_usd", "version", "account_id")
    good = F.col("_nine")
    for c in parsed:
        good &= F.col(c).isNotNull()
    if tolerate:
        bad = rows.where(~good).select("file_name").distinct()
        return rows.join(bad, "file_name", "left_anti").drop("_nine", "file_name")
    checked = F.when(good, F.col("ts")).otherwise(F.raise_error(F.concat(F.lit("bad feed line in "), F.col("file_name"))).cast("timestamp"))
    return rows.withColumn("ts", checked).drop("_nine", "file_name")


def file_filter(account: str | None = None, start: str | None = None, end: str | None = None, version: int | None = None, name: Column | None = None) -> Column:
    """Which files to read, by name: start is widened to its hour.  On ``_metadata.file_name`` Spark prunes files before it opens them."""
    meta = file_meta(F.col("_metadata.file_name") if name is None else name)
    keep = meta.isNotNull()
    if account:
        keep &= meta["account_id"] == account
    if start:
        keep &= meta["hour"] >= F.date_trunc("hour", F.lit(start).cast("timestamp"))
    if end:
        keep &= meta["hour"] < F.lit(end).cast("timestamp")
    if version is not None:
        keep &= meta["version"] == version
    return keep


def entry_filter(account: str | None = None, start: str | None = None, end: str | None = None, version: int | None = None) -> Column:
    """Which entries to keep; start inclusive, end exclusive."""
    keep = F.lit(True)
    if account:
        keep &= F.col("account_id") == account
    if start:
        keep &= F.col("ts") >= F.lit(start).cast("timestamp")
    if end:
        keep &= F.col("ts") < F.lit(end).cast("timestamp")
    if version is not None:
        keep &= F.col("version") == version
    return keep


def glob_for(root: str, account: str | None, start: str | None, end: str | None) -> str:
    """The narrowest glob of names that all wanted files share."""
    shared = ""
    if start and end:
        a, b = start[:13].replace(" ", "-"), end[:13].replace(" ", "-")
        parts = []
        for x, y in zip(a.split("-"), b.split("-"), strict=False):
            if x != y:
                break
            parts.append(x)
        shared = "-".join(parts)
    return f"{root.rstrip('/')}/{account or '*'}.{shared}*"


def read_feed(spark: SparkSession, root: str, account: str | None = None, start: str | None = None, end: str | None = None, version: int | None = None, tolerate: bool = False) -> DataFrame:
    """Entries of a feed folder on any file system Spark reads; gzip by name."""
    lines = spark.read.text(glob_for(root, account, start, end)).where(file_filter(account, start, end, version))
    return parse_lines(lines.select("value", F.col("_metadata.file_name").alias("file_name")), tolerate).where(entry_filter(account, start, end, version))


def dedup(entries: DataFrame, instance: str = "instance_id", ts: str = "ts", charge: str = "charge_usd") -> DataFrame:
    """One entry for each instance and time, with the greatest charge."""
    return entries.groupBy(instance, ts).agg(F.max(charge).alias(charge))


def by_instance(entries: DataFrame, instance: str = "instance_id") -> DataFrame:
    return entries.groupBy(instance).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("charge_usd").alias("charge_usd"))


def intervals(entries: DataFrame, instance: str = "instance_id") -> DataFrame:
    """Deduplicated entries (ts in microseconds) with the next, first and last time of their instance."""
    own = Window.partitionBy(instance)
    d = dedup(entries, instance)
    return d.select(instance, "ts", "charge_usd", F.lead("ts").over(own.orderBy("ts")).alias("next_ts"), F.min("ts").over(own).alias("first_ts"), F.max("ts").over(own).alias("last_ts"))


def cost(entries: DataFrame, requests: DataFrame, instance: str = "instance_id") -> DataFrame:
    """request_id, cost_start, cost_end, charge of requests (request_id, instance, start, end, terminated); times in microseconds.

    Each entry's charge is spread evenly until the instance's next entry; the last
    one is charged whole, or up to the time the instance was terminated.  Requests
    without data (unknown instance, start at or after its last entry, end before
    its first) have no row.  Bounds count in whole seconds.
    """
    second = lambda c: F.col(c) - F.pmod(F.col(c), F.lit(1_000_000))
    rq = requests.select("request_id", instance, second("start").alias("s"), second("end").alias("e"), F.col("terminated").alias("term"))
    joined = rq.join(intervals(entries, instance), instance).where("s < last_ts AND e >= first_ts")
    s, e, ts, nxt, term, charge = (F.col(c) for c in ("s", "e", "ts", "next_ts", "term", "charge_usd"))
    part = (
        F.when(nxt.isNotNull(), charge * F.greatest(F.least(nxt, e) - F.greatest(ts, s), F.lit(0)) / (nxt - ts).cast("double"))
        .when(e < ts, F.lit(0.0))
        .when(term.isNull() | (e >= term), charge)
        .otherwise(charge * (e - ts) / (term - ts).cast("double"))
    )
    grouped = joined.groupBy("request_id", "s", "e", "term").agg(F.min("first_ts").alias("f"), F.min("last_ts").alias("l"), F.sum(part).alias("charge"))
    end = F.when((e >= F.col("l")) & term.isNotNull() & (e >= term), term).otherwise(e)
    return grouped.select("request_id", F.greatest(s, F.col("f")).alias("cost_start"), end.alias("cost_end"), "charge")
