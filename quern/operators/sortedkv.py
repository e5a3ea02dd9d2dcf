"""Sorted tables of (key, value): build, seek, scan, merge; sorting and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_sorted(df: DataFrame, path: str, key: str = "key", files: int | None = None) -> None:
    """Parquet in key order within and across files, so statistics prune a seek."""
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, key).sortWithinPartitions(key).write.parquet(path)


def seek(df: DataFrame, start: Column, key: str = "key") -> DataFrame:
    """Entries from the first key that isn't less than ``start``, ascending."""
    return df.where(F.col(key) >= start).orderBy(key)


def get(df: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Entries of the given keys."""
    return df.join(keys.select(key), key, "left_semi")


def merge(parts: list[DataFrame], key: str = "key", start: Column | None = None) -> DataFrame:
    """All entries of several tables in key order; equal keys all stay, by the number of their table (``part``)."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return (out if start is None else out.where(F.col(key) >= start)).orderBy(key, "part")


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """All rows of several tables, with the number of their table (``part``)."""
    out = parts[0].withColumn("part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("part", F.lit(i)))
    return out


def total_sort(df: DataFrame, *order: Column) -> DataFrame:
    """Range-partitioned global sort; give a tiebreak, since equal keys come in any order."""
    return df.orderBy(*order)


def item_locations(df: DataFrame, per_block: int, order: list[str], keys: list[str]) -> DataFrame:
    """``df`` with (block, item) of each row in ``order`` within ``keys``."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("_at", at).withColumn("block", F.floor(F.col("_at") / per_block)).withColumn("item", (F.col("_at") % per_block).cast("int")).drop("_at")


# A record file's chunk, and what its header leaves for payload.
CHUNK_BYTES, CHUNK_PAYLOAD = 32 << 10, (32 << 10) - 28
VARINT_BYTES = 10


def packed_size_bound(n_items: Column, n_bytes: Column, record_size: int) -> Column:
    """Upper bound of the bytes of a record file with ``n_items`` of ``n_bytes`` together, cut into records of ``record_size`` bytes.

    Works on columns, so ``count(*)`` and ``sum(length)`` of any grouping do.
    """
    chunks = -(-record_size // CHUNK_PAYLOAD)
    payload = (n_items + 1) * VARINT_BYTES + n_bytes
    return ((F.ceil(payload / record_size) * chunks + 2) * CHUNK_BYTES).cast("long")
