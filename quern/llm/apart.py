"""Rows that a join by key may concern, told from the others by a broadcast of bounded size.

A join of whole texts with a list of keys shuffles all texts as soon as the list
is too long to broadcast.  The slots of the keys' hashes are at most ``SLOTS``
ints, whatever the corpus, and are broadcast always; texts in other slots surely
have none of the keys and stay where they are.  The exact join follows on the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 20


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")


def apart(rows: DataFrame, key: Column, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``key`` may be in the one column of ``wanted``, rows whose key surely isn't)."""
    slots = F.broadcast(wanted.select(_slot(F.col(wanted.columns[0])).alias("_slot")).distinct())
    may, rest = (rows.join(slots, _slot(key) == slots["_slot"], how) for how in ("left_semi", "left_anti"))
    return may, rest
