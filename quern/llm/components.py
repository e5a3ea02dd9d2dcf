"""Connected components of links between long ids, as DataFrame rounds.

Alternating star contraction: a large-star round hooks every greater neighbour
of a node to the least id around it, a small-star round hooks the node and its
lesser neighbours; both keep the components and end in stars around each
component's least id.  A round is two aggregations of minima (partial before the
shuffle, so a hub with a third of all links sends one row a task) and a join
that Spark may split; no neighbour list is ever gathered.  Each round's links
are written to the shared folder, so a lost executor repeats one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import drop_durable, durable


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have u < v; each v sees its lesser neighbours."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    hooked = edges.join(least, "v").where("u > m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return hooked.union(least.select(F.col("m").alias("u"), "v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, component (its least reachable id, itself included) of every node that has a link.

    Links of a node to itself, null ends and repeated links don't matter.
    """
    edges = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct()
    edges = durable(edges, "links")
    before = _state(edges)
    for _ in range(most_rounds):
        after = durable(_small_star(_large_star(edges)), "links")
        drop_durable(edges)
        edges, now = after, _state(after)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components didn't settle")
    stars = edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return stars.union(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
