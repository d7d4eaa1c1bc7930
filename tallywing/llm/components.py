"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MOST_ROUNDS = 60
#: Links from which on a node is a hub, and hubs that are sent to every task at most, largest first.
HUB_LINKS, MOST_HUBS = 256, 10_000


def _least(links: DataFrame) -> DataFrame:
    """u, the smallest v beside it, and how many links it has."""
    return links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _beside_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """u, v and m for every link (u, v), m being that of u in `least`.

    A hub's links would all be dealt to one task: the largest hubs come to the links instead, a
    bounded number of rows, and what is dealt by node has a part of its own for each of their links.
    """
    hubs = least.where(F.col("n") > HUB_LINKS).orderBy(F.desc("n"), "u").limit(MOST_HUBS).select("u", F.col("m").alias("hub_m"))
    met = links.join(F.broadcast(hubs), "u", "left").withColumn("part", F.when(F.col("hub_m").isNull(), 0).otherwise(1 + F.pmod(F.hash("v"), F.lit(1 << 16))))
    return met.join(least.select("u", F.lit(0).alias("part"), "m"), ["u", "part"], "left").select("u", "v", F.coalesce("hub_m", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest one of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"), "n")
    return _beside_least(both.where(F.col("v") > F.col("u")), least).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = _beside_least(down, least).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """id and component_id, the smallest id reachable, of every id that has a link (a, b) to another id.

    Links may repeat, run either way or join an id to itself; those with a null end count for
    nothing. The number of rounds grows with the logarithm of the longest path.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges, before = cut(edges.distinct()), None
    for _ in range(MOST_ROUNDS):
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id"))).distinct()
        before = now
        edges = cut(_small_star(_large_star(edges)).where(F.col("u") != F.col("v")).distinct())
    raise RuntimeError(f"no stable components after {MOST_ROUNDS} rounds")
