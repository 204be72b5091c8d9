"""Connected components of a link table by alternating large-star and small-star steps.

Links never leave the executors; the driver sees two numbers a round (the row count and a checksum of the links),
and each round is written to the shared folder, so lineage stays one round long. Stars use per-node minima
(pre-aggregated before their shuffle) and joins on the node, which adaptive execution splits where a node holds
very many links; no node's neighbours are gathered in a list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame, ws: Workspace, name: str = "cc") -> DataFrame:
    """(node, component) for each node of links (a, b): the smallest node it can reach. Other nodes are absent.

    Rounds grow with the logarithm of the longest chain. Self links and repeated links are harmless; nulls are
    dropped; an empty table gives no rows.
    """
    now = ws.save(
        links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        f"{name}-0",
    )
    state, k = _state(now), 0
    while state[0]:
        k += 1
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: link every larger neighbour to the smallest node of the neighbourhood
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each node and its smaller neighbours, to the smallest of them (links point down: a > b)
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = ws.save(small.union(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), f"{name}-{k}")
        ws.drop(f"{name}-{k - 1}")
        now, before = after, state
        state = _state(now)
        if state == before:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
