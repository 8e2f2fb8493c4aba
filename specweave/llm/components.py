"""Connected components of a large graph of links, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.workspace import Workspace


def components(links: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b); root is the smallest node reachable.

    Every link points from its larger end u to its smaller end v. A round finds
    each u's smallest neighbour, follows that one step further, and moves u's
    links there; rounds go on until nothing changes. Grouping is by the larger
    end, so the hub of a star (its smallest node) never gathers its members;
    joins that meet a hub have shuffled, splittable sides. Rounds are cut by
    written tables. Null ends and links of a node to itself are no links.
    """
    spark = ws.spark
    ends = links.where(F.col("a") != F.col("b"))
    edges = ws.stage(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-edges0")
    seen, turn = _sum(edges), 0
    while seen[0]:
        first = ws.stage(edges.groupBy("u").agg(F.min("v").alias("p")), f"{name}-first{turn}")
        after = first.select(F.col("u").alias("p"), F.col("p").alias("q"))
        jumped = ws.stage(first.join(after, "p", "left").select("u", F.coalesce("q", "p").alias("p")), f"{name}-jumped{turn}")
        moved = edges.join(jumped, "u").where(F.col("v") != F.col("p"))
        moved = moved.select(F.greatest("v", "p").alias("u"), F.least("v", "p").alias("v"))
        following = ws.stage(moved.unionByName(jumped.withColumnRenamed("p", "v")).distinct(), f"{name}-edges{turn + 1}")
        ws.drop(f"{name}-edges{turn}", f"{name}-first{turn}", f"{name}-jumped{turn}")
        edges, turn = following, turn + 1
        now = _sum(edges)
        if now == seen:
            break
        seen = now
    return spark.read.schema(edges.schema).parquet(f"{ws.path}/{name}-edges{turn}").select(F.col("u").alias("node"), F.col("v").alias("root"))


def _sum(edges: DataFrame) -> tuple:
    """Count and two order-free checksums."""
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(h, F.lit(2147483647))), F.bit_xor(h)).first()
    return tuple(row)
