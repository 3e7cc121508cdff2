"""Connected components of an undirected graph given as links (a, b) between long ids.

Rounds of two steps run until no link changes: *large star* hangs every larger neighbour of a node
on the smallest node around, *small star* does the same for the smaller neighbours. Each round is a
pair of shuffles; the number of rounds grows with the logarithm of the longest chain. Links are
stored in the shared checkpoint folder after every round, and nothing is gathered on the driver
but two sums. The minimum of a node is aggregated before the shuffle, and its neighbours are
joined back with a shuffle that adaptive execution may split, so a node with very many neighbours
does not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step. ``links`` are (u, v) with u > v, without repeats."""
    if large:
        around = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = links
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m") if large else F.col("m"))
    side = around.filter(F.col("v") > F.col("u")) if large else around
    moved = side.join(least, "u").select("v", "m")
    if not large:
        moved = moved.unionByName(least.select(F.col("u").alias("v"), "m"))
    return moved.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in a link with another id; ``root`` is the smallest id reachable."""
    a, b = links.columns
    edges = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = stored(edges, "links")
    mark = _mark(edges)
    while mark[0]:
        nxt = stored(_star(_star(edges, True), False), "links")
        seen, mark, edges = mark, _mark(nxt), nxt
        if seen == mark:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
