"""Top-n, keep-first / keep-last and seeded samples.

All use ``row_number() <= n``: Catalyst turns it into a window group limit that
keeps only n rows per key on the map side, so a hot key is cut before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, rank_col: str | None = None) -> DataFrame:
    """First ``n`` rows per key; ``order`` must be total for a stable answer."""
    name = rank_col or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)
    return out if rank_col else out.drop(name)


def keep_first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return top_n(df, by, order, 1)


def keep_last(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return top_n(df, by, [F.col(c).desc() for c in order], 1)


#: Fixed odd numbers of the sample's order: a multiplicative hash modulo a prime, which SQL can state as well.
STEP, PRIME = 48_271, 2_147_483_647


def sample_order(key: Column, seed: int) -> Column:
    """Pseudo-random order of an integer key: two rounds of a multiplicative congruence."""
    once = F.pmod((F.pmod(key, F.lit(PRIME)) + seed + 1) * STEP, F.lit(PRIME))
    return F.pmod(once * STEP + F.lit(seed), F.lit(PRIME))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, the same for the same integer keys and seed."""
    return df.orderBy(sample_order(F.col(key).cast("bigint"), seed), key).limit(n)


def positions(ordered: DataFrame, name: str = "pos") -> DataFrame:
    """Number the rows of a sorted frame from 1. The sort leaves ranges in partition order; each partition counts on from the
    rows before it, so no task holds more than its range."""
    # checkpointed, so that both uses below see the same ranges
    part = cut_lineage(ordered.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() % (1 << 33)))
    ends = part.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = ends.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return part.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__at") + 1).drop("__part", "__at", "__start")


def custom_order(df: DataFrame, column: str, order: list[str], *then: str) -> DataFrame:
    """Sort by a listed order of values, unlisted last."""
    pos = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
    return df.orderBy(F.when(pos == 0, F.lit(len(order) + 1)).otherwise(pos), *then)


def deepest_first(df: DataFrame, path: str, *then: str) -> DataFrame:
    return df.orderBy(F.size(F.split(path, "/")).desc(), path, *then)
