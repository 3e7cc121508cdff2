"""Running aggregates that never put one whole key into one task.

A plain window ``partitionBy(key).orderBy(t)`` sends every row of a hot key to a
single task. Here the key is cut into fixed-width time buckets: each bucket is
aggregated with map-side combine, the few bucket totals are carried along, and the
row-level window runs inside one (key, bucket) only. The answer is exact.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Run(NamedTuple):
    """``fn`` is sum, max or min; ``forward`` looks at earlier rows, otherwise at later ones."""
    fn: str
    col: Column
    forward: bool = True
    include_current: bool = True


_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _merge(fn: str, carry: Column, here: Column) -> Column:
    if fn == "sum":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(here, F.lit(0))
    return (F.greatest if fn == "max" else F.least)(carry, here)


def _order(names: list[str], forward: bool) -> list[Column]:
    return [F.col(n).asc() if forward else F.col(n).desc() for n in names]


def running(df: DataFrame, by: list[str], time: str, width: int, runs: dict[str, Run],
            tie_break: list[str] = ()) -> DataFrame:
    """Add running aggregates over ``time`` (BIGINT microseconds) within ``by``; null keys are dropped.

    All ``runs`` share one carry table and one join. Both the join and the windows are
    keyed by (by, bucket), so the rows are exchanged once.
    """
    keys = [*by, "__bucket"]
    tagged = df.withColumn("__bucket", F.col(time) - F.pmod(F.col(time), F.lit(width)))
    totals = tagged.groupBy(*keys).agg(*[_AGG[r.fn](r.col).alias(f"__t_{n}") for n, r in runs.items()])
    before = {fwd: Window.partitionBy(*by).orderBy(*_order(["__bucket"], fwd)).rowsBetween(Window.unboundedPreceding, -1)
              for fwd in (True, False)}
    carry = totals.select(*keys, *[_AGG[r.fn](f"__t_{n}").over(before[r.forward]).alias(f"__c_{n}")
                                   for n, r in runs.items()])
    out = tagged.join(carry, keys)
    for n, r in runs.items():
        inside = (Window.partitionBy(*keys).orderBy(*_order([time, *tie_break], r.forward))
                  .rowsBetween(Window.unboundedPreceding, 0 if r.include_current else -1))
        out = out.withColumn(n, _merge(r.fn, F.col(f"__c_{n}"), _AGG[r.fn](r.col).over(inside)))
    return out.drop("__bucket", *[f"__c_{n}" for n in runs])


def with_neighbours(df: DataFrame, by: list[str], time: str, width: int, prev: str | None = None,
                    next: str | None = None) -> DataFrame:
    """Time of the previous and next row of a key; times must be unique within the key."""
    runs = {}
    if prev:
        runs[prev] = Run("max", F.col(time), True, False)
    if next:
        runs[next] = Run("min", F.col(time), False, False)
    return running(df, by, time, width, runs)
