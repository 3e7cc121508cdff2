"""Interval algebra on half-open microsecond ranges ``[lo, hi)``; a null bound is open.

Large tables are matched by equi join on (key, time bucket) with a residual range
test, so hot keys are spread over buckets and AQE may split what is left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefn import DAY, HOUR, SECOND
from ..session import cut_lineage
from .running import Run, running, with_neighbours


@dataclass(frozen=True)
class BoundPolicy:
    """How a begin/end pair is read. ``upper_pad`` (microseconds) extends the end."""
    lower_inclusive: bool = True
    upper_inclusive: bool = False
    upper_pad: int = 0

    def bounds(self, lo_us: Column, hi_us: Column) -> tuple[Column, Column]:
        lo = lo_us if self.lower_inclusive else lo_us + 1
        hi = hi_us + (self.upper_pad + (1 if self.upper_inclusive else 0))
        return lo, hi


# The five readings of a deployment's end date, and the strict stabbing test.
END_OF_DAY = BoundPolicy(upper_pad=DAY)                              # begin <= t < end + 1 day
CLOSED = BoundPolicy(upper_inclusive=True)                           # begin <= t <= end
CLOSED_END_OF_DAY = BoundPolicy(upper_inclusive=True, upper_pad=DAY)  # begin <= t <= end + 1 day
HALF_OPEN = BoundPolicy()                                            # begin <= t < end
STRICT = BoundPolicy(lower_inclusive=False)                          # begin < t < end


def mean_length(intervals: DataFrame, lo: str = "lo", hi: str = "hi") -> int:
    """Mean length of the bounded, non-empty intervals in whole microseconds, at least one second.

    Buckets of this width hold about as many misses as matches, and the intervals touch no more than two each on average.
    """
    size = F.col(hi) - F.col(lo)
    return max(SECOND, int(intervals.where(size > 0).agg(F.avg(size)).first()[0] or HOUR))


def stab_join(points: DataFrame, intervals: DataFrame, by: list[str], point: str,
              lo: str = "lo", hi: str = "hi", width: int | None = HOUR, how: str = "left",
              open_ended: bool = True, span: tuple | None = None) -> DataFrame:
    """Join each point to every interval of its key that holds it.

    Intervals are exploded to the buckets they touch; a point lies in one bucket, so
    no match appears twice. With ``open_ended`` intervals reach no further than one bucket
    beyond their own bounded ends, which bounds the explosion, and points outside that span
    look into its outermost buckets; the range test stays exact. The span is given, or it is
    one aggregate over the intervals; the points are read once. Without a ``width`` the
    buckets are as wide as the intervals are long on average.
    """
    iv = intervals
    width = width or mean_length(intervals, lo, hi)
    a, z = F.col(lo), F.col(hi)
    if open_ended:
        if span:
            known = F.struct(*[(s if isinstance(s, Column) else F.lit(s)).alias(n) for s, n in zip(span, "az")])
        else:
            known = intervals.agg(F.struct(F.min(F.least(a, z)).alias("a"), F.max(F.greatest(a, z)).alias("z"))).scalar()
        first, last = F.coalesce(F.col("__span.a"), F.lit(0)) - width, F.coalesce(F.col("__span.z"), F.lit(0)) + width
        iv = (iv.withColumn("__span", known).withColumn("__a", F.greatest(F.coalesce(a, first), first))
              .withColumn("__z", F.least(F.coalesce(z, last), last)).drop("__span"))
    else:
        iv = iv.withColumn("__a", a).withColumn("__z", z)
    bucket = lambda c: F.expr(f"({c} - pmod({c}, {width}L)) div {width}L")
    iv = (iv.where("__a < __z")
          .withColumn("__b", F.explode(F.sequence(bucket("__a"), bucket("(__z - 1)")))).drop("__a", "__z"))
    right = iv.select(*[F.col(k).alias(f"__k_{k}") for k in by], F.col("__b").alias("__kb"),
                      F.col(lo).alias("__lo"), F.col(hi).alias("__hi"),
                      *[c for c in intervals.columns if c not in (*by, lo, hi)])
    left = points.withColumn("__b", bucket(f"`{point}`"))
    if open_ended:
        left = left.withColumn("__span", known)
        edge = lambda c: c - F.pmod(c, F.lit(width))
        within = F.greatest(F.least(F.col("__b") * width, edge(last - 1)), edge(first))
        left = left.withColumn("__b", within).withColumn("__b", F.expr(f"__b div {width}L")).drop("__span")
    cond = F.col("__b") == F.col("__kb")
    for k in by:
        cond = cond & (F.col(k) == F.col(f"__k_{k}"))
    t = F.col(point)
    cond = cond & (F.col("__lo").isNull() | (t >= F.col("__lo"))) & (F.col("__hi").isNull() | (t < F.col("__hi")))
    return left.join(right, cond, how).drop("__b", "__kb", *[f"__k_{k}" for k in by]) \
               .withColumnRenamed("__lo", lo).withColumnRenamed("__hi", hi)


def coalesce_intervals(df: DataFrame, by: list[str], lo: str = "lo", hi: str = "hi",
                       gap: int = 10 * SECOND, width: int = DAY) -> DataFrame:
    """Merge intervals of a key whose gap is at most ``gap`` (inclusive): (by, lo, hi).

    Stage 1 merges inside each time bucket of starts: one shuffle on (key, bucket).
    Stage 2 works on one row per (key, bucket): how far earlier buckets reach, and the
    start of the merged interval still open there. A local interval beyond that reach
    starts a new one; the others join the open one.
    """
    here = [*by, "__d"]
    rows = (df.where(F.col(lo).isNotNull() & F.col(hi).isNotNull())
            .select(*by, F.col(lo).alias("lo"), F.col(hi).alias("hi"))
            .withColumn("__d", F.col("lo") - F.pmod(F.col("lo"), F.lit(width))))
    w = Window.partitionBy(*here).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    local = (rows.withColumn("__reach", reach)
             .withColumn("__head", F.when(F.col("__reach").isNull() | (F.col("lo") > F.col("__reach") + gap), F.col("lo")))
             .withColumn("__i", F.max("__head").over(w.rowsBetween(Window.unboundedPreceding, 0)))
             .groupBy(*here, "__i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("__i"))
    earlier = Window.partitionBy(*by).orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)
    is_head = lambda c: F.col("__r").isNull() | (F.col(c) > F.col("__r") + gap)
    carry = (local.groupBy(*here).agg(F.max("lo").alias("__last"), F.max("hi").alias("__end"))
             .withColumn("__r", F.max("__end").over(earlier))
             .withColumn("__open", F.max(F.when(is_head("__last"), F.col("__last"))).over(earlier))
             .select(*here, "__r", "__open"))
    return (local.join(carry, here)
            .withColumn("__i", F.when(is_head("lo"), F.col("lo")).otherwise(F.col("__open")))
            .groupBy(*by, "__i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("__i"))


def step_counts(df: DataFrame, by: list[str], lo: str = "lo", hi: str = "hi", width: int = DAY) -> DataFrame:
    """Sweep +1/-1 over the bounds: segments (by, lo, hi, n) of constant cover, n > 0."""
    bounds = F.array(F.struct(F.col(lo).alias("lo"), F.lit(1).alias("d")),
                     F.struct(F.col(hi).alias("lo"), F.lit(-1).alias("d")))
    deltas = df.select(*by, F.inline(bounds)).groupBy(*by, "lo").agg(F.sum("d").alias("d"))
    steps = running(deltas, by, "lo", width, {"n": Run("sum", F.col("d")),
                                              "hi": Run("min", F.col("lo"), forward=False, include_current=False)})
    return steps.where("n > 0").select(*by, "lo", "hi", "n")


def resolve_intervals(df: DataFrame, by: list[str], picks: list[Column], lo: str = "lo", hi: str = "hi",
                      width: int = 30 * DAY, cover_all: bool = False) -> DataFrame:
    """Flatten overlapping intervals into disjoint segments carrying the winning values.

    ``picks`` are aggregates over the intervals covering a segment, for example
    ``max_by(group, ord)``. The interval table is small, so the overlap is settled
    here and the large table later finds at most one segment: no group-by on it.
    With ``cover_all`` every key spans all time and gaps have ``matched = false``.
    """
    iv = df.withColumn("__lo", F.col(lo)).withColumn("__hi", F.col(hi))
    low = F.lit(-(1 << 62))  # stands for "since ever"
    edges = (iv.select(*by, F.coalesce(F.col("__lo"), low).alias("at"))
             .unionByName(iv.where("__hi IS NOT NULL").select(*by, F.col("__hi").alias("at"))))
    if cover_all:
        edges = edges.unionByName(iv.select(*by, low.alias("at")))
    edges = cut_lineage(edges.distinct())  # read three times
    segs = with_neighbours(edges, by, "at", width, next="seg_hi")
    inner = iv.select(*by, "__lo", "__hi", *[c for c in df.columns if c not in (*by, lo, hi)])
    ends = df.agg(F.struct(F.min(F.least(lo, hi)).alias("a"), F.max(F.greatest(lo, hi)).alias("z")).alias("s")).scalar()
    covered = stab_join(edges.where(F.col("at") != low), inner, by, "at", "__lo", "__hi", width, "inner", span=(ends["a"], ends["z"]))
    # intervals open below also cover the segment that starts at minus infinity
    since_ever = inner.where("__lo IS NULL").withColumn("at", low)
    agg = (covered.unionByName(since_ever).groupBy(*by, "at")
           .agg(*picks, F.lit(True).alias("matched")))
    out = segs.join(agg, [*by, "at"], "left" if cover_all else "inner")
    return (out.withColumn("matched", F.coalesce("matched", F.lit(False)))
            .withColumn("lo", F.when(F.col("at") != low, F.col("at")))
            .withColumnRenamed("seg_hi", "hi").drop("at"))
