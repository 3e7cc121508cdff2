"""Exact statistics that stay distributed for hot or global groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .running import with_neighbours

_CLAMP = 1.7e308
FINE = 256


def _value_bucket(v: Column) -> Column:
    """Order-preserving coarse bucket of a double: 256 per octave, so a bounded number per key."""
    x = F.greatest(F.least(v, F.lit(_CLAMP)), F.lit(-_CLAMP))
    mag = F.floor(F.log2(F.abs(x)) * 256) + 300_000
    return F.when(x == 0, F.lit(0)).when(x > 0, mag).otherwise(-mag).cast("bigint")


def _named(rows: DataFrame, by: list[str], *names: str) -> DataFrame:
    """``rows`` with their keys under names of their own, ready to be joined."""
    return rows.select(*[F.col(k).alias(f"__k_{k}") for k in by], *[F.col(n).alias(f"__k{n}") for n in names[:1]], *names[1:])


def _same(by: list[str], bucket: str) -> Column:
    cond = F.col(bucket) == F.col(f"__k{bucket}")
    for k in by:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return cond


def _fine(v: Column, lo: Column, wide: Column) -> Column:
    """Which of ``FINE`` equal parts of a bucket a value stands in; ``wide`` is null where it cannot be parted."""
    return F.coalesce(F.least(F.floor((v - lo) / wide * FINE), F.lit(FINE - 1)), F.lit(0)).cast("bigint")


def _wanted(buckets: DataFrame, by: list[str], bucket: str, more: list[str]) -> DataFrame:
    """The buckets (with ``__m`` values each) that hold a rank of ``__want``, with how many values come ``__before`` them."""
    order = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__base") + F.coalesce(F.sum("__m").over(order), F.lit(0))
    held = F.filter("__want", lambda w: (w["r"] >= F.col("__before")) & (w["r"] < F.col("__before") + F.col("__m")))
    return buckets.withColumn("__before", before).withColumn("__want", held).where("size(__want) > 0").select(*by, bucket, "__before", "__want", *more)


def exact_percentiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated percentiles per key, plus the row count ``n``.

    The built-in exact percentile keeps every distinct value of a group in one
    buffer. Here equal values are counted with map-side combine and rolled up to a histogram on a log scale. Only buckets
    that hold a wanted rank are looked at again: they are cut evenly over the values they hold, and of those finer buckets again
    only the ones with a wanted rank are ranked row by row. What is joined is the list of wanted buckets, at most two a
    percentile and key, never one bucket table with all counts. Null and NaN values are ignored; infinities sort last.
    """
    v = F.col(value).cast("double")
    counts = cut_lineage(df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, v.alias("__v")).agg(F.count("*").alias("__n"))
                         .withColumn("__b", _value_bucket(F.col("__v"))))  # read twice: ``df`` may be a join
    coarse = counts.groupBy(*by, "__b").agg(F.sum("__n").alias("__m"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    coarse = coarse.withColumn("__total", F.sum("__m").over(Window.partitionBy(*by))).withColumn("__base", F.lit(0).cast("bigint"))
    # wanted zero-based ranks: floor(pos) and the next one
    ranks = []
    for name, p in probs.items():
        pos = (F.col("__total") - 1) * F.lit(p)
        for r in (F.floor(pos), F.least(F.floor(pos) + 1, F.col("__total") - 1)):
            ranks.append(F.struct(F.lit(name).alias("name"), pos.alias("pos"), r.alias("r")))
    wide = F.col("__hi") - F.col("__lo")
    even = F.when((wide > 0) & (wide <= _CLAMP), wide)
    need = _wanted(coarse.withColumn("__want", F.array_distinct(F.array(*ranks))), by, "__b", ["__total", "__lo", even.alias("__wide")])
    met = counts.join(_named(need, by, "__b", "__before", "__want", "__total", "__lo", "__wide"), _same(by, "__b"))
    met = cut_lineage(met.select(*by, "__b", "__v", "__n", "__before", "__want", "__total", _fine(F.col("__v"), F.col("__lo"), F.col("__wide")).alias("__f")))
    keys = [*by, "__b"]
    cut = met.groupBy(*keys, "__f").agg(F.sum("__n").alias("__m"), F.first("__before").alias("__base"), F.first("__want").alias("__want"), F.first("__total").alias("__total"))
    last = _wanted(cut, keys, "__f", ["__total"])
    rows = met.select(*keys, "__f", "__v", "__n").join(_named(last, keys, "__f", "__before", "__want", "__total"), _same(keys, "__f"))
    inside = Window.partitionBy(*keys, "__f").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    rows = (rows.withColumn("__from", F.col("__before") + F.coalesce(F.sum("__n").over(inside), F.lit(0)))
            .withColumn("__w", F.explode("__want"))
            .where("__w.r >= __from AND __w.r < __from + __n"))
    at = lambda name, rank: F.max(F.when((F.col("__w.name") == name) & (F.col("__w.r") == rank), F.col("__v")))
    pos = F.col("__w.pos")
    cols = []
    for name in probs:
        lo = at(name, F.floor(pos))
        hi = at(name, F.least(F.floor(pos) + 1, F.col("__total") - 1))
        frac = F.max(F.when(F.col("__w.name") == name, pos - F.floor(pos)))
        cols.append(F.when(frac == 0, lo).otherwise(lo + frac * (hi - lo)).alias(name))
    return rows.groupBy(*by).agg(F.max("__total").alias("n"), *cols)


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: list[str] = (),
              density: bool = False) -> DataFrame:
    """Fixed-width bins over [low, high], right edge closed; values outside are ignored."""
    v = F.col(value)
    width = (high - low) / bins
    b = F.least(F.floor((v - low) / F.lit(width)).cast("int"), F.lit(bins - 1))
    out = (df.where(v.between(low, high)).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))
           .withColumn("bin_lo", F.lit(low) + F.col("bin") * F.lit(width)))
    if density:
        total = F.sum("n").over(Window.partitionBy(*by))  # at most ``bins`` rows per key
        out = out.withColumn("density", F.col("n") / (total * width))
    return out


def majority(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Most frequent non-null value per key; ties go to the smaller value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by).orderBy(F.col("__n").desc(), value)
    return counts.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__n", "__r")


def array_percentiles(df: DataFrame, by: list[str], array: str, probs: dict[str, float]) -> DataFrame:
    """Element-wise percentiles over the arrays of a key, re-assembled in position order."""
    cells = df.select(*by, F.posexplode(array).alias("__pos", "__x"))
    per_cell = exact_percentiles(cells, [*by, "__pos"], "__x", probs)

    def rebuilt(name: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct("__pos", name))), lambda s: s[name]).alias(name)

    return per_cell.groupBy(*by).agg(F.max("n").alias("n"), *[rebuilt(name) for name in probs])


def delta_report(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """n, min, max, mean, sample sd and exact median of a column."""
    by = list(by)
    base = df.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"),
                               F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    med = exact_percentiles(df, by, value, {"median": 0.5})
    if by:
        return base.join(med, by)
    return base.withColumn("__one", F.lit(1)).join(med.withColumn("__one", F.lit(1)), "__one").drop("__one")


def median_step(df: DataFrame, by: list[str], order: str, width: int) -> DataFrame:
    """Median first difference of ``order`` (BIGINT) within a key."""
    prev = with_neighbours(df, by, order, width, prev="__prev")
    return exact_percentiles(prev.withColumn("__d", F.col(order) - F.col("__prev")), by, "__d", {"median_step": 0.5}).drop("n")
