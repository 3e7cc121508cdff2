"""Cross-recorder agreement on one species in one second.

Two aggregation levels. The first folds repeats of a recorder with map-side combine.
The second is hash-partitioned by (species, second) alone, so the per-group counts,
the across-group maximum and the earliest exact time all share that one exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["common_name", "call_datetime_r"]


def count_name(threshold: float) -> str:
    return f"n_p{round(threshold * 100)}"


def per_recorder_max(det: DataFrame) -> DataFrame:
    """Best probability per (species, second, group, recorder); null keys vanish."""
    keys = [*KEYS, "recorder_group", "recorder"]
    return det.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.max("prob").alias("prob"))


def concordance(det: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """Tidy table keyed by (species, second, group).

    maxp, allmax (over groups), one count column per threshold, and ``call_datetime``:
    the earliest exact time of that species and second over all detections, those without
    recorder or group included.
    """
    timed = "call_datetime" in det.columns
    keys = [*KEYS, "recorder_group", "recorder"]
    earliest = [F.min("call_datetime").alias("call_datetime")] if timed else []
    # rows without recorder or group count for nothing but the earliest time
    cells = (det.where(" AND ".join(f"{k} IS NOT NULL" for k in KEYS)).groupBy(*keys).agg(F.max("prob").alias("prob"), *earliest)
             .withColumn("__ok", F.col("recorder_group").isNotNull() & F.col("recorder").isNotNull()).repartition(*[F.col(k) for k in KEYS]))
    aggs = [F.max(F.when(F.col("__ok"), F.col("prob"))).alias("maxp"),
            *[F.count_if(F.col("__ok") & (F.col("prob") >= t)).alias(count_name(t)) for t in thresholds]]
    across = Window.partitionBy(*KEYS)  # rows: the groups of one second
    out = (cells.groupBy(*KEYS, "recorder_group").agg(*aggs, *earliest, F.bool_or("__ok").alias("__ok"))
           .withColumn("allmax", F.max("maxp").over(across)))
    if timed:
        out = out.withColumn("call_datetime", F.min("call_datetime").over(across))
    return out.where("__ok").drop("__ok")


def dense_counts(conc: DataFrame, groups: list[str], thresholds: tuple[float, ...]) -> DataFrame:
    """Every (species, second) with one row per listed group: counts 0 and maxp null where absent."""
    keys = conc.select(*KEYS).distinct().withColumn("recorder_group", F.explode(F.array(*[F.lit(g) for g in groups])))
    names = [count_name(t) for t in thresholds]
    return (keys.join(conc.select(*KEYS, "recorder_group", "maxp", *names), [*KEYS, "recorder_group"], "left")
            .fillna(0, subset=names))


def wide(det: DataFrame, columns: list[str], by: str = "recorder") -> DataFrame:
    """One column of best probability per listed recorder (or group)."""
    return per_recorder_max(det).groupBy(*KEYS).pivot(by, columns).agg(F.max("prob"))
