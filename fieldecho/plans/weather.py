"""Hourly weather -> speed of sound -> candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.physics import DAY_BIAS_C, NIGHT_BIAS_C, diurnal_bias, speed_of_sound
from ..functions.timefn import HOUR, is_night, micros
from ..operators.asof import asof_join
from ..operators.ranking import keep_first
from ..operators.stats import delta_report


def hourly(payload: DataFrame, zone: str, source: str, humidity: bool = True,
           night_bias: float | None = NIGHT_BIAS_C, day_bias: float | None = DAY_BIAS_C) -> DataFrame:
    """Parallel arrays of one or more weather replies -> rows with bias-corrected temperature and speed."""
    h = F.col("hourly")
    rows = (payload.select(F.explode(F.arrays_zip(h["time"].alias("t"), h["temperature_2m"].alias("temp"),
                                                  h["relative_humidity_2m"].alias("rh"))).alias("r"))
            .select(F.to_utc_timestamp(F.col("r.t").cast("timestamp_ntz").cast("timestamp"), F.current_timezone()).alias("dt"),
                    F.col("r.temp").alias("temp_c_raw"), F.col("r.rh").alias("rh")).where("temp_c_raw IS NOT NULL"))
    local = F.from_utc_timestamp(F.col("dt"), zone)
    temp = (F.col("temp_c_raw") if night_bias is None and day_bias is None
            else diurnal_bias(F.col("temp_c_raw"), local, night_bias or 0.0, day_bias or 0.0))
    return (rows.withColumn("temp_c", temp)
            .withColumn("speed", speed_of_sound(F.col("temp_c"), F.col("rh") if humidity else None))
            .withColumn("source", F.lit(source)))


def attach_speed(candidates: DataFrame, weather: DataFrame, time: str = "call_datetime") -> DataFrame:
    """Temperature and speed of the nearest reading, however far; ties to the earlier."""
    w = keep_first(weather, ["dt"], [F.col("temp_c")]).select(micros(F.col("dt")).alias("__w"), "temp_c", "speed")
    return asof_join(candidates.withColumn("__t", micros(F.col(time))), w, "__t", "__w",
                     direction="nearest").drop("__t", "__w")


def reattach_speed(candidates: DataFrame, weather: DataFrame, time: str = "call_datetime",
                   tolerance: int = HOUR) -> DataFrame:
    """Replace speed and temperature by the reading within the tolerance; else keep the old ones."""
    w = (keep_first(weather, ["dt"], [F.col("temp_c")])
         .select(micros(F.col("dt")).alias("__w"), F.col("temp_c").alias("__temp"), F.col("speed").alias("__speed"),
                 F.col("rh").alias("__rh")))
    out = asof_join(candidates.drop("rh").withColumn("__t", micros(F.col(time))), w, "__t", "__w",
                    direction="nearest", tolerance=tolerance)
    return (out.withColumn("speed_old", F.col("speed"))
            .withColumn("speed", F.coalesce("__speed", "speed")).withColumn("temp_c", F.coalesce("__temp", "temp_c"))
            .withColumn("rh", F.col("__rh")).drop("__t", "__w", "__temp", "__speed", "__rh"))


def speed_change_report(candidates: DataFrame, zone: str, time: str = "call_datetime") -> DataFrame:
    """Distribution of the speed change, night and day apart."""
    local = F.from_utc_timestamp(F.col(time), zone)
    df = candidates.withColumn("delta", F.col("speed") - F.col("speed_old")).withColumn(
        "period", F.when(is_night(local), "night").otherwise("day"))
    return delta_report(df, "delta", ["period"])
