"""Recorder deployments: lookups by (recorder, time) under explicit bound policies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import utm
from ..functions.timefn import DAY, micros
from ..operators.intervals import (CLOSED, END_OF_DAY, BoundPolicy, resolve_intervals, stab_join)
from ..operators.ranking import keep_first, keep_last
from ..operators.stats import exact_percentiles
from ..session import cut_lineage
from ..sources.rasters import pack_tiles, raster_blocks, raster_tiles, sample_tiles

# deployments last for months: wide buckets keep the explosion of open-ended ones small
WIDTH = 365 * DAY


def _intervals(dep: DataFrame, policy: BoundPolicy, order: str) -> DataFrame:
    lo, hi = policy.bounds(micros(F.col("begin")), micros(F.col("end")))
    return dep.withColumn("lo", lo).withColumn("hi", hi).withColumn("__ord", F.col(order))


def apply_metadata(catalog: DataFrame, dep: DataFrame, order: str = "ord",
                   policy: BoundPolicy = END_OF_DAY) -> DataFrame:
    """Override group and coordinates from the deployment in force, later rows winning.

    Group and coordinates are settled independently. A known recorder outside all
    its windows loses its group. ``order`` is the row order of the deployment table.
    """
    has_pos = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    has_group = F.col("recorder_group").isNotNull() & (F.col("recorder_group") != "")
    segs = cut_lineage(resolve_intervals(
        _intervals(dep, policy, order).select("recorder", "lo", "hi", "recorder_group", "latitude", "longitude", "__ord"),
        ["recorder"],
        [F.max_by("recorder_group", F.when(has_group, F.col("__ord"))).alias("d_group"),
         F.max_by("latitude", F.when(has_pos, F.col("__ord"))).alias("d_lat"),
         F.max_by("longitude", F.when(has_pos, F.col("__ord"))).alias("d_lon")],
        width=WIDTH, cover_all=True))  # settled once; the catalog then meets a plain small table
    out = stab_join(catalog.withColumn("__t", micros(F.col("start_datetime"))), segs, ["recorder"], "__t", width=WIDTH)
    lost = F.coalesce(~F.col("matched"), F.lit(False))
    return (out.withColumn("recorder_group", F.when(~lost, F.coalesce("d_group", "recorder_group")))
            .withColumn("latitude", F.coalesce("d_lat", "latitude"))
            .withColumn("longitude", F.coalesce("d_lon", "longitude"))
            .drop("__t", "lo", "hi", "matched", "d_group", "d_lat", "d_lon"))


def match(points: DataFrame, dep: DataFrame, time: str, columns: list[str], order: str = "ord",
          policy: BoundPolicy = CLOSED, fallback: str | None = None) -> DataFrame:
    """Attach ``columns`` of the first deployment in force at ``time``.

    ``fallback`` serves recorders outside all windows: ``first`` in the table or
    ``latest`` to begin. Without it such rows keep nulls and ``matched = false``.
    """
    if fallback not in (None, "first", "latest"):
        raise ValueError(f"fallback must be None, 'first' or 'latest', got {fallback!r}")
    payload = F.struct(*columns)
    segs = resolve_intervals(_intervals(dep, policy, order).select("recorder", "lo", "hi", "__ord", payload.alias("__p")),
                             ["recorder"], [F.min_by("__p", "__ord").alias("hit")], width=WIDTH, cover_all=True)
    if fallback:
        best = (keep_first(dep, ["recorder"], [F.col(order)]) if fallback == "first"
                else keep_last(dep, ["recorder"], ["begin", order]))
        segs = (segs.join(best.select("recorder", payload.alias("__f")), "recorder", "left")
                .withColumn("hit", F.coalesce("hit", "__f")).drop("__f"))
    segs = cut_lineage(segs)  # settled once; the points then meet a plain small table
    out = stab_join(points.withColumn("__t", micros(F.col(time))), segs, ["recorder"], "__t", width=WIDTH)
    return out.select(*points.columns, *[F.col(f"hit.{c}").alias(c) for c in columns],
                      F.coalesce("matched", F.lit(False)).alias("matched"))


def unplaced(matched: DataFrame, key: str) -> DataFrame:
    """Error rows (key, error_type, error_msg) of events with a recorder that no deployment covers; ``matched`` comes from ``match``."""
    lost = matched.where(~F.col("matched")).groupBy(key).agg(F.array_sort(F.collect_set("recorder")).alias("r"))
    return lost.select(key, F.lit("NoDeployment").alias("error_type"), F.concat(F.lit("no deployment at the call for "), F.array_join("r", ", ")).alias("error_msg"))


def with_metres(dep: DataFrame, zone: int) -> DataFrame:
    """Add projected x, y; z is kept."""
    return dep.withColumn("__p", utm(F.col("longitude"), F.col("latitude"), zone)).select("*", "__p.x", "__p.y").drop("__p")


def fill_missing_gps(dep: DataFrame, catalog: DataFrame, order: str = "ord") -> DataFrame:
    """Where either coordinate is missing, set both to the median of the catalog fixes in the window."""
    needs = F.col("latitude").isNull() | F.col("longitude").isNull()
    holes = _intervals(dep.where(needs), CLOSED, order).select("recorder", "lo", "hi", "__ord")
    fixes = (catalog.where("latitude IS NOT NULL AND longitude IS NOT NULL AND start_datetime IS NOT NULL")
             .select("recorder", micros(F.col("start_datetime")).alias("t"), "latitude", "longitude"))
    hits = stab_join(fixes, holes, ["recorder"], "t", width=WIDTH, how="inner")
    axes = hits.select("__ord", F.inline(F.array(
        F.struct(F.lit("lat").alias("axis"), F.col("latitude").alias("v")),
        F.struct(F.lit("lon").alias("axis"), F.col("longitude").alias("v")))))
    med = (exact_percentiles(axes, ["__ord", "axis"], "v", {"m": 0.5}).groupBy(F.col("__ord").alias(order))
           .agg(F.max(F.when(F.col("axis") == "lat", F.col("m"))).alias("__lat"),
                F.max(F.when(F.col("axis") == "lon", F.col("m"))).alias("__lon")))
    # the median is present only for rows that had a hole, and then replaces both
    return (dep.join(med, order, "left").withColumn("latitude", F.coalesce("__lat", "latitude"))
            .withColumn("longitude", F.coalesce("__lon", "longitude")).drop("__lat", "__lon"))


def _with_ground(dep: DataFrame, nodata: float | None) -> DataFrame:
    """``elevation_m`` within 1.0 of the no-data value becomes null; z = ground + height."""
    if nodata is not None:
        dep = dep.withColumn("elevation_m", F.when(F.abs(F.col("elevation_m") - nodata) >= 1.0, F.col("elevation_m")))
    return dep.withColumn("z", F.col("elevation_m") + F.coalesce(F.col("height_above_ground").try_cast("double"), F.lit(0.0)))


def add_elevation(dep: DataFrame, raster: DataFrame, west: float, north: float, step: float,
                  nodata: float | None = None, size: int = 64) -> DataFrame:
    """Sample a raster stored as (row, col, value) cells and set z = ground + height.

    Outside the raster, or within 1.0 of the no-data value, the elevation is null. Cells are
    packed into tiles of ``size`` by ``size`` first, so the join meets tiles and not cells.
    """
    row, col = F.floor((F.lit(north) - F.col("latitude")) / step), F.floor((F.col("longitude") - F.lit(west)) / step)
    return _with_ground(sample_tiles(dep.drop("elevation_m"), pack_tiles(raster, size), row, col, size, size, "elevation_m"), nodata)


def add_elevation_of(dep: DataFrame, file: str) -> DataFrame:
    """``add_elevation`` from a raster file; corner, steps and no-data value are the file's own. Only the blocks
    that hold a recorder are read; an unreadable file is an error, as are coordinates in another system than degrees of the raster."""
    blocks = raster_blocks(dep.sparkSession.createDataFrame([(file,)], "file string"))
    grid = blocks.first()
    if grid is None:
        raise ValueError(f"cannot read raster {file}")
    row, col = F.floor((F.lit(grid.north) - F.col("latitude")) / grid.step_y), F.floor((F.col("longitude") - F.lit(grid.west)) / grid.step_x)
    wanted = dep.select(F.floor(row / grid.tile_height).cast("int").alias("tile_row"), F.floor(col / grid.tile_width).cast("int").alias("tile_col")).distinct()
    tiles = raster_tiles(blocks.join(wanted, ["tile_row", "tile_col"], "left_semi"))
    return _with_ground(sample_tiles(dep.drop("elevation_m"), tiles, row, col, grid.tile_height, grid.tile_width, "elevation_m"), grid.nodata)


def site_of_recorder(recorders: DataFrame, dep: DataFrame, order: str = "ord") -> DataFrame:
    """Latest deployment group per recorder, matched on the 8-digit serial in the id."""
    serial = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, r"(\d{8})", 1), F.lit("")), c)
    last = keep_first(dep.withColumn("__s", serial(F.col("recorder"))), ["__s"],
                      [F.col("begin").desc_nulls_last(), F.col(order).desc()])
    return (recorders.withColumn("__s", serial(F.col("recorder")))
            .join(last.select("__s", F.col("recorder_group").alias("site")), "__s", "left").drop("__s"))


def centroids(dep: DataFrame, events: DataFrame, zone: int, order: str = "ord") -> DataFrame:
    """Mean projected position per group over the latest rows of the recorders its events used."""
    used = events.select("recorder_group", F.explode("recorders").alias("recorder")).distinct()
    last = keep_last(dep, ["recorder_group", "recorder"], ["begin", order])
    return (with_metres(last.join(used, ["recorder_group", "recorder"], "left_semi"), zone)
            .groupBy("recorder_group").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")))
