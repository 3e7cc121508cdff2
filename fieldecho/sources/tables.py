"""Tabular inputs with declared schemas."""

from __future__ import annotations

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import geo, text
from .audio import list_files


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, or CSV by suffix. Parquet files that cannot be read are passed over; ``parquet_problems`` names them."""
    if path.rstrip("/").endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader).csv(path)
    reader = spark.read.option("ignoreCorruptFiles", True)
    return (reader.schema(schema) if schema else reader).parquet(path)


def parquet_problems(files: DataFrame) -> DataFrame:
    """Of the listed Parquet files those whose footer cannot be read: source, path, reason."""
    @F.pandas_udf("string")
    def reason(paths: pd.Series) -> pd.Series:
        def one(path: str) -> str | None:
            try:
                pq.read_metadata(path)
            except Exception as e:
                return type(e).__name__
        return paths.map(one)
    found = files.select(F.lit("parquet").alias("source"), F.col("file").alias("path"), reason("file").alias("reason"))
    return found.where("reason IS NOT NULL")


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored step, or None when it has not been written yet."""
    return spark.read.parquet(path) if exists(spark, path) else None


def window_sidecars(spark: SparkSession, roots: list[str], folder: str = "_bn_grid_wprobs") -> DataFrame:
    """Classifier output below the roots, only ``emb_*.parquet`` inside its own folder.

    Spark hides folders whose name starts with an underscore from recursive reads, so
    the folders are found by listing and named one by one. ``probs`` may be stored as structs or as [class, probability] lists; both read as structs.
    """
    files = list_files(spark, roots).where((text.basename(F.col("dir")) == folder) & F.col("name").rlike(r"^emb_.*\.parquet$"))
    dirs = [r["dir"] for r in files.select("dir").distinct().toLocalIterator()]  # path list of the scan, as any file index holds
    if not dirs:
        raise RuntimeError(f"no {folder}/emb_*.parquet below {roots}")
    raw = spark.read.option("pathGlobFilter", "emb_*.parquet").option("ignoreCorruptFiles", True).parquet(*dirs)
    return raw.withColumn("probs", as_pairs(raw))


def as_pairs(df: DataFrame, column: str = "probs") -> Column:
    if df.schema[column].dataType.simpleString().startswith("array<array"):
        return F.transform(column, lambda p: F.struct(p[0].cast("int").alias("class_idx"), p[1].cast("double").alias("prob")))
    return F.col(column)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label file: class index = physical line number, name split at the first underscore."""
    with open(path, encoding="utf-8") as fh:  # a few thousand lines, bounded by the classifier's classes
        lines = [(k, line.rstrip("\r\n")) for k, line in enumerate(fh)]
    df = spark.createDataFrame(lines, "class_idx int, line string")
    return df.withColumn("l", text.split_label(F.col("line"))).select("class_idx", "l.species", "l.common_name")


def read_site_species(spark: SparkSession, path: str) -> DataFrame:
    """Site list, same line format; lines without an underscore are ignored."""
    return (spark.read.text(path).select(F.trim("value").alias("line")).where("line LIKE '%\\_%'")
            .select(text.split_label(F.col("line"))["common_name"].alias("common_name")).distinct())


def flag_site_species(labels: DataFrame, site: DataFrame | None) -> DataFrame:
    """Add ``site_species``; without a list every species counts."""
    if site is None:
        return labels.withColumn("site_species", F.lit(True))
    return (labels.join(site.select("common_name").distinct().withColumn("__s", F.lit(True)), "common_name", "left")
            .withColumn("site_species", F.col("__s").isNotNull()).drop("__s"))


def read_zones(spark: SparkSession, path: str, marker: str = "RecorderZone") -> DataFrame:
    """GeoJSON polygons whose name holds the marker: group, edges."""
    raw = spark.read.option("multiLine", True).schema(schemas.GEOJSON).json(path)
    return zones_from(raw, marker)


def zones_from(raw: DataFrame, marker: str = "RecorderZone") -> DataFrame:
    f = raw.select(F.explode("features").alias("f")).select(
        F.col("f.properties.name").alias("name"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    rings = F.when(F.col("kind") == "MultiPolygon", F.flatten(F.from_json("c", "array<array<array<array<double>>>>"))
                   ).otherwise(F.from_json("c", "array<array<array<double>>>"))
    return (f.where(F.col("name").contains(marker))
            .select(F.replace("name", F.lit(f"{marker}_"), F.lit("")).alias("group"), geo.ring_edges(rings).alias("edges")))


def deployments_from(raw: DataFrame, zone: str, order: str = "ord") -> DataFrame:
    """Spreadsheet rows -> typed deployments; an active row has no end.

    Dates without an offset are site-local midnights. ``status`` may be missing.
    """
    has_offset = lambda c: F.col(c).rlike(r"[+-]\d{2}:?\d{2}$|Z$")
    when = lambda c: F.when(has_offset(c), F.col(c).try_cast("timestamp")).otherwise(
        F.to_utc_timestamp(F.to_timestamp_ntz(F.date_format(F.col(c).try_cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss"), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp"), zone))
    df = raw if "status" in raw.columns else raw.withColumn("status", F.lit(None).cast("string"))
    num = lambda c: F.col(c).try_cast("double")
    out = df.withColumn("begin", when("begin")).withColumn("end", when("end"))
    out = out.withColumn("end", F.when(F.coalesce(F.col("status") == "active", F.lit(False)), None).otherwise(F.col("end")))
    for c in ("height_above_ground", "longitude", "latitude", "elevation_m", "z"):
        if c in out.columns:
            out = out.withColumn(c, num(c))
    return out if order in out.columns else out.withColumn(order, F.monotonically_increasing_id())


def read_deployments(spark: SparkSession, path: str, zone: str) -> DataFrame:
    """Deployment CSV; header names are matched without regard to case. File order is kept in ``ord``."""
    # read whole, not in splits: the numbering below then follows the lines
    raw = spark.read.option("header", True).option("multiLine", True).csv(path)
    raw = raw.toDF(*[c.lower() for c in raw.columns])
    keep = [c for c in ("recorder", "recorder_group", "begin", "end", "status", "mount", "height_above_ground",
                        "longitude", "latitude", "elevation_m", "z") if c in raw.columns]
    return deployments_from(raw.select(*keep), zone)


def read_weather_json(spark: SparkSession, path: str) -> DataFrame:
    """Stored weather replies with parallel hourly arrays."""
    return spark.read.option("multiLine", True).schema(schemas.WEATHER_JSON).json(path)


def weather_request(lat: float, lon: float, start: str, end: str, humidity: bool = True, source: str = "hrrr") -> tuple[str, dict]:
    """Service name and parameters of one weather request: UTC hours, padded by a day on each side."""
    from datetime import date, timedelta
    pad = lambda d, k: (date.fromisoformat(d) + timedelta(days=k)).isoformat()
    # The area served by the fine grid.
    fine = source == "hrrr" and 21.0 <= lat <= 53.0 and -134.0 <= lon <= -60.0
    params = {"latitude": lat, "longitude": lon, "start_date": pad(start, -1), "end_date": pad(end, 1), "timezone": "UTC",
              "hourly": "temperature_2m,relative_humidity_2m" if humidity else "temperature_2m"}
    if fine:
        params["models"] = "gfs_hrrr"
    return ("hrrr" if fine else "era5"), params


# Public weather services, fine grid first, coarse archive as fallback.
WEATHER_URLS = {"hrrr": "https://historical-forecast-api.open-meteo.com/v1/forecast",
                "era5": "https://archive-api.open-meteo.com/v1/archive"}


def fetch_weather(requests: DataFrame, lat: float, lon: float, humidity: bool = True, source: str = "hrrr") -> DataFrame:
    """One reply per (chunk_start, chunk_end) row: ``hourly`` arrays and the ``source`` used.

    The fine grid falls back to the archive when its request fails.
    """
    import json
    import urllib.parse
    import urllib.request

    import pandas as pd

    @F.pandas_udf("source string, body string")
    def get(starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        def call(name: str, params: dict) -> str:
            with urllib.request.urlopen(f"{WEATHER_URLS[name]}?{urllib.parse.urlencode(params)}", timeout=30) as r:
                return json.dumps(json.load(r))

        def one(a, b):
            name, params = weather_request(lat, lon, str(a), str(b), humidity, source)
            if name == "hrrr":
                try:
                    return name, call(name, params)
                except Exception:
                    params.pop("models")
            return "era5", call("era5", params)
        return pd.DataFrame([one(a, b) for a, b in zip(starts, ends)], columns=["source", "body"])

    got = requests.select(get(F.col("chunk_start").cast("string"), F.col("chunk_end").cast("string")).alias("r"))
    return got.select("r.source", F.from_json("r.body", schemas.WEATHER_JSON)["hourly"].alias("hourly"))
