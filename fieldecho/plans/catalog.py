"""Catalog of recordings: names and headers -> sidecar overrides -> zones -> master table."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text, timefn
from ..operators.ranking import keep_first
from ..operators.relate import nearest_ancestor
from ..sources import audio
from . import deployments

# Fixed value: file names of the sidecar's source recordings.
SIDECAR_NAME = r"(S4A\d{5})_(?:[01]_)?(\d{8})(.)(\d{6})(?:_000)?\.(?:wav|w4v)$"
# The sidecar's columns and their types.
SIDECAR = {"FOLDER": "string", "IN FILE": "string", "DATE": "date", "TIME": "string", "DURATION": "double", "LONGITUDE": "double", "LATITUDE": "double"}
#: Sidecar lines handed on at once.
LINES = 10_000
COLUMNS = ("file", "recorder", "recorder_type", "channel", "gps_sync", "start_datetime", "end_datetime", "duration",
           "latitude", "longitude", "recorder_group", "timestamp_source", "file_end", "datalen", "rate")


def read_headers(files: DataFrame) -> DataFrame:
    """Parsed names and WAV headers of the wave files in a listing."""
    waves = files.where(text.is_wave(F.col("name"))).select("file", "dir")
    return (waves.withColumn("p", text.parse_filename(F.col("file"))).withColumn("h", audio.wav_header("file"))
            .select("file", "dir", "p.filename", "p.recorder", "p.recorder_type", "p.channel", "p.gps_sync",
                    "p.start_datetime", F.col("p.end_datetime").alias("file_end"), "p.latitude", "p.longitude", "h.*"))


def sidecar_rows(raw: DataFrame, files: DataFrame) -> DataFrame:
    """Sidecar metadata rows -> tidy rows with the names of the wave files they describe.

    ``raw``: meta_dir plus the sidecar's own columns. The start second may be off by up
    to three; the first offset whose channel-0 file exists decides.
    """
    part = lambda n: F.regexp_extract("IN FILE", SIDECAR_NAME, n)
    base = (raw.withColumn("FOLDER", F.coalesce("FOLDER", F.lit("")))
            .withColumn("kmeta_recorder", F.nullif(part(1), F.lit(""))).withColumn("__d", part(2)).withColumn("__t", part(4))
            .withColumn("kmeta_gps", F.when(F.col("kmeta_recorder").isNotNull(), part(3) == "$"))
            .withColumn("kmeta_datetime", F.try_to_timestamp(
                F.concat(F.date_format("DATE", "yyyyMMdd"), F.lit("_"), F.replace("TIME", F.lit(":"), F.lit("")), F.lit(text.FIXED_CLOCK_OFFSET)),
                F.lit("yyyyMMdd_HHmmssxx"))))
    # a name is a prefix (folder, recorder, channel 0, day), six digits and a fixed end: the names in the listing become the times of each prefix, at
    # most a million, so every sidecar row and every file is shuffled once
    end, file = "_000.wav", F.col("file")
    stem = F.char_length(file) - len(end) - 6
    times = (files.where(file.endswith(end)).select(F.substring(file, F.lit(1), stem).alias("__prefix"), F.substring(file, stem + 1, F.lit(6)).alias("__s"))
             .where(F.col("__s").rlike(r"^[0-9]{6}$")).groupBy("__prefix").agg(F.collect_set("__s").alias("__there")))
    at = F.try_to_timestamp(F.concat_ws("_", "__d", "__t"), F.lit("yyyyMMdd_HHmmss"))
    tried = [F.date_format(F.timestamp_micros(F.unix_micros(at) + k * timefn.SECOND), "HHmmss") for k in range(4)]
    folder = F.when(F.col("FOLDER") == "", F.col("meta_dir")).otherwise(F.concat_ws("/", "meta_dir", "FOLDER"))
    prefix = F.when(F.col("kmeta_recorder").isNotNull(), F.concat_ws("/", folder, F.concat("kmeta_recorder", F.lit("_0_"), "__d", F.lit("_"))))
    best = F.coalesce(*[F.when(F.array_contains("__there", s), s) for s in tried])
    name = lambda ch: F.concat("kmeta_recorder", F.lit(f"_{ch}_"), "__d", F.lit("_"), "__best", F.lit(end))
    met = base.withColumn("__prefix", prefix).join(times, "__prefix", "left").withColumn("__best", best).withColumn("wavfile0", name(0)).withColumn("wavfile1", name(1))
    return (met.select("meta_dir", F.col("IN FILE").alias("sourcefile"), F.col("DURATION").alias("kmeta_duration"), "kmeta_datetime",
                    "kmeta_recorder", "kmeta_gps", F.col("LONGITUDE").alias("kmeta_longitude"), F.col("LATITUDE").alias("kmeta_latitude"),
                    F.coalesce("wavfile0", F.when(F.col("kmeta_recorder").isNotNull(), F.lit(""))).alias("wavfile0"),
                    F.coalesce("wavfile1", F.when(F.col("kmeta_recorder").isNotNull(), F.lit(""))).alias("wavfile1")))


def read_sidecars(files: DataFrame, name: str = "meta.csv") -> DataFrame:
    """Rows of every sidecar file in a listing, with the folder they came from. Columns go by each file's own header: their order does not
    count, further ones are left out, missing ones are null. Files that cannot be read give the rows before the fault; ``sidecar_problems`` lists them."""
    return (_sidecar_lines(files, name).where("reason IS NULL")
            .select(*[F.col(f"`{c}`").try_cast(kind).alias(c) for c, kind in SIDECAR.items()], "meta_dir"))


def sidecar_problems(files: DataFrame, name: str = "meta.csv") -> DataFrame:
    """Sidecar files that cannot be read or have none of the columns: source, path, reason."""
    return _sidecar_lines(files, name).where("reason IS NOT NULL").select(F.lit("sidecar").alias("source"), F.col("file").alias("path"), "reason")


def _sidecar_lines(files: DataFrame, name: str) -> DataFrame:
    """Texts of all rows as (the sidecar's columns, meta_dir, file, reason); the files are dealt to tasks by name and read line by line."""
    columns = [*SIDECAR, "meta_dir", "file", "reason"]

    def rows(path: str, folder: str) -> Iterator[tuple]:
        try:
            with open(path, encoding="utf-8-sig", newline="") as fh:
                lines = csv.DictReader(fh)
                if not set(SIDECAR) & set(lines.fieldnames or ()):
                    raise ValueError("no known column")
                for line in lines:
                    yield (*[line.get(c) or None for c in SIDECAR], folder, path, None)
        except (OSError, ValueError, csv.Error) as e:
            yield (*[None] * len(SIDECAR), folder, path, str(e) if type(e) is ValueError else type(e).__name__)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = (r for path, folder in zip(frame["file"], frame["dir"]) for r in rows(path, folder))
            while part := list(islice(found, LINES)):
                yield pd.DataFrame(part, columns=columns, dtype=object)

    listed = files.where(F.col("name") == name).select("file", "dir")
    return listed.repartition("file").mapInPandas(work, ", ".join(f"`{c}` string" for c in columns))


def unpivot_sidecar(rows: DataFrame) -> DataFrame:
    """One row per wave file name instead of two name columns."""
    ids = [c for c in rows.columns if c not in ("wavfile0", "wavfile1")]
    return rows.unpivot(ids, ["wavfile0", "wavfile1"], "__ab", "filename").drop("__ab")


def apply_sidecar(waves: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Override sync, start and coordinates where a sidecar row with a time matches (even with null coordinates)."""
    side = unpivot_sidecar(sidecar).where("filename <> ''").withColumnRenamed("meta_dir", "at")
    near = nearest_ancestor(waves.select("dir"), sidecar.select(F.col("meta_dir").alias("at")))
    out = waves.join(near, "dir", "left").join(side, ["at", "filename"], "left")
    has = F.col("kmeta_datetime").isNotNull()
    for col, src in (("gps_sync", "kmeta_gps"), ("start_datetime", "kmeta_datetime"),
                     ("longitude", "kmeta_longitude"), ("latitude", "kmeta_latitude")):
        out = out.withColumn(col, F.when(has, F.col(src)).otherwise(F.col(col)))
    return (out.withColumn("timestamp_source", F.when(has, "kal_meta").otherwise("filename"))
            .drop("at", "sourcefile", *[c for c in out.columns if c.startswith("kmeta_")]))


def index(files: DataFrame, zones: DataFrame | None = None, sidecar: DataFrame | None = None,
          done: DataFrame | None = None) -> DataFrame:
    """Draft catalog rows of a listing; folders in ``done`` are skipped (incremental run)."""
    todo = audio.pruned(files)
    if done is not None:
        todo = audio.new_only(todo, done)
    waves = read_headers(todo)
    waves = apply_sidecar(waves, sidecar) if sidecar is not None else waves.withColumn("timestamp_source", F.lit("filename"))
    waves = (waves.where("start_datetime IS NOT NULL AND datalen > 0").withColumn("duration", F.col("datalen") / F.col("rate"))
             .withColumn("end_datetime", timefn.add_seconds(F.col("start_datetime"), F.col("duration"))))
    if zones is None:
        return waves.withColumn("recorder_group", F.lit(None).cast("string"))
    return geo.join_zones(waves, zones)


def dropped_names(files: DataFrame) -> DataFrame:
    """Wave files no name pattern matches (for example an upper-case extension)."""
    return (audio.pruned(files).where(text.is_wave(F.col("name")))
            .where(text.parse_filename(F.col("file"))["start_datetime"].isNull()).select("file"))


def build(drafts: DataFrame, dep: DataFrame | None = None, order: str = "ord") -> DataFrame:
    """Master catalog: first copy of each (recorder, file name) by folder, one stereo channel, deployment overrides."""
    cat = keep_first(drafts, ["recorder", "filename"], [F.col("dir"), F.col("file")])
    cat = cat.where(~F.col("channel").eqNullSafe("1"))
    cat = cat.select(*[c for c in COLUMNS if c in cat.columns])
    return deployments.apply_metadata(cat, dep, order) if dep is not None else cat


def path_of(folder: Column, name: Column) -> Column:
    return text.join_path(folder, name)
