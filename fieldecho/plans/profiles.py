"""Species frequency profiles from clips, and clip selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.timefn import SECOND, micros
from ..operators.ranking import top_n
from ..operators.relate import merge_fill
from ..operators.stats import array_percentiles
from ..signal import spectra
from .localize import once, true_rate


def clip_profile_udf(rate: int, nperseg: int = 1024, noverlap: int = 512, low: float = 500.0, high: float = 15000.0):
    """Column function: samples -> struct(freqs, profile); null for missing or silent clips."""
    @F.pandas_udf("freqs array<double>, profile array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for clips in batches:
            rows = [spectra.clip_profile(y, rate, nperseg, noverlap, low, high) if y is not None and len(y) > 1 and np.any(y) else (None, None)
                    for y in clips]
            yield pd.DataFrame(rows, columns=["freqs", "profile"])
    return once(run)


def profile_table(clips: DataFrame, rate: int, **options) -> DataFrame:
    """``clips``: birdcode, samples -> birdcode, freqs, specmean (median), specmax (90th percentile), n_clips.

    Robust statistics per frequency bin, so a few noisy clips cannot plant a peak.
    """
    per_clip = (clips.withColumn("__p", clip_profile_udf(rate, **options)("samples")).select("birdcode", "__p.*")
                .where("profile IS NOT NULL"))
    # every clip has the frequencies of one segment length and rate, so bins match by position
    freqs = np.fft.rfftfreq(options.get("nperseg", 1024), 1 / rate).tolist()
    stats = array_percentiles(per_clip, ["birdcode"], "profile", {"specmean": 0.5, "specmax": 0.9})
    return stats.withColumnRenamed("n", "n_clips").withColumn("freqs", F.lit(freqs)).select("birdcode", "freqs", "specmean", "specmax", "n_clips")


def best_detections(det: DataFrame, top: int | None = None, min_prob: float = 0.7, clip_seconds: float = 3.0) -> DataFrame:
    """Clip requests for the sure detections of each species, with ``top`` the surest so many, on the recorder's true clock."""
    sure = det.where(F.col("prob") >= min_prob)
    picked = sure if top is None else top_n(sure, ["common_name"], [F.col("prob").desc(), F.col("file"), F.col("call_datetime")], top)
    offset = (micros(F.col("call_datetime")) - micros(F.col("start_datetime"))) / SECOND
    return (picked.withColumn("birdcode", text.profile_code(F.col("common_name")))
            .withColumn("first_sample", F.bround(offset * true_rate(picked)).cast("bigint"))
            .withColumn("n_samples", F.bround(F.lit(clip_seconds) * F.col("rate")).cast("bigint")))


def reference_clips(files: DataFrame, species: Column, max_per_species: int | None = None) -> DataFrame:
    """Reference library files with a species name; ``species`` is any Column over ``file`` (or a UDF)."""
    out = (files.where(text.has_extension(F.col("file"), "wav", "mp3", "flac")).withColumn("common_name", species)
           .where("common_name IS NOT NULL").withColumn("birdcode", text.profile_code(F.col("common_name"))))
    return out if max_per_species is None else top_n(out, ["birdcode"], [F.col("file")], max_per_species)


def merge_profiles(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    return merge_fill(primary, fallback, "birdcode")
