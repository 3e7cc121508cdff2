"""Audio archives: listing, headers, and sample ranges read where they lie.

Listing never opens a file. Headers and
clips are read by path with a seek, so a 300 MB hour-long recording costs a few
kilobytes for its header and under a megabyte per clip. Paths must be readable from
the executors (a shared or mounted file system).
"""

from __future__ import annotations

import os
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..schemas import WAV_HEADER

MARKER = "donotindex.txt"


def list_files(spark: SparkSession, roots: list[str], depth: int = 2) -> DataFrame:
    """Every file below the roots: file, dir, name, length, modified.

    The upper ``depth`` folder levels are read here; what lies below is walked by the
    executors, one task per batch of folders. Spark's own file sources skip empty
    files, and the marker that hides a folder is usually empty. What could not be read is
    in ``listing_problems``.
    """
    return _walk(spark, roots, depth).where("reason IS NULL").drop("reason")


def listing_problems(spark: SparkSession, roots: list[str], depth: int = 2) -> DataFrame:
    """Folders that could not be opened and entries without a file behind them: source, path, reason."""
    return _walk(spark, roots, depth).where("reason IS NOT NULL").select(F.lit("listing").alias("source"), F.col("file").alias("path"), "reason")


def _subfolders(path: str) -> list[str]:
    try:
        return [e.path for e in os.scandir(path) if e.is_dir(follow_symlinks=False)]
    except OSError:
        return []  # the walk below meets it again and records it


def _walk(spark: SparkSession, roots: list[str], depth: int) -> DataFrame:
    frontier, shallow = list(roots), []
    for _ in range(depth):
        shallow += frontier
        frontier = [p for d in frontier for p in _subfolders(d)]
    work = [(d, False) for d in shallow] + [(d, True) for d in frontier]
    dirs = spark.createDataFrame(work, "path string, deep boolean").repartition(
        max(1, min(len(work), 4 * spark.sparkContext.defaultParallelism)), "path")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file", "dir", "name", "length", "modified", "reason"]
        for pdf in batches:
            rows = []
            failed = lambda e: rows.append((e.filename, None, None, None, None, type(e).__name__))
            for path, deep in zip(pdf["path"], pdf["deep"]):
                for folder, _, files in os.walk(path, onerror=failed):
                    for f in files:
                        full = os.path.join(folder, f)
                        try:
                            st = os.stat(full)
                        except OSError as e:
                            failed(e)
                            continue
                        rows.append((full, folder, f, st.st_size, pd.Timestamp(st.st_mtime_ns // 1000, unit="us"), None))
                    if len(rows) > 10_000:
                        yield pd.DataFrame(rows, columns=names).astype({"length": "Int64"})
                        rows.clear()
                    if not deep:
                        break
            yield pd.DataFrame(rows, columns=names).astype({"length": "Int64"})
    return dirs.mapInPandas(walk, "file string, dir string, name string, length bigint, modified timestamp, reason string")


def pruned(files: DataFrame, marker: str = MARKER, ignore_case: bool = False) -> DataFrame:
    """Drop every file in or below a folder that holds the marker file."""
    same = (F.lower("name") == marker.lower()) if ignore_case else (F.col("name") == marker)
    marked = files.where(same).select(F.col("dir").alias("at")).distinct()
    dirs = files.select("dir").distinct().withColumn(
        "at", F.explode(F.array_union(text.ancestors(F.col("dir")), F.array("dir"))))
    hidden = dirs.join(marked, "at", "left_semi").select("dir").distinct()
    return files.join(hidden, "dir", "left_anti")


def new_only(files: DataFrame, done: DataFrame, key: str = "dir") -> DataFrame:
    """Skip what an earlier run already covered."""
    return files.join(done.select(key).distinct(), key, "left_anti")


def _header(path: str) -> tuple:
    try:
        with wave.open(path, "rb") as f:
            p = f.getparams()
        return p.nchannels, p.sampwidth, p.framerate, p.nframes, p.compname
    except Exception:  # unreadable files keep a row of nulls
        return None, None, None, None, ""


def wav_header(path: str) -> Column:
    """Struct of header fields of the file named in column ``path``."""
    @F.pandas_udf(WAV_HEADER)
    def read(paths: pd.Series) -> pd.DataFrame:
        names = ["channels", "sample_width", "rate", "datalen", "compression_type"]
        out = pd.DataFrame([_header(p) for p in paths], columns=names)
        return out.astype({"channels": "Int32", "sample_width": "Int32", "rate": "Int32", "datalen": "Int64"})
    return read(path)


def pcm_to_float(raw: bytes, width: int, channels: int, channel: int | None = 0) -> np.ndarray:
    """One channel of little-endian PCM as float32 sample values; without a channel the mean of all, scaled to [-1, 1]."""
    if width == 1:
        a = np.frombuffer(raw, np.uint8).astype(np.float32) - 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        a = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32)
    else:
        a = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float32)
    a = a.reshape(-1, channels)
    return a.mean(axis=1) / 2 ** (8 * width - 1) if channel is None else a[:, channel]


def read_range(path: str, first: int, count: int, channel: int | None = 0) -> np.ndarray:
    """``count`` samples from ``first``; positions outside the file are zero."""
    out = np.zeros(count, np.float32)
    with wave.open(path, "rb") as f:
        lo, hi = max(first, 0), min(first + count, f.getnframes())
        if hi > lo:
            f.setpos(lo)
            out[lo - first:hi - first] = pcm_to_float(f.readframes(hi - lo), f.getsampwidth(), f.getnchannels(), channel)
    return out


def read_blocks(path: str, count: int, channel: int | None = 0, size: int = 1 << 17) -> Iterator[np.ndarray]:
    """The first ``count`` samples of a file in blocks of ``size``."""
    with wave.open(path, "rb") as f:
        width, channels = f.getsampwidth(), f.getnchannels()
        left = min(count, f.getnframes())
        while left > 0:
            raw = f.readframes(min(size, left))
            if not raw:
                return
            yield pcm_to_float(raw, width, channels, channel)
            left -= len(raw) // (width * channels)


def resample(y: np.ndarray, source: float, target: float) -> np.ndarray:
    """Band-limited change of rate in the frequency domain."""
    if source == target or not y.size:
        return y
    n = int(round(y.size * target / source))
    spec = np.fft.rfft(y)
    out = np.zeros(n // 2 + 1, complex)
    m = min(len(spec), len(out))
    out[:m] = spec[:m]
    return (np.fft.irfft(out, n) * (n / y.size)).astype(np.float32)


def read_clips(requests: DataFrame, rate: int, keep: list[str]) -> DataFrame:
    """Add ``samples`` at ``rate`` for each (file, first_sample, n_samples, rate) request.

    Requests are spread by (file, position) so a file wanted by a third of all events is
    read by many tasks, and sorted so that a task reads each file front to back. Failed
    reads give null samples.
    """
    spread = (requests.withColumn("__part", F.floor(F.col("first_sample") / 2_000_000))
              .repartition("file", "__part").sortWithinPartitions("file", "first_sample"))
    schema = spread.select(*keep).schema.add("samples", T.ArrayType(T.FloatType()))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 32):  # a clip is about a megabyte: keep Arrow batches small
                part = pdf.iloc[lo:lo + 32]
                got = []
                for path, first, count, own in zip(part["file"], part["first_sample"], part["n_samples"], part["rate"]):
                    try:
                        got.append(resample(read_range(path, int(first), int(count)), float(own), rate))
                    except Exception:
                        got.append(None)
                yield part[keep].assign(samples=got)
    return spread.mapInPandas(read, schema)


def file_hashes(files: DataFrame) -> DataFrame:
    """SHA-256 of each file, read in blocks."""
    import hashlib

    @F.pandas_udf("string")
    def digest(paths: pd.Series) -> pd.Series:
        def one(path: str) -> str | None:
            try:
                with open(path, "rb") as fh:
                    return hashlib.file_digest(fh, "sha256").hexdigest()
            except OSError:
                return None
        return paths.map(one)
    return files.withColumn("sha256", digest("file"))
