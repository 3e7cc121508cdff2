"""Windowed classification of recordings with a pluggable scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, text, timefn
from ..signal.stream import Level, resampled_length, through
from ..sources.audio import read_blocks

Scorer = Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]
NORMALIZATIONS = ("none", "file-peak", "file-percentile", "window-peak")


def gain(y: np.ndarray, mode: str, target: float = 0.99, percentile: float = 99.0, eps: float = 1e-7) -> np.ndarray:
    """Scale a whole recording so its peak, or a percentile of its magnitude, is ``target``."""
    if mode not in NORMALIZATIONS:
        raise ValueError(f"mode must be one of {NORMALIZATIONS}, got {mode!r}")
    if mode in ("none", "window-peak") or not y.size:
        return y
    top = np.abs(y).max() if mode == "file-peak" else np.percentile(np.abs(y), percentile)
    return y if top < eps else y * (target / top)


def file_scale(passes: Callable[[], Iterator[np.ndarray]], mode: str, target: float = 0.99, percentile: float = 99.0, eps: float = 1e-7) -> float:
    """The factor that ``gain`` would apply to a recording that can only be read block by block, as often as needed."""
    if mode not in NORMALIZATIONS:
        raise ValueError(f"mode must be one of {NORMALIZATIONS}, got {mode!r}")
    if mode in ("none", "window-peak"):
        return 1.0
    level = Level(percentile)
    for y in passes():
        level.first(y)
    if mode == "file-percentile":
        for y in passes():
            level.second(y)
    top = level.peak if mode == "file-peak" else level.value()
    return 1.0 if top < eps else target / top


def windows(blocks: Iterator[np.ndarray], starts: np.ndarray, w: int) -> Iterator[np.ndarray]:
    """The windows of ``w`` samples at ascending ``starts``; one that reaches beyond the signal is filled up with silence."""
    held, first = np.empty(0), 0
    blocks = iter(blocks)
    for s in starts.tolist():
        while first + len(held) < s + w:
            y = next(blocks, None)
            if y is None:
                break
            drop = min(max(0, s - first), len(held))
            held, first = np.concatenate([held[drop:], y]), first + drop
        y = held[max(0, s - first):s - first + w]
        yield np.pad(y, (0, w - len(y)))


def score_files(files: DataFrame, scorer: Scorer, rate: int = 48000, window: float = 3.0, low: float | None = 150.0,
                high: float = 15000.0, mode: str = "file-percentile", file_col: str = "file") -> DataFrame:
    """Window rows (file, win_start, win_end, embedding, logits, error) of each recording. Channels are averaged and samples
    scaled to [-1, 1]. A recording that cannot be read or scored gives one row with its error and nulls.

    ``files``: file, shift (seconds to the wall-clock grid), rate, datalen. ``scorer`` maps
    a batch of windows (n, samples) and the rate to (embeddings, logits). A recording is
    decoded, changed in rate and filtered block by block, so memory does not grow with its length; a file-wide gain is measured in passes of
    its own before. Windows are streamed out in small batches. Recordings are spread one per task slot by their path hash.
    """
    schema = f"{file_col} string, win_start double, win_end double, embedding array<float>, logits array<float>, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, shift, own, frames in zip(pdf[file_col], pdf["shift"], pdf["rate"], pdf["datalen"]):
                try:
                    yield from windows_of(path, shift, own, frames)
                except Exception as e:
                    yield pd.DataFrame([(path, None, None, None, None, f"{type(e).__name__}: {e}")], columns=names)

    names = [file_col, "win_start", "win_end", "embedding", "logits", "error"]
    w = int(round(window * rate))

    def windows_of(path: str, shift: float, own: int, frames: int) -> Iterator[pd.DataFrame]:
        n = int(frames)
        passes = lambda: through(read_blocks(path, n, None), int(own), rate, low, high, n)
        scale = file_scale(passes, mode)
        total, first = resampled_length(n, int(own), rate), int(round(shift * rate))
        starts = np.arange(first, max(0, total - w) + 1, w)
        found = windows(passes(), starts, w)
        for k in range(0, len(starts), 16):
            part = starts[k:k + 16]
            x = (np.stack([next(found) for _ in part]) * scale).astype(np.float32)
            if mode == "window-peak":
                top = np.abs(x).max(1, keepdims=True)
                x = np.where(top > 0, 0.99 * x / np.where(top > 0, top, 1), x)
            emb, logits = scorer(x, rate)
            yield pd.DataFrame({file_col: path, "win_start": part / rate, "win_end": (part + w) / rate,
                                "embedding": list(np.asarray(emb, np.float32)), "logits": list(np.asarray(logits, np.float32)), "error": None})
    return files.repartition(file_col).mapInPandas(run, schema)


def detect(files: DataFrame, scorer: Scorer, threshold: float = 0.1, done: DataFrame | None = None, l2: bool = True,
           **options) -> DataFrame:
    """Sidecar rows of new recordings: file, abs_start_iso, win_start, win_end, embedding, probs, error.

    ``files``: file plus header columns. Files in ``done`` are skipped; one without a parsable start or without samples
    gives a row with that error.
    """
    todo = files if done is None else files.join(done.select("file").distinct(), "file", "left_anti")
    start = text.parse_filename(F.col("file"))["start_datetime"]
    todo = todo.withColumn("__start", start)
    why = F.when(F.col("__start").isNull(), "no start in the name").when(F.coalesce("datalen", F.lit(0)) <= 0, "no samples")
    lost = todo.select("file", why.alias("error")).where("error IS NOT NULL")
    todo = todo.where(why.isNull()).withColumn("shift", timefn.seconds_to_grid(F.col("__start")))
    win = score_files(todo.select("file", "shift", "rate", "datalen"), scorer, **options).unionByName(lost, allowMissingColumns=True)
    probs = F.transform("logits", lambda x: (1 / (1 + F.exp(-x.cast("double")))))
    return (win.withColumn("abs_start_iso", F.date_format(text.parse_filename(F.col("file"))["start_datetime"], "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
            .withColumn("embedding", arrays.l2_normalize(F.col("embedding")).cast("array<float>") if l2 else F.col("embedding"))
            .withColumn("probs", arrays.sparse_pairs(probs, threshold))
            .select("file", "abs_start_iso", "win_start", "win_end", "embedding", "probs", "error"))
