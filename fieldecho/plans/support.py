"""When do aligned recorders agree: support over time per pair, and its peaks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..signal import spectra
from .localize import spread


def temporal_support(clips: DataFrame, rate: int, smooth_ms: float = 10.0, points: int = 400, key: str = "call_id") -> DataFrame:
    """``clips``: key, recorder, samples (aligned) -> key, ri, rj, t, support. One group is one event."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("recorder").reset_index(drop=True)
        env = [spectra.envelope(np.asarray(y, float)) for y in pdf["samples"]]
        rows = []
        for i in range(len(env)):
            for j in range(i + 1, len(env)):
                m = min(len(env[i]), len(env[j]))
                rows.append((pdf[key][0], pdf["recorder"][i], pdf["recorder"][j], np.linspace(0, m - 1, points) / rate,
                             spectra.support(env[i], env[j], rate, smooth_ms, points)))
        return pd.DataFrame(rows, columns=[key, "ri", "rj", "t", "support"])
    return spread(clips.select(key, "recorder", "samples"), key).groupBy(key).applyInPandas(
        run, f"{key} {dict(clips.dtypes)[key]}, ri string, rj string, t array<double>, support array<double>")


def support_peaks(support: DataFrame, threshold: float = 0.25, min_gap_s: float = 0.25, top: int | None = None, key: str = "call_id") -> DataFrame:
    """Peak times of the mean support across an event's pairs, tallest first; with ``top`` no more than so many."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, t = np.mean(np.stack(pdf["support"].to_list()), 0), np.asarray(pdf["t"].iloc[0])
        gap = max(1, round(min_gap_s / float(np.median(np.diff(t))))) if len(t) > 1 else 1
        pk = spectra.find_peaks(w, threshold, 0.0, gap)
        pk = pk[np.argsort(-w[pk], kind="stable")][:top]
        return pd.DataFrame({key: pdf[key].iloc[0], "peak_rank": np.arange(len(pk), dtype="int32"),
                             "t": t[pk], "height": w[pk]})
    return support.groupBy(key).applyInPandas(run, f"{key} {dict(support.dtypes)[key]}, peak_rank int, t double, height double")
