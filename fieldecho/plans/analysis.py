"""Analyses over finished localizations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, geo
from ..operators.ranking import seeded_sample
from ..operators.relate import used_flag
from ..operators.stats import exact_percentiles, histogram
from ..signal import solve
from .localize import _stack, locate_sources, once, spread


def recorder_usage(catalog: DataFrame, results: DataFrame, group: str = "recorder_group") -> DataFrame:
    """First and last recording, file count, hours, and whether any localization used the recorder."""
    table = (catalog.groupBy(group, "recorder")
             .agg(F.min("start_datetime").alias("first_recorded"), F.max("end_datetime").alias("last_recorded"),
                  F.count("*").alias("n_files"), (F.sum("duration") / 3600).alias("total_hours")))
    return used_flag(table, results, group, "recorder", "recorders", "used_in_primary_run")


def used_recorders(results: DataFrame) -> DataFrame:
    """Distinct recorders per group over all events."""
    return results.select("recorder_group", F.explode("recorders").alias("recorder")).distinct()


def candidate_error(candidates: Column, label: str) -> Column:
    """mean_error of the last candidate carrying ``label``."""
    hits = F.filter(candidates, lambda c: c["candidate_label"] == label)
    return F.get(F.transform(hits, lambda c: c["mean_error"]), F.size(hits) - 1)


def rank_versus_top(results: DataFrame, cutoff: float = 0.005) -> DataFrame:
    """Events with a real alternative, at least one of the two under the cutoff: difference of mean errors."""
    both = (results.withColumn("rank0", candidate_error(F.col("candidates"), "rank_0"))
            .withColumn("toppeak", candidate_error(F.col("candidates"), "toppeak_per_pair"))
            .where("rank0 IS NOT NULL AND toppeak IS NOT NULL"))
    return both.where(F.least("rank0", "toppeak") < cutoff).withColumn("diff", F.col("rank0") - F.col("toppeak"))


def clean_subset(results: DataFrame, n: int = 15, min_score: float = 1e-5) -> DataFrame:
    return results.where((F.size("pairs") == F.size("tdoas")) & (F.size("tdoas") == n) & (F.col("best_score") > min_score))


def paired_errors(rerun: DataFrame, baseline: DataFrame) -> DataFrame:
    """Mean errors of a second run against the first, by call id; only calls in both."""
    return (rerun.select("call_id", F.col("mean_error").alias("mean_error_x"))
            .join(baseline.select("call_id", F.col("mean_error").alias("mean_error_y")), "call_id")
            .where("mean_error_x IS NOT NULL AND mean_error_y IS NOT NULL")
            .withColumn("diff", F.col("mean_error_x") - F.col("mean_error_y")))


def consistency_histograms(results: DataFrame, rerun: DataFrame | None = None, exclude: str | None = None) -> DataFrame:
    """The three histograms of geometric consistency in one tidy table, optionally without one species."""
    res = results if exclude is None else results.where(F.col("common_name") != exclude)
    parts = [histogram(res, "mean_error", 0.0, 0.1, 99).withColumn("panel", F.lit("mean_error")),
             histogram(rank_versus_top(res), "diff", -0.1, 0.1, 99).withColumn("panel", F.lit("rank_vs_top"))]
    if rerun is not None:
        parts.append(histogram(paired_errors(rerun, res), "diff", -0.01, 0.01, 24).withColumn("panel", F.lit("rerun")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def high_quality_points(results: DataFrame, centroids: DataFrame, window_m: float, threshold: float = 0.001,
                        species: list[str] | None = None) -> DataFrame:
    """Positions with a small residual inside a square around the group's centroid (strict bounds)."""
    df = results.where(F.col("mean_error") < threshold)
    if species:
        df = df.where(F.col("common_name").isin(species))
    df = df.withColumn("x", F.col("x_est")[0]).withColumn("y", F.col("x_est")[1])
    half = window_m / 2
    return (df.join(centroids, "recorder_group")
            .where((F.abs(F.col("x") - F.col("cx")) < half) & (F.abs(F.col("y") - F.col("cy")) < half)))


def complete_pairs(results: DataFrame) -> DataFrame:
    """At least four recorders, every pair present, no index beyond the recorder list."""
    n = F.size("recorders")
    top = F.array_max(F.transform("pairs", lambda p: F.greatest(p["i"], p["j"])))
    return results.where((n >= 4) & (F.size("pairs") == n * (n - 1) / 2) & (F.coalesce(top, F.lit(-1)) < n))


def _svd_udf():
    @F.pandas_udf("cond double, s_min double, s_max double, worst_axis int, worst_z double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for a, b, x in batches:
            count = a.map(len).to_numpy() // 3
            width = max(3, int(count.max()))
            flat = lambda s: _stack(s, 3 * width).reshape(len(s), width, 3)
            mask = np.arange(width) < count[:, None]
            cond, lo, hi, axis, z = solve.conditioning(flat(a), flat(b), np.array(x.tolist(), float), mask)
            few = count < 3
            yield pd.DataFrame({"cond": np.where(few, np.inf, cond), "s_min": np.where(few, 0.0, lo),
                                "s_max": pd.Series(hi, dtype="Float64").mask(few), "worst_axis": np.where(few, -1, axis),
                                "worst_z": pd.Series(z, dtype="Float64").mask(few)})
    return once(run)


def identifiability(df: DataFrame, coords: str = "coords", pairs: str = "pairs", x: str = "x_est") -> DataFrame:
    """Condition of the position Jacobian over the in-range pairs; fewer than three give infinity."""
    n = F.size(coords)
    good = F.filter(pairs, lambda p: (p["i"] < n) & (p["j"] < n))
    side = lambda s: F.flatten(F.transform("__p", lambda p: F.get(F.col(coords), p[s])))
    return (df.withColumn("__p", good).withColumn("n_pairs_used", F.size("__p"))
            .withColumn("__s", _svd_udf()(side("i"), side("j"), F.col(x))).select("*", "__s.*").drop("__s", "__p"))


def identifiability_summary(scores: DataFrame, by: list[str] = (), cond_max: float = 1e4) -> DataFrame:
    """Size, exact median / p90 / p99 of the condition, share identifiable, infinite count.

    Overall (no ``by``) the percentiles leave infinities out; by group they keep them.
    """
    by = list(by)
    finite = scores if by else scores.where(F.abs("cond") != float("inf"))
    pct = exact_percentiles(finite, by, "cond", {"med": 0.5, "p90": 0.9, "p99": 0.99}).drop("n")
    base = scores.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((F.col("cond") < cond_max).cast("double")).alias("frac_ok"),
        F.count_if(F.col("cond") == float("inf")).alias("n_infinite"))
    if by:
        return base.join(pct, by, "left")
    one = lambda d: d.withColumn("__k", F.lit(1))
    return one(base).join(one(pct), "__k", "left").drop("__k")


def perturb(df: DataFrame, distances: list[float], seed: int = 0, coords: str = "coords", key: str = "call_id") -> DataFrame:
    """Explode each event over distances; every recorder moves exactly that far in a random direction.

    The direction comes from a hash of (event, distance, recorder, seed): the same on
    every run and machine.
    """
    d = F.col("perturb")
    u = lambda i, salt: (F.pmod(F.xxhash64(F.col(key), d, i, F.lit(f"{seed}-{salt}")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    # height and turn of a point that is uniform on the sphere; lambdas are not compiled, so each draw is made once
    draws = F.transform(F.sequence(F.lit(0), F.size(coords) - 1), lambda i: F.array(2 * u(i, "z") - 1, 2 * np.pi * u(i, "turn")))

    def moved(r: Column, v: Column) -> Column:
        flat = d * F.sqrt(1 - v[0] * v[0])
        return F.array(r[0] + flat * F.cos(v[1]), r[1] + flat * F.sin(v[1]), r[2] + d * v[0])

    return (spread(df, key).withColumn("perturb", F.explode(F.array(*[F.lit(float(x)) for x in distances])))
            .withColumn("__draws", draws).withColumn(coords, F.zip_with(F.col(coords), "__draws", moved)).drop("__draws"))


def perturbation_control(events: DataFrame, distances: list[float] = (0.0, 5.0, 10.0), n: int | None = None,
                         seed: int = 0) -> DataFrame:
    """Re-solve with displaced recorders: residual and movement per (call, distance).

    ``events``: call_id, coords, pairs, tdoas, x_est, c_est, mean_error.
    """
    df = events if n is None else seeded_sample(events, ["call_id"], n, seed)
    df = perturb(df.withColumnRenamed("x_est", "x_ref").withColumnRenamed("mean_error", "__stored")
                 .withColumnRenamed("c_est", "__c"), list(distances), seed)
    out = locate_sources(df, pairs="pairs", speed="__c")
    moved = lambda k: geo.distance(F.slice("x_est", 1, k), F.slice("x_ref", 1, k))
    return out.select("call_id", "perturb", (F.col("mean_error") * 1000).alias("resid_ms"), moved(3).alias("moved_m"),
                      moved(2).alias("moved_h"), (F.col("__stored") * 1000).alias("stored_ms"))


def perturbation_summary(solves: DataFrame, reproduced_m: float = 0.5) -> DataFrame:
    """Medians per distance over the calls whose undisturbed solve came back to the stored position."""
    ok = solves.where((F.col("perturb") == 0) & (F.col("moved_m") < reproduced_m)).select("call_id").distinct()
    kept = solves.join(ok, "call_id", "left_semi")
    rows = kept.select("perturb", F.inline(F.array(*[
        F.struct(F.lit(c).alias("what"), F.col(c).alias("v")) for c in ("resid_ms", "moved_m", "moved_h")])))
    pct = exact_percentiles(rows, ["perturb", "what"], "v", {"med": 0.5, "p90": 0.9})
    pick = lambda what, col: F.max(F.when(F.col("what") == what, F.col(col)))
    wide = pct.groupBy("perturb").agg(
        pick("resid_ms", "med").alias("med_resid_ms"), pick("moved_m", "med").alias("med_moved_m"),
        pick("moved_h", "med").alias("med_moved_h"), pick("moved_h", "p90").alias("p90_moved_h"))
    calls = kept.groupBy("perturb").agg(F.countDistinct("call_id").alias("n_calls"))
    return wide.join(calls, "perturb")


def species_counts(results: DataFrame, threshold: float = 0.001) -> DataFrame:
    """Localized calls per species under the residual threshold, and their median error."""
    good = results.where(F.col("mean_error") < threshold)
    return exact_percentiles(good, ["common_name"], "mean_error", {"median_error": 0.5})


def mean_abs_error(errors: Column) -> Column:
    return arrays.mean_abs(errors)
