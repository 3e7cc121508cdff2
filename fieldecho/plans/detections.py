"""Classifier windows -> detections -> concordance -> candidate events, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions import text, timefn
from ..functions.timefn import DAY, SECOND, micros
from ..operators import concordance as conc
from ..operators.intervals import coalesce_intervals, stab_join, step_counts
from ..operators.ranking import top_n
from ..operators.relate import attach_labels, join_by_basename


def explode_windows(windows: DataFrame) -> DataFrame:
    """One row per (window, class); windows without detections fall out. Embeddings are not read."""
    return (windows.select("file", "abs_start_iso", "win_start", "win_end", F.explode("probs").alias("p"))
            .select("file", "abs_start_iso", "win_start", "win_end", "p.class_idx", "p.prob"))


def join_catalog(det: DataFrame, catalog: DataFrame, zone: str) -> DataFrame:
    """Add the recording's columns and the exact, rounded and wall-clock call times."""
    out = join_by_basename(det, catalog)
    at = micros(timefn.add_seconds(F.col("start_datetime"), F.col("win_start")))
    local = F.from_utc_timestamp(F.col("call_datetime"), zone)
    return (out.withColumn("call_datetime", F.timestamp_micros(at))
            .withColumn("call_datetime_r", F.timestamp_micros(timefn.round_to_second(at)))
            .withColumn("date", F.to_date(local)).withColumn("time_in_day", timefn.time_in_day(local)))


def filter_detections(det: DataFrame, zone: str = "UTC", require_gps_sync: bool = True,
                      site_species_only: bool = True, date_start: str | None = None,
                      date_end: str | None = None, recorder_types: list[str] | None = None,
                      recorder_groups: list[str] | None = None) -> DataFrame:
    """Composable predicates; dates are site-zone days, end exclusive."""
    out = det.where("call_datetime IS NOT NULL")
    if require_gps_sync:
        out = out.where("gps_sync")
    if site_species_only:
        out = out.where("site_species")
    midnight = lambda d: F.to_utc_timestamp(F.lit(d).cast("timestamp"), zone)
    if date_start:
        out = out.where(F.col("call_datetime") >= midnight(date_start))
    if date_end:
        out = out.where(F.col("call_datetime") < midnight(date_end))
    if recorder_types:
        out = out.where(F.col("recorder_type").isin(recorder_types))
    if recorder_groups:
        out = out.where(F.col("recorder_group").isin(recorder_groups))
    return out


def active_steps(catalog: DataFrame, gap_seconds: float = 10.0) -> DataFrame:
    """Segments (group, lo, hi, n) during which ``n`` recorders were running."""
    rec = (catalog.where("recorder_group IS NOT NULL AND recorder IS NOT NULL")
           .select("recorder_group", "recorder", micros(F.col("start_datetime")).alias("lo"),
                   micros(F.col("end_datetime")).alias("hi")))
    merged = coalesce_intervals(rec, ["recorder_group", "recorder"], gap=int(gap_seconds * SECOND))
    return step_counts(merged, ["recorder_group"])


def count_active(concordance: DataFrame, catalog: DataFrame, gap_seconds: float = 10.0) -> DataFrame:
    """Add ``n_active_recorders`` at each call second; 0 when nobody was recording.

    Segments are disjoint, so each call finds at most one: no aggregate on the calls.
    """
    steps = active_steps(catalog, gap_seconds)
    out = stab_join(concordance.withColumn("__t", micros(F.col("call_datetime_r"))), steps,
                    ["recorder_group"], "__t", width=DAY, open_ended=False)
    return out.withColumn("n_active_recorders", F.coalesce("n", F.lit(0))).drop("n", "lo", "hi", "__t")


def select_candidates(counts: DataFrame, strategy: str = "flexible", thresholds: Thresholds = Thresholds(),
                      recorder_groups: list[str] | None = None, date_start: str | None = None,
                      date_end: str | None = None, zone: str = "UTC", min_max_prob: float | None = None,
                      min_active_recorders: int | None = None, min_concordant_recs: int | None = None,
                      max_per_species: int | None = None, strict_agreement_fraction: float | None = None) -> DataFrame:
    """Keep events many recorders agree on. Dates are compared in UTC; ids use the site zone."""
    if strategy not in ("flexible", "strict"):
        raise ValueError(f"strategy must be 'flexible' or 'strict', got {strategy!r}")
    pick = lambda given, default: default if given is None else given
    probs = sorted(thresholds.concordance_probs, reverse=True)
    df = (counts.withColumnRenamed(conc.count_name(probs[0]), "ngoodrecs_high"))
    low = "ngoodrecs_high" if len(probs) == 1 else conc.count_name(probs[-1])
    df = df.withColumn("ngoodrecs", F.col(low))
    if recorder_groups is not None:
        df = df.where(F.col("recorder_group").isin(recorder_groups))
    active = F.col("n_active_recorders")
    df = df.where(active >= pick(min_active_recorders, thresholds.min_active_recorders))
    if strategy == "flexible":
        df = df.where((F.col("maxp") >= pick(min_max_prob, thresholds.flexible_min_max_prob))
                      & (F.col("ngoodrecs") >= pick(min_concordant_recs, thresholds.flexible_min_concordant_recs)))
    else:
        fraction = pick(strict_agreement_fraction, thresholds.strict_agreement_fraction)
        df = df.where(F.col("ngoodrecs_high") >= F.greatest(F.lit(1), F.bround(active * F.lit(float(fraction)))))
    day = lambda d: F.lit(d).cast("timestamp")
    if date_start:
        df = df.where(F.col("call_datetime_r") >= day(date_start))
    if date_end:
        df = df.where(F.col("call_datetime_r") < day(date_end))
    cap = pick(max_per_species, thresholds.flexible_max_per_species)
    if strategy == "flexible" and cap:
        df = top_n(df, ["recorder_group", "common_name"],
                   [F.col("ngoodrecs").desc(), F.col("maxp").desc(), F.col("call_datetime_r")], cap)
    name = F.col("common_name")
    return df.select("common_name", text.birdcode(name).alias("birdcode"), "call_datetime_r", "call_datetime",
                     "recorder_group", text.call_id(name, F.col("recorder_group"), F.col("call_datetime_r"), zone).alias("call_id"),
                     "maxp", "ngoodrecs", "ngoodrecs_high", "n_active_recorders",
                     F.concat_ws("|", name, F.coalesce("recorder_group", F.lit("")), micros(F.col("call_datetime_r"))).alias("event_id"))


def duplicate_call_ids(candidates: DataFrame) -> DataFrame:
    """Ids used more than once: local-time ids repeat in the autumn clock change."""
    return candidates.groupBy("call_id").agg(F.count("*").alias("n")).where("n > 1")


def run(windows: DataFrame, labels: DataFrame, catalog: DataFrame, zone: str, strategy: str = "flexible",
        thresholds: Thresholds = Thresholds(), groups: list[str] | None = None, types: list[str] | None = None,
        filters: dict | None = None, selection: dict | None = None) -> DataFrame:
    """Windows to candidates. Nothing is materialised between the steps."""
    scoped = catalog
    if groups:
        scoped = scoped.where(F.col("recorder_group").isin(groups))
    if types:
        scoped = scoped.where(F.col("recorder_type").isin(types))
    det = join_catalog(attach_labels(explode_windows(windows), labels), scoped, zone)
    det = filter_detections(det, zone, recorder_groups=groups, recorder_types=types, **(filters or {}))
    counts = count_active(conc.concordance(det, thresholds.concordance_probs), scoped)
    return select_candidates(counts, strategy, thresholds, recorder_groups=groups, zone=zone, **(selection or {}))
