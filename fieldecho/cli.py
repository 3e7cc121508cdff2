"""``python -m fieldecho <command>``: each command is one Spark job over stored tables."""

from __future__ import annotations

import argparse
import importlib
import time

from pyspark.sql import functions as F

from . import sinks
from .config import load_config
from .functions import text, timefn
from .functions.text import species_from_clip_name
from .operators.relate import pending
from .plans import analysis, archive, catalog, deployments, detections, inference, localize, profiles, weather
from .session import get_session
from .sources import audio, tables


def _catalog(spark, cfg, a):
    files = audio.list_files(spark, a.roots or list(cfg.topdirs))
    done = tables.read_if_present(spark, f"{a.drafts}") if not a.force else None
    side = catalog.sidecar_rows(catalog.read_sidecars(files), files)
    zones = tables.read_zones(spark, a.zones) if a.zones else None
    new = catalog.index(files, zones, side, done.select("dir") if done is not None else None)
    new.write.mode("overwrite" if a.force else "append").parquet(a.drafts)
    dep = spark.read.parquet(a.deployments) if a.deployments else None
    sinks.write_catalog(catalog.build(spark.read.parquet(a.drafts), dep), a.out)


def _deployments(spark, cfg, a):
    dep = tables.read_deployments(spark, a.csv, cfg.timezone)
    if a.catalog:
        dep = deployments.fill_missing_gps(dep, spark.read.parquet(a.catalog))
    if a.raster and a.raster.lower().endswith((".tif", ".tiff")):
        dep = deployments.add_elevation_of(dep, a.raster)
    elif a.raster:
        dep = deployments.add_elevation(dep, spark.read.parquet(a.raster), a.west, a.north, a.step, a.nodata)
    dep.write.mode("overwrite").parquet(a.out)


def _candidates(spark, cfg, a):
    cat = spark.read.parquet(a.catalog or cfg.catalog)
    labels = tables.flag_site_species(tables.read_labels(spark, a.labels or cfg.labels_path),
                                      tables.read_site_species(spark, cfg.site_species) if cfg.site_species else None)
    out = detections.run(tables.window_sidecars(spark, a.roots or list(cfg.topdirs)), labels, cat, cfg.timezone, a.strategy, cfg.thresholds,
                         a.groups, a.recorder_types, {"date_start": a.date_start, "date_end": a.date_end})
    out.write.mode("overwrite").parquet(a.out)


def _profiles(spark, cfg, a):
    if a.source == "merge":
        out = profiles.merge_profiles(spark.read.parquet(a.primary), spark.read.parquet(a.fallback))
    else:
        if a.source == "detections":
            req = profiles.best_detections(spark.read.parquet(a.detections), a.top_n, a.min_prob)
        else:
            lib = profiles.reference_clips(audio.list_files(spark, [a.clips]), species_from_clip_name(F.col("file")), a.max_clips)
            req = lib.withColumn("h", audio.wav_header("file")).select("*", "h.rate", F.lit(0).alias("first_sample"), F.col("h.datalen").alias("n_samples"))
        out = profiles.profile_table(audio.read_clips(req, cfg.sample_rate, ["birdcode"]), cfg.sample_rate)
    out.write.mode("overwrite").parquet(a.out)


def _weather(spark, cfg, a):
    if a.json:
        out = weather.hourly(tables.read_weather_json(spark, a.json), cfg.timezone, a.source)
    else:
        span = spark.createDataFrame([(a.start, a.end)], "a string, b string")
        got = tables.fetch_weather(timefn.year_chunks(span, "a", "b").repartition("year"), cfg.lat, cfg.lon, source=a.source)
        out = weather.hourly(got.select("hourly"), cfg.timezone, a.source)
    out.write.mode("overwrite").parquet(a.out)


def _speed(spark, cfg, a):
    cand, w = spark.read.parquet(a.candidates), spark.read.parquet(a.weather)
    out = weather.reattach_speed(cand, w) if "speed" in cand.columns else weather.attach_speed(cand, w)
    out.write.mode("overwrite").parquet(a.out)


def _localize(spark, cfg, a):
    cand = spark.read.parquet(a.candidates)
    if a.groups:
        cand = cand.where(F.col("recorder_group").isin(a.groups))
    if a.limit:
        cand = cand.orderBy("event_id").limit(a.limit)
    old = tables.read_if_present(spark, a.out)
    if old is not None:
        cand = pending(cand, localize.results_of(old), localize.errors_of(old), retry_errors=a.retry_errors)
    cat = spark.read.parquet(a.catalog or cfg.catalog)
    if a.recorder_types:
        cat = cat.where(F.col("recorder_type").isin(a.recorder_types))
    conf = localize.LocalizeConfig(rate=cfg.sample_rate, clip_seconds=a.winsize, lead_seconds=a.dt_in_win, qualcut=a.qualcut,
                                   max_peaks_per_pair=a.max_peaks_per_pair, fit_speed=not a.fixed_speed, max_outlier_pairs=a.max_outlier_pairs,
                                   shallow_cap=a.outlier_shallow_cap, most_blocks=a.most_blocks)
    req = localize.clip_requests(localize.active_files(cand, cat), conf)
    placed = deployments.match(req, deployments.with_metres(spark.read.parquet(a.deployments), a.utm_zone), "call_datetime", ["x", "y", "z"])
    lost = deployments.unplaced(placed, localize.KEY)
    placed = placed.join(lost.select(localize.KEY), localize.KEY, "left_anti")
    clips = audio.read_clips(placed, conf.rate, ["event_id", "recorder", "x", "y", "z"])
    prof = localize.attach_profiles(cand.select("event_id", "common_name"), spark.read.parquet(a.profiles))
    clips = clips.join(prof.select("event_id", "freqs", "profile"), "event_id", "left")
    outcomes = localize.localize(clips, cand.join(lost, localize.KEY, "left_anti"), conf)
    sinks.append_run(outcomes.unionByName(cand.join(lost, localize.KEY), allowMissingColumns=True), a.out, a.run_id)
    sinks.record_invocation(spark, f"{a.out.rstrip('/')}-invocations")


def _infer(spark, cfg, a):
    """Score recordings not in the manifest; windows are appended in shards, failures among them with their error."""
    from pyspark import cloudpickle
    module, _, name = a.scorer.partition(":")
    home = importlib.import_module(module)
    cloudpickle.register_pickle_by_value(home)  # executors need not have the module
    files = audio.list_files(spark, a.roots or list(cfg.topdirs)).where(text.has_extension(F.col("file"), "wav"))
    done = spark.read.json(a.manifest) if tables.exists(spark, a.manifest) else None
    todo = files.select("file") if done is None else files.select("file").join(done.select("file").distinct(), "file", "left_anti")
    waves = sinks.stored(todo.withColumn("h", audio.wav_header("file")).select("file", "h.rate", "h.datalen"), f"{a.manifest.rstrip('/')}-steps", "headers",
                         {"run": time.time_ns()})
    sinks.write_windows(inference.detect(waves, getattr(home, name), a.threshold, rate=a.rate, low=a.low, mode=a.mode), a.out, a.shard_rows)
    sinks.write_manifest(waves, a.manifest)
    sinks.record_invocation(spark, f"{a.out.rstrip('/')}-invocations", scorer=a.scorer)


def _prepare(spark, cfg, a):
    """What localization needs besides the candidates: species profiles from the surest detections, and the speed of sound per call."""
    req = profiles.best_detections(spark.read.parquet(a.detections), a.top_n, a.min_prob)
    profiles.profile_table(audio.read_clips(req, cfg.sample_rate, ["birdcode"]), cfg.sample_rate).write.mode("overwrite").parquet(f"{a.out_dir}/profiles")
    cand = spark.read.parquet(a.candidates)
    if a.weather:
        hours = spark.read.parquet(a.weather)
    else:
        span = cand.agg(F.date_format(F.min("call_datetime"), "yyyy-MM-dd").alias("a"), F.date_format(F.max("call_datetime"), "yyyy-MM-dd").alias("b"))
        hours = weather.hourly(tables.fetch_weather(timefn.year_chunks(span, "a", "b").repartition("year"), cfg.lat, cfg.lon).select("hourly"), cfg.timezone, "hrrr")
        hours.write.mode("overwrite").parquet(f"{a.out_dir}/weather")
        hours = spark.read.parquet(f"{a.out_dir}/weather")
    weather.attach_speed(cand, hours).write.mode("overwrite").parquet(f"{a.out_dir}/candidates")


def _sun(spark, cfg, a):
    timefn.sun_table(spark, a.lat or cfg.lat, a.lon or cfg.lon, a.date_start, a.date_end).write.mode("overwrite").parquet(a.out)


def _archive(spark, cfg, a):
    cat = spark.read.parquet(a.catalog) if a.catalog else None
    plan = archive.scan(audio.list_files(spark, [a.scan]), cat, tables.read_zones(spark, a.zones) if a.zones else None)
    archive.report(plan).show()
    if a.moves:
        archive.move_list(plan).write.mode("overwrite").json(a.moves)


def _ingest(spark, cfg, a):
    files = audio.list_files(spark, [a.card]).withColumn("card", F.lit(a.card.rstrip("/"))).withColumn("dest", F.lit(a.dest))
    archive.card_identity(files).join(archive.card_dates(files), "card").show(truncate=False)
    jobs = archive.card_plan(files, "dest")
    archive.card_totals(jobs).show()
    if a.jobs:
        jobs.write.mode("overwrite").json(a.jobs)


def _identifiability(spark, cfg, a):
    res = spark.read.parquet(a.run)
    scores = analysis.identifiability(res.where("x_est IS NOT NULL"), pairs="pairs_used").withColumn("nrec", F.size("recorders_all"))
    sinks.write_csv(scores.select("call_id", "recorder_group", "nrec", "cond", "s_min", "s_max", "worst_axis", "worst_z", "n_pairs_used", "mean_error"), a.out)
    for by in ([], ["nrec"], ["recorder_group"]):
        analysis.identifiability_summary(scores, by, a.cond_max).show()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fieldecho", description=__doc__)
    p.add_argument("--config")
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, fn, *options):
        c = sub.add_parser(name)
        c.set_defaults(fn=fn)
        for opt, kw in options:
            c.add_argument(opt, **kw)

    req, many = {"required": True}, {"nargs": "*"}
    num = lambda d: {"type": float, "default": d}
    whole = lambda d: {"type": int, "default": d}
    flag = {"action": "store_true"}
    command("catalog", _catalog, ("--roots", many), ("--drafts", req), ("--out", req), ("--zones", {}), ("--deployments", {}), ("--force", flag))
    command("deployments", _deployments, ("--csv", req), ("--out", req), ("--catalog", {}), ("--raster", {}), ("--west", num(None)),
            ("--north", num(None)), ("--step", num(None)), ("--nodata", num(None)))
    command("candidates", _candidates, ("--roots", many), ("--out", req), ("--catalog", {}), ("--labels", {}),
            ("--strategy", {"default": "flexible", "choices": ["flexible", "strict"]}), ("--groups", many), ("--recorder-types", many),
            ("--date-start", {}), ("--date-end", {}))
    command("profiles", _profiles, ("source", {"choices": ["reference", "detections", "merge"]}), ("--out", req), ("--detections", {}), ("--clips", {}),
            ("--primary", {}), ("--fallback", {}), ("--top-n", whole(20)), ("--min-prob", num(0.7)), ("--max-clips", whole(None)))
    command("weather", _weather, ("--out", req), ("--json", {}), ("--start", {}), ("--end", {}), ("--source", {"default": "hrrr"}))
    command("speed", _speed, ("--candidates", req), ("--weather", req), ("--out", req))
    command("localize", _localize, ("--candidates", req), ("--profiles", req), ("--deployments", req), ("--out", req), ("--catalog", {}), ("--groups", many),
            ("--recorder-types", many), ("--winsize", num(5.0)), ("--dt-in-win", num(1.0)), ("--qualcut", num(0.1)), ("--limit", whole(None)),
            ("--max-peaks-per-pair", whole(None)), ("--fixed-speed", flag), ("--max-outlier-pairs", whole(None)), ("--outlier-shallow-cap", whole(2)),
            ("--most-blocks", whole(None)), ("--utm-zone", whole(15)), ("--run-id", whole(1)), ("--retry-errors", flag))
    command("infer", _infer, ("--scorer", req), ("--out", req), ("--manifest", req), ("--roots", many), ("--threshold", num(0.1)), ("--rate", whole(48000)),
            ("--low", num(150.0)), ("--mode", {"default": "file-percentile", "choices": list(inference.NORMALIZATIONS)}), ("--shard-rows", whole(200_000)))
    command("prepare", _prepare, ("--candidates", req), ("--detections", req), ("--out-dir", req), ("--weather", {}), ("--top-n", whole(20)), ("--min-prob", num(0.9)))
    command("sun", _sun, ("--out", req), ("--lat", num(None)), ("--lon", num(None)), ("--date-start", req), ("--date-end", req))
    command("archive", _archive, ("--scan", req), ("--catalog", {}), ("--zones", {}), ("--moves", {}))
    command("ingest", _ingest, ("--card", req), ("--dest", req), ("--jobs", {}))
    command("identifiability", _identifiability, ("--run", req), ("--out", req), ("--cond-max", num(1e4)))
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.fn(get_session(f"fieldecho-{a.command}", a.master), load_config(a.config), a)
