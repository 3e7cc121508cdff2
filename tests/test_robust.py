"""Hard inputs: unusable clips, unplaced recorders, singular systems, narrow values, ties of the peak search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldecho.operators import concordance, intervals, stats
from fieldecho.plans import deployments, localize
from fieldecho.plans.profiles import profile_table
from fieldecho.signal import combos, solve, spectra


def test_empty_clip_has_no_transform():
    with pytest.raises(ValueError):
        spectra.fast_len(0)
    assert spectra.fast_len(1) == 2


@pytest.mark.parametrize("n", [40, 41, 64])
@pytest.mark.parametrize("max_lag", [None, 0.0, 0.35, 0.4, 9.0])
def test_correlation_against_its_formula(n, max_lag):
    rng = np.random.default_rng(n)
    a, b = rng.normal(size=20), rng.normal(size=20)
    size, rate = spectra.fast_len(2 * 20 - 1), 10
    got, lags, qual = spectra.correlate(spectra.spectrum(a, size, rate), spectra.spectrum(b, size, rate), size, rate, max_lag)
    want = np.array([sum(a[t + k] * b[t] for t in range(20) if 0 <= t + k < 20) if max_lag is None or abs(k / rate) <= max_lag else 0.0 for k in np.round(lags * rate).astype(int)])
    assert np.allclose(got, want / np.abs(want).max()) and qual == pytest.approx(np.abs(got[np.abs(got) > 0]).std())


@pytest.mark.parametrize("m,ms", [(50, 200.0), (50, 300.0), (7, 900.0), (1, 10.0)])
def test_support_against_its_formula(m, ms):
    rng = np.random.default_rng(m)
    a, b = rng.uniform(size=m), rng.uniform(size=m + 3)
    width = max(1, int(ms / 1000 * 20))
    s = a * b[:m]
    if m >= width:
        s = np.array([sum(s[j] for j in range(i + (width - 1) // 2 - width + 1, i + (width - 1) // 2 + 1) if 0 <= j < m) / width for i in range(m)])
    want = np.interp(np.linspace(0, m - 1, 31), np.arange(m), np.clip(s / np.percentile(s, 99), 0, 1.5))
    assert np.allclose(spectra.support(a, b, 20, ms, 31), want)


def test_both_peak_searches_choose_alike(monkeypatch):
    rng = np.random.default_rng(1)
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    for _ in range(60):
        peaks = [np.round(rng.integers(-2, 3, rng.integers(1, 4)) * 0.5, 3) for _ in pairs]
        allowed, tri = [np.arange(len(p)) for p in peaks], combos.triangle_rows(pairs)
        for changed in (None, 2):
            whole = combos.search(peaks, allowed, tri, 3, changed)
            monkeypatch.setattr(combos, "GRID", 0)
            assert combos.search(peaks, allowed, tri, 3, changed) == whole
            monkeypatch.undo()
    monkeypatch.setattr(combos, "GRID", 0)
    with pytest.raises(RuntimeError):
        combos.search(peaks, allowed, tri, 1, None, most_blocks=2)


def test_one_broken_event_does_not_spoil_its_batch():
    rng = np.random.default_rng(0)
    rec = np.array([[0, 0, 0], [60, 0, 20], [0, 60, 25], [60, 60, 2], [30, -20, 30]], float)
    i, j = np.triu_indices(5, 1)
    src = rng.uniform(10, 40, (3, 3))
    toa = np.linalg.norm(rec[None] - src[:, None], axis=2) / 343
    a, b, dt = np.repeat(rec[i][None], 3, 0), np.repeat(rec[j][None], 3, 0), toa[:, i] - toa[:, j]
    a[1] = np.nan
    box = [np.repeat(v[None], 3, 0) for v in (rec.min(0), rec.max(0), rec.mean(0))]
    x, _, _, _, done = solve.locate(a, b, dt, np.ones_like(dt, bool), *box, np.full(3, 343.0))
    assert np.allclose(x[[0, 2]], src[[0, 2]], atol=1e-3) and done[[0, 2]].all()


def test_bad_clips_become_rows(spark):
    rows = [(e, r, x, 0.0, 0.0, y) for e, y0 in (("empty", []), ("nan", [float("nan")] * 9), ("fine", [0.0, 1.0, 0.0, 0.5, 0.0, 0.0, 0.0, 0.0]))
            for r, x, y in (("a", 0.0, y0), ("b", 100.0, [0.0, 0.0, 1.0, 0.0, 0.5, 0.0, 0.0, 0.0]), ("c", 200.0, None))] + [("none", "a", 0.0, 0.0, 0.0, None), ("twice", "a", 0.0, 0.0, 0.0, [1.0]), ("twice", "a", 0.0, 0.0, 0.0, [1.0])]
    clips = spark.createDataFrame(rows, "event_id string, recorder string, x double, y double, z double, samples array<double>")
    got = {r["event_id"]: r for r in localize.correlate_events(clips, localize.LocalizeConfig(rate=10, use_profile=False, fallback_to_max=True)).collect()}
    assert got["empty"]["clips_unread"] == ["a", "c"] and got["none"]["clips_unread"] == ["a"] and got["none"]["clip_error"] is None
    assert "finite" in got["nan"]["clip_error"] and "not unique" in got["twice"]["clip_error"] and got["fine"]["pairs"][0]["peaks"][0]["tdoa"] == -0.1
    events = clips.select("event_id").distinct().withColumn("speed", F.lit(343.0))
    out = {r["event_id"]: r["error_type"] for r in localize.errors_of(localize.localize(clips, events, localize.LocalizeConfig(rate=10, use_profile=False))).collect()}
    assert out == {"empty": "ValueError", "none": "ValueError", "fine": "ValueError", "nan": "ClipError", "twice": "ClipError"}


def test_unplaced_recorders_are_named(spark):
    at = "2024-01-01 00:00:00"
    dep = spark.createDataFrame([("a", at, at, 1.0, 0)], "recorder string, begin string, end string, x double, ord int").withColumn("begin", F.col("begin").cast("timestamp")).withColumn("end", F.col("end").cast("timestamp"))
    points = spark.createDataFrame([("e", "a", at), ("e", "b", at), ("f", "a", at), ("g", "a", "2025-01-01 00:00:00")], "event_id string, recorder string, t string").withColumn("t", F.col("t").cast("timestamp"))
    got = deployments.unplaced(deployments.match(points, dep, "t", ["x"]), "event_id").collect()
    assert {(r["event_id"], r["error_type"], r["error_msg"][-1]) for r in got} == {("e", "NoDeployment", "b"), ("g", "NoDeployment", "a")}


def test_open_intervals_reach_points_beyond_them(spark):
    day = intervals.DAY
    iv = spark.createDataFrame([("k", None, 5 * day, "before"), ("k", 9 * day, None, "after"), ("m", None, None, "always")], "k string, lo long, hi long, name string")
    points = spark.createDataFrame([("k", t * day + 1) for t in (-4000, 0, 4, 5, 8, 9, 90000)] + [("m", -7), ("m", 4000 * day)], "k string, t long")
    got = {(r["k"], r["t"]): r["name"] for r in intervals.stab_join(points, iv, ["k"], "t", width=day).collect()}
    want = {(k, t): "always" if k == "m" else "before" if t < 5 * day else "after" if t >= 9 * day else None for k, t in got}
    assert got == want and len(got) == 9


def test_narrow_values_spread_over_buckets(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), (343.0 + F.col("id") * 1e-5).alias("v"))
    bucket = stats._value_bucket(F.col("v"))
    held = df.groupBy(bucket.alias("b")).agg(F.min("v").alias("lo"), (F.max("v") - F.min("v")).alias("wide"))
    fine = df.withColumn("b", bucket).join(held, "b").groupBy("b", stats._fine(F.col("v"), F.col("lo"), F.col("wide")).alias("f")).count()
    assert fine.agg(F.max("count")).first()[0] <= 20_000 / 100
    got = stats.exact_percentiles(df, ["k"], "v", {"m": 0.5, "q": 0.9}).first()
    assert got["m"] == pytest.approx(343.0 + 9999.5e-5) and got["q"] == pytest.approx(343.0 + 17999.1e-5)
    odd = spark.createDataFrame([(v,) for v in (float("inf"), float("-inf"), 0.0, -0.0, 1e-300, 1.7e308, -1.7e308, float("nan"), None)], "v double")
    assert stats.exact_percentiles(odd, [], "v", {"m": 0.5}).first()["n"] == 7


def test_earliest_time_counts_rows_without_recorder(spark):
    det = spark.createDataFrame([("w", 5, "G", "a", 0.9, 50), ("w", 5, None, "b", 0.99, 47), ("w", 5, "G", None, 0.95, 45), ("w", 6, None, "b", 0.9, 60)],
                                "common_name string, call_datetime_r long, recorder_group string, recorder string, prob double, call_datetime long")
    got = [tuple(r) for r in concordance.concordance(det, (0.5,)).select("call_datetime_r", "recorder_group", "maxp", "n_p50", "call_datetime", "allmax").collect()]
    assert got == [(5, "G", 0.9, 1, 45, 0.9)]


def test_short_clips_share_the_frequencies(spark):
    rng = np.random.default_rng(3)
    clips = spark.createDataFrame([("w", rng.normal(size=n).tolist()) for n in (5, 20, 64, 200)], "birdcode string, samples array<double>")
    got = profile_table(clips, 8000, nperseg=64, noverlap=32, low=100.0, high=3900.0).first()
    assert len(got["freqs"]) == len(got["specmax"]) == 33 and got["n_clips"] == 4 and got["freqs"][1] == 125.0


def test_unreadable_inputs_are_named(spark, tmp_path):
    from fieldecho.plans import inference
    from fieldecho.sources import audio, tables
    root = tmp_path / "in"
    (root / "a").mkdir(parents=True)
    spark.range(3).write.parquet(str(root / "good"))
    (root / "a" / "emb_1.parquet").write_bytes(b"PAR1 cut short")
    (root / "a" / "gone.wav").symlink_to(root / "nowhere.wav")
    (root / "a" / "S4A00001_20240101_120000.wav").write_bytes(b"RIFF broken")
    files = audio.list_files(spark, [str(root)])
    names = {r["name"] for r in files.collect()}
    assert "emb_1.parquet" in names and "gone.wav" not in names
    assert [(r["path"][-8:], r["reason"]) for r in audio.listing_problems(spark, [str(root), str(tmp_path / "none")]).orderBy("path").collect()] == [("gone.wav", "FileNotFoundError"), (str(tmp_path / "none")[-8:], "FileNotFoundError")]
    bad = tables.parquet_problems(files.where(F.col("name").like("%.parquet"))).collect()
    assert [r["path"][-15:] for r in bad] == ["a/emb_1.parquet"]
    waves = files.where(F.col("name").like("S4A%")).select("file").withColumn("rate", F.lit(100)).withColumn("datalen", F.lit(500))
    got = inference.detect(waves, lambda x, rate: (x, x), rate=100, low=None).collect()
    assert len(got) == 1 and got[0]["error"].startswith("Error") and got[0]["probs"] is None


def test_channels_are_averaged():
    from fieldecho.sources.audio import pcm_to_float
    raw = np.array([[16384, -16384], [32767, 32767]], "<i2").tobytes()
    assert np.allclose(pcm_to_float(raw, 2, 2, None), [0.0, 32767 / 32768]) and pcm_to_float(raw, 2, 2).tolist() == [16384, 32767]
