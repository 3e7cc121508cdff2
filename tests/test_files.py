"""Sources, sinks and whole jobs over small files written here."""

import json
import wave
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldecho import sinks
from fieldecho.config import load_config
from fieldecho.functions import text, timefn
from fieldecho.plans import archive, catalog, deployments, detections, inference, localize, refine
from fieldecho.sources import audio, tables
from fieldecho.streaming import ingest

RATE = 2000
POS = {"BARLT_00000001": (0.0, 0.0, 0.0), "BARLT_00000002": (60.0, 0.0, 20.0), "BARLT_00000003": (0.0, 60.0, 25.0),
       "BARLT_00000004": (60.0, 60.0, 2.0), "BARLT_00000005": (30.0, -20.0, 30.0)}


def write_wav(path, samples, rate=RATE, channels=1):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.asarray(samples, "<i2").tobytes())


@pytest.fixture(scope="module")
def archive_dir(tmp_path_factory):
    """Ten seconds from five recorders; one call from a known source at second 4."""
    root = tmp_path_factory.mktemp("audio")
    rng = np.random.default_rng(1)
    call, src = rng.normal(size=300) * 3000, np.array([22.0, 17.0, 9.0])
    for rec, p in POS.items():
        y = rng.normal(size=10 * RATE) * 5
        k = 4 * RATE + int(round(np.linalg.norm(src - p) / 343 * RATE))
        y[k:k + 300] += call
        write_wav(root / "site" / rec / "S20240105T120000.000000+0000_E20240105T120010.000000+0000_+33.5-93.5.wav", y)
    write_wav(root / "hidden" / "deep" / "S20240105T120000.000000+0000_E20240105T120010.000000+0000_+33.5-93.5.wav", [0] * 10)
    (root / "hidden" / "donotindex.txt").write_text("")
    bad = root / "site" / "BARLT_00000001" / "20240105T130000+0000_REC.wav"
    bad.write_bytes(b"not audio")
    return root


def build(spark, root):
    files = audio.list_files(spark, [str(root)])
    return catalog.index(files), files


def test_index_prunes_reads_headers_and_parses(spark, archive_dir):
    draft, files = build(spark, archive_dir)
    rows = draft.collect()
    assert {r["recorder"] for r in rows} == set(POS) and len(rows) == 5  # hidden and unreadable files fall out
    r = rows[0]
    assert (r["rate"], r["datalen"], r["channels"], r["duration"], r["gps_sync"]) == (RATE, 10 * RATE, 1, 10.0, True)
    bad = catalog.read_headers(files).where("filename LIKE '%_REC.wav'").collect()
    assert len(bad) == 1 and bad[0]["datalen"] is None and bad[0]["recorder"] == "BARLT_00000001"
    done = files.where("dir LIKE '%BARLT_00000003'").select("dir")
    assert catalog.index(files, done=done).count() == 4


def test_clip_reads_pad_both_ends(archive_dir):
    path = str(next(archive_dir.glob("site/BARLT_00000002/*.wav")))
    whole = audio.read_range(path, 0, 10 * RATE)
    got = audio.read_range(path, -50, 100)
    assert (got[:50] == 0).all() and (got[50:] == whole[:50]).all()
    assert (audio.read_range(path, 10 * RATE - 10, 30)[10:] == 0).all()


def test_pcm_widths_and_channel():
    assert audio.pcm_to_float(np.array([1, 2, 3, 4], "<i2").tobytes(), 2, 2).tolist() == [1, 3]
    assert audio.pcm_to_float(bytes([255, 255, 255, 1, 0, 0]), 3, 1).tolist() == [-1, 1]
    assert audio.pcm_to_float(bytes([128, 129]), 1, 1).tolist() == [0, 1]


def test_localize_from_files(spark, archive_dir):
    draft, _ = build(spark, archive_dir)
    cat = catalog.build(draft.withColumn("recorder_group", F.lit("House")))
    events = spark.createDataFrame([("c1", "House", "Wren", 343.0), ("c2", "Other", "Wren", 343.0)],
                                   "call_id string, recorder_group string, common_name string, speed double")
    events = events.withColumn("call_datetime", F.lit("2024-01-05 12:00:04").cast("timestamp"))
    cfg = localize.LocalizeConfig(rate=RATE, clip_seconds=3.0, use_profile=False, qualcut=0.3, peak_min_distance=20, fit_speed=False)
    req = localize.clip_requests(localize.active_files(events, cat), cfg)
    assert req.count() == 5
    clips = audio.read_clips(req, RATE, ["call_id", "recorder"])
    pos = spark.createDataFrame([(k, *v) for k, v in POS.items()], "recorder string, x double, y double, z double")
    out = localize.localize(clips.join(pos, "recorder"), events, cfg, key="call_id").cache()
    good, bad = localize.results_of(out).collect(), localize.errors_of(out).collect()
    assert [r["call_id"] for r in good] == ["c1"] and [r["call_id"] for r in bad] == ["c2"]
    r = good[0]
    assert np.linalg.norm(np.array(r["x_est"]) - [22, 17, 9]) < 1.0 and r["mean_error"] < 5e-4
    assert r["recorders"] == sorted(POS) and len(r["pairs_used"]) == 10 and r["total_peak_combos"] >= 1
    assert set(r["tdoa_errors"]) == {f"{a}|{b}" for a in POS for b in POS if a < b}
    assert np.allclose(sum(r["recorder_errors"]), 0, atol=1e-9)


def test_amplitude_weighting_demotes_a_contradicting_peak(spark):
    """The later recorder must be the quieter one: the taller but contradicting peak ranks second."""
    rate, n = 1000, 3000
    w = np.random.default_rng(0).normal(size=120)
    a, b = np.zeros(n), np.zeros(n)
    b[1000:1120] = w
    a[1100:1220] += 3.0 * w      # later and louder: contradicts
    a[950:1070] += 2.9 * w       # earlier and louder: agrees
    clips = spark.createDataFrame([("c", "r1", 0.0, 0.0, 0.0, a.tolist()), ("c", "r2", 60.0, 0.0, 0.0, b.tolist())],
                                  "call_id string, recorder string, x double, y double, z double, samples array<float>")
    cfg = localize.LocalizeConfig(rate=rate, use_profile=False, peak_min_distance=20, peak_min_height=0.5)
    first = lambda c: localize.pair_rows(localize.correlate_events(clips, c, "call_id"), "call_id").collect()[0]["peaks"][0]["tdoa"]
    assert first(cfg) == pytest.approx(0.1)
    assert first(replace(cfg, amplitude_weighting=True, amplitude_seconds=0.05)) == pytest.approx(-0.05)


def test_sidecar_overrides_times(spark, tmp_path):
    folder = tmp_path / "card" / "sub"
    write_wav(folder / "S4A20001_0_20240105_070002_000.wav", [0] * 4000)
    write_wav(folder / "S4A20001_1_20240105_070002_000.wav", [0] * 4000)
    (tmp_path / "card" / "meta.csv").write_text(
        "FOLDER,IN FILE,DATE,TIME,DURATION,LONGITUDE,LATITUDE\nsub,S4A20001_20240105$070000.w4v,2024-01-05,07:00:01,2.0,-93.5,33.7\n")
    files = audio.list_files(spark, [str(tmp_path)])
    side = catalog.sidecar_rows(catalog.read_sidecars(files), files)
    rows = catalog.index(files, sidecar=side).collect()
    assert len(rows) == 2
    for r in rows:
        assert r["timestamp_source"] == "kal_meta" and r["gps_sync"] and r["latitude"] == 33.7
    got = catalog.index(files, sidecar=side).select(F.unix_seconds("start_datetime")).first()[0]
    assert got == 1704456001  # 07:00:01 at the fixed offset is 12:00:01 UTC
    assert catalog.build(catalog.index(files, sidecar=side)).count() == 1


def test_sidecars_go_by_their_own_headers(spark, tmp_path):
    def put(folder, data):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "meta.csv").write_bytes(data)
    put("a", b"FOLDER,IN FILE,DATE,TIME,DURATION,LONGITUDE,LATITUDE\nsub,x.wav,2024-01-05,07:00:01,2.0,-93.5,33.7\n")
    put("b", b"\xef\xbb\xbfTIME,NOTE,DATE,IN FILE,LATITUDE\n08:00:00,\"a, b\",2024-01-06,y.wav,high\n,,,z.wav\n")
    put("c", b"")
    put("d", b"\xff\xfe\xff")
    put("e", b"some,other\n1,2\n")
    files = audio.list_files(spark, [str(tmp_path)])
    rows = {r["IN FILE"]: r for r in catalog.read_sidecars(files).collect()}
    assert sorted(rows) == ["x.wav", "y.wav", "z.wav"]
    assert rows["x.wav"]["FOLDER"] == "sub" and rows["x.wav"]["DURATION"] == 2.0 and rows["x.wav"]["meta_dir"] == str(tmp_path / "a")
    assert str(rows["y.wav"]["DATE"]) == "2024-01-06" and rows["y.wav"]["TIME"] == "08:00:00" and rows["y.wav"]["LATITUDE"] is None
    assert rows["y.wav"]["FOLDER"] is None and rows["z.wav"]["DATE"] is None and rows["z.wav"]["TIME"] is None
    bad = {r["path"].split("/")[-2]: r["reason"] for r in catalog.sidecar_problems(files).collect()}
    assert bad == {"c": "no known column", "d": "UnicodeDecodeError", "e": "no known column"}
    assert catalog.read_sidecars(files.limit(0)).count() == 0


def test_zones_labels_deployments_config(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
    geo = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"name": "RecorderZone_A"}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"type": "Feature", "properties": {"name": "Road"}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"type": "Feature", "properties": {"name": "RecorderZone_B"}, "geometry": {"type": "MultiPolygon", "coordinates": [
            [[[2, 0], [3, 0], [3, 1], [2, 1], [2, 0]], [[2.4, 0.4], [2.6, 0.4], [2.6, 0.6], [2.4, 0.6], [2.4, 0.4]]]]}}]}
    (tmp_path / "z.json").write_text(json.dumps(geo))
    from fieldecho.functions.geo import join_zones
    zones = tables.read_zones(spark, str(tmp_path / "z.json"))
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 0.5), (3, 2.5, 0.5), (4, 2.2, 0.5), (5, None, 0.5), (6, 9.0, 9.0)], "k int, longitude double, latitude double")
    got = {r["k"]: r["recorder_group"] for r in join_zones(pts, zones, cell=0.3).collect()}
    assert got == {1: "A", 2: None, 3: None, 4: "B", 5: None, 6: None}

    (tmp_path / "labels.txt").write_text("Aa bb_Wren\n\nCc dd_Odd_Name, x\nNoise\n")
    (tmp_path / "site.txt").write_text("Aa bb_Wren\nplain line\n\n")
    lab = tables.flag_site_species(tables.read_labels(spark, str(tmp_path / "labels.txt")), tables.read_site_species(spark, str(tmp_path / "site.txt")))
    got = {r["class_idx"]: (r["species"], r["common_name"], r["site_species"]) for r in lab.collect()}
    assert got[0] == ("Aa bb", "Wren", True) and got[2] == ("Cc dd", "Odd_Name, x", False) and got[3][1] is None

    (tmp_path / "dep.csv").write_text(
        "recorder,recorder_group,begin,end,status,mount,height_above_ground,Longitude,Latitude,notes\n"
        "R1,House,2024-01-10,2024-02-01,active,post,1,-93.5,33.7,a\nR2,House,2023-05-31 00:00:00-05:00,2023-07-11,ended,,1,,33.7,b\n")
    d = {r["recorder"]: r for r in tables.read_deployments(spark, str(tmp_path / "dep.csv"), "America/Chicago").withColumn("b", F.unix_seconds("begin")).collect()}
    assert d["R1"]["end"] is None and d["R1"]["b"] == 1704866400  # local midnight in winter is 06:00 UTC
    assert d["R2"]["b"] == 1685509200 and d["R2"]["longitude"] is None and d["R2"]["latitude"] == 33.7

    (tmp_path / "c.toml").write_text('[site]\ntimezone="UTC"\nlat=1\nlon=2\n[audio]\ntopdirs=["/a"]\n[thresholds]\nconcordance_probs=[0.5,0.9]\n')
    cfg = load_config(str(tmp_path / "c.toml"))
    assert cfg.thresholds.concordance_probs == (0.9, 0.5) and cfg.sample_rate == 44100 and cfg.thresholds.min_active_recorders == 4
    (tmp_path / "d.toml").write_text('[site]\ntimezone="UTC"\nlat=1\n')
    with pytest.raises(KeyError):
        load_config(str(tmp_path / "d.toml"))


def test_known_recorder_outside_its_windows_loses_its_group(spark):
    dep = spark.createDataFrame([(0, "R1", "G", "2024-01-10", "2024-01-20", 1.0, 2.0)], "ord int, recorder string, recorder_group string, b string, e string, latitude double, longitude double")
    dep = dep.select("ord", "recorder", "recorder_group", F.col("b").cast("timestamp").alias("begin"), F.col("e").cast("timestamp").alias("end"), "latitude", "longitude")
    cat = spark.createDataFrame([(1, "R1", "2024-01-20 23:00:00"), (2, "R1", "2024-01-21 00:00:00"), (3, "R9", "2024-01-15 00:00:00")], "k int, recorder string, t string")
    cat = cat.select("k", "recorder", F.col("t").cast("timestamp").alias("start_datetime"), F.lit("Z").alias("recorder_group"), F.lit(9.0).alias("latitude"), F.lit(9.0).alias("longitude"))
    got = {r["k"]: (r["recorder_group"], r["latitude"]) for r in deployments.apply_metadata(cat, dep).collect()}
    assert got == {1: ("G", 1.0), 2: (None, 9.0), 3: ("Z", 9.0)}
    with pytest.raises(ValueError):
        deployments.match(cat, dep, "start_datetime", ["latitude"], fallback="nope")


def test_inference_windows_and_resume(spark, archive_dir):
    _, files = build(spark, archive_dir)
    waves = catalog.read_headers(audio.pruned(files))

    def scorer(x, rate):
        loud = np.abs(x).max(1)
        return np.column_stack([loud, loud]), np.column_stack([loud - loud, np.log(loud + 1e-9)])

    got = inference.detect(waves, scorer, threshold=0.6, rate=RATE, low=None, mode="file-peak").collect()
    per, lost = {}, [r for r in got if r["error"]]
    got = [r for r in got if not r["error"]]
    assert len(lost) == 1 and lost[0]["error"] in ("no samples", "no start in the name") and lost[0]["probs"] is None
    for r in got:
        per.setdefault(r["file"], []).append(r)
    assert len(per) == 5 and all(len(v) == 3 for v in per.values())  # 10 s: three whole windows, no tail
    first = sorted(per.values(), key=lambda v: v[0]["file"])[0]
    assert [round(r["win_start"], 3) for r in sorted(first, key=lambda r: r["win_start"])] == [0.0, 3.0, 6.0]
    assert np.allclose([np.linalg.norm(r["embedding"]) for r in got], 1, atol=1e-5)
    assert all(p["prob"] >= 0.6 for r in got for p in r["probs"])
    done = waves.where("recorder IN ('BARLT_00000001', 'BARLT_00000002')")
    assert inference.detect(waves, scorer, done=done, rate=RATE).where("error IS NULL").select("file").distinct().count() == 3
    with pytest.raises(ValueError):
        inference.gain(np.ones(3), "loud")
    assert inference.gain(np.array([0.0, -2.0]), "file-peak").tolist() == [0.0, -0.99]


def test_detections_streamed_once(spark, tmp_path):
    win = spark.createDataFrame([("/a/f1.wav", "", 0.0, 3.0, [1.0], [(0, 0.9), (1, 0.4)]), ("/a/f1.wav", "", 3.0, 6.0, [1.0], [])],
                                "file string, abs_start_iso string, win_start double, win_end double, embedding array<float>, probs array<struct<class_idx:int,prob:double>>")
    folder = tmp_path / "in" / "_bn_grid_wprobs"
    folder.mkdir(parents=True)
    win.coalesce(1).write.parquet(str(tmp_path / "w"))
    next((tmp_path / "w").glob("part-*.parquet")).rename(folder / "emb_00001.parquet")
    lab = spark.createDataFrame([(0, "Wren", True), (1, "Owl", True)], "class_idx int, common_name string, site_species boolean")
    cat = spark.createDataFrame([("/b/f1.wav", "R1")], "file string, recorder string").withColumn("start_datetime", F.lit("2024-01-05 12:00:00").cast("timestamp"))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for _ in range(2):  # the second run finds nothing new
        q = ingest.detect_incrementally(ingest.new_windows(spark, str(tmp_path / "in" / "_bn_grid_wprobs")), lab, cat, "UTC", out, ck)
        q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 2
    assert tables.window_sidecars(spark, [str(tmp_path / "in")]).count() == 2


def test_sinks_key_steps_by_parameters(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "call_id string, v int")
    root = str(tmp_path)
    assert sinks.stored(df, root, "s", {"n": 1}).count() == 2
    assert sinks.stored(df.limit(0), root, "s", {"n": 1}).count() == 2  # reused
    assert sinks.stored(df.limit(0), root, "s", {"n": 2}).count() == 0  # other arguments, other step
    assert tables.read_if_present(spark, root + "/none") is None
    sinks.append_run(df, root + "/r", 1)
    sinks.append_run(df.where("v = 2").withColumn("v", F.lit(9)), root + "/r", 2)
    sinks.append_run(df.where("v = 2").withColumn("v", F.lit(8)), root + "/r", 2)  # a repeated key in one run
    assert {(r["call_id"], r["v"]) for r in sinks.consolidated(spark, root + "/r", "call_id", ("v",)).collect()} == {("a", 1), ("b", 9)}


def test_rows_never_fail_the_job(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0)], "call_id string, v int")
    got = {r["call_id"]: r for r in localize.run_rows(df, lambda r: {"q": 1 / r.v}, "call_id", "q double").collect()}
    assert got["a"]["result"]["q"] == 1.0 and got["b"]["error_type"] == "ZeroDivisionError"


def test_refinement_recovers_a_displaced_recorder(spark):
    rng = np.random.default_rng(2)
    rec = {f"r{k}": np.array(p) for k, p in enumerate(POS.values())}
    rows = []
    for n in range(60):
        src = rng.uniform([0, 0, 3], [60, 60, 25])
        d = {k: np.linalg.norm(src - p) for k, p in rec.items()}
        for o in ("r0", "r1", "r2", "r3"):
            rows.append(("r4", src.tolist(), 1.0, float(d[o]), float((d["r4"] - d[o]) / 343), 343.0))
    df = spark.createDataFrame(rows, "drop_rid string, x_src array<double>, sign double, d_other double, t double, c double")
    start = spark.createDataFrame([("r4", *(rec["r4"] + [3.0, -2.0, 1.0]).tolist())], "recorder string, x double, y double, z double")
    got = refine.refine(df, start).first()
    assert np.allclose([got["x"], got["y"], got["z"]], rec["r4"], atol=0.01)
    flat = refine.refine(df, start, xy_only=True).first()
    assert flat["z"] == pytest.approx(rec["r4"][2] + 1)
    held = refine.refine(df, start, prior_sigma_m=1e-3).first()
    assert held["n_residuals"] == 243 and held["x"] > got["x"]
    assert refine.refine(df.limit(3), start).count() == 0


def test_autumn_hour_repeats_call_ids(spark):
    df = spark.createDataFrame([("2024-11-03 06:30:00",), ("2024-11-03 07:30:00",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    ids = df.select(text.call_id(F.lit("Wren"), F.lit("G"), F.col("t"), "America/Chicago").alias("call_id"))
    assert detections.duplicate_call_ids(ids).first()["n"] == 2
    utc = df.select(text.call_id(F.lit("Wren"), F.lit("G"), F.col("t")).alias("call_id"))
    assert detections.duplicate_call_ids(utc).count() == 0


def test_sun_times_near_published_values(spark):
    r = timefn.sun_table(spark, 33.7, -93.3, "2024-06-20", "2024-06-22").withColumn("u", F.unix_seconds("sunrise")).orderBy("date").first()
    assert abs(r["u"] - 1718881620) < 180  # 11:07 UTC
    assert timefn.sun_table(spark, 80.0, 0.0, "2024-06-20", "2024-06-22").count() == 0


def test_strategy_must_be_known(spark):
    with pytest.raises(ValueError):
        detections.select_candidates(spark.range(1), strategy="loose")


def test_sidecar_rows_and_files_are_shuffled_once(spark):
    """The first second that has a file counts; other channels, other ends and other folders do not."""
    raw = spark.createDataFrame([("/m", None, f"S4A20001_20240105${t}.w4v") for t in ("070000", "070008", "070058", "235959", "080000")], "meta_dir string, FOLDER string, `IN FILE` string")
    raw = raw.selectExpr("*", "DATE'2024-01-05' AS DATE", "'07:00:01' AS TIME", "1.0D AS DURATION", "2.0D AS LONGITUDE", "3.0D AS LATITUDE")
    names = [f"/m/S4A20001_{x}.wav" for x in ("0_20240105_070003_000", "0_20240105_070001_000", "1_20240105_070008_000", "0_20240105_070101_000", "0_20240105_000000_000", "0_20240105_080000_001")]
    out = catalog.sidecar_rows(raw, spark.createDataFrame([(n,) for n in [*names, "/n/S4A20001_0_20240105_070009_000.wav"]], "file string"))
    got = {r["sourcefile"][18:24]: r["wavfile0"][20:26] for r in out.collect()}
    assert got == {"070000": "070001", "070008": "", "070058": "070101", "235959": "000000", "080000": ""}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Join") == 1
