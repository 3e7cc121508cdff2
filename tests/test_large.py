"""Steps that must hold at size: plans, counts and edges that only larger tables show."""

import tempfile

import duckdb
import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

import workload
from fieldecho.functions.timefn import HOUR
from fieldecho.operators import relate
from fieldecho.operators.intervals import mean_length, resolve_intervals, stab_join
from fieldecho.operators.stats import exact_percentiles
from fieldecho.plans import analysis, localize, refine
from fieldecho.signal import combos, solve, spectra

workload.load_all()

RECORDERS = [(f"r{k}", *xyz) for k, xyz in enumerate(((0.0, 0.0, 0.0), (60.0, 0.0, 20.0), (0.0, 60.0, 25.0), (60.0, 60.0, 2.0), (30.0, -20.0, 30.0)))]


def test_no_table_of_calls_is_broadcast(spark):
    n = len(RECORDERS)
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(n) for j in range(i + 1, n)])
    obs = spark.range(50).select(F.col("id").cast("string").alias("call_id"), F.array(*[F.lit(r[0]) for r in RECORDERS]).alias("recorders"),
                                 pairs.alias("pairs"), F.array_repeat(F.lit(0.0), n * (n - 1) // 2).alias("tdoas"))
    positions = spark.createDataFrame(RECORDERS, "recorder string, x double, y double, z double")
    rows = refine.residual_rows(obs, refine.sources_without(obs, positions), positions)
    plan = rows._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [line for line in plan if "BroadcastHashJoin" in line and ("call_id" in line or "BuildLeft" in line)]
    assert [line for line in plan if "SortMergeJoin" in line and "call_id" in line]


def test_refining_shuffles_sums_and_not_the_rows_of_a_recorder(spark, monkeypatch):
    plans, cut = [], refine.cut_lineage
    monkeypatch.setattr(refine, "cut_lineage", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    at = {r[0]: r[1:] for r in RECORDERS}
    rows = [(rid, [7.0 + 3 * k, 11.0 + k * k % 23, 5.0 + k % 7], s, 0.0, s * np.linalg.norm(np.subtract((7.0 + 3 * k, 11.0 + k * k % 23, 5.0 + k % 7), at[rid])) / 343.0, 343.0)
            for rid in at for k in range(20) for s in (1.0, -1.0)]
    rows = spark.createDataFrame([(a, b, c, d, float(t), v) for a, b, c, d, t, v in rows], "drop_rid string, x_src array<double>, sign double, d_other double, t double, c double")
    start = spark.createDataFrame([(k, x + 1, y - 1, z + 1) for k, x, y, z in RECORDERS], "recorder string, x double, y double, z double")
    got = {r.recorder: r for r in refine.refine(rows, start, loss="linear", steps=60).collect()}
    assert set(got) == set(at) and all(r.converged and r.n_residuals == 40 and np.allclose((r.x, r.y, r.z), at[k], atol=1e-3) for k, r in got.items())
    steps = 0
    for lines in (p.splitlines() for p in plans):
        for k in [k for k, line in enumerate(lines) if "Scan ExistingRDD" in line and "x_src" in line and k]:
            assert "Aggregate" in next(line for line in reversed(lines[:k]) if "Exchange" in line or "Aggregate" in line), "\n".join(lines)
            steps += 1
    assert steps > 2


def test_folders_above_all_others_are_not_joined_by_key(spark, monkeypatch):
    paths = [f"/m/{k % 40}/sub{k}" for k in range(200)] + ["", "/", "abc", "abc/d", "/a/", "/a//b", "/m", "//m", None]
    marks = ["/m", "/m/7", "/m/7/sub47", "/m/3", "", "abc", "/a/", "/nowhere", "/m/1/sub"]
    dirs, marked = spark.createDataFrame([(p,) for p in paths], "dir string"), spark.createDataFrame([(m,) for m in marks + marks], "at string")
    up = lambda p: ["/".join(p.split("/")[:n + 1]) for n in range(len(p.split("/")))]
    want = {p: max((a for a in up(p) if a in marks), key=len) for p in paths if p is not None and set(up(p)) & set(marks)}
    out = relate.nearest_ancestor(dirs, marked)
    assert "BroadcastHashJoin [at" in "".join(line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "LeftOuter" in line)
    assert {r.dir: r["at"] for r in out.collect()} == want and out.count() == len(want)
    monkeypatch.setattr(relate, "CROWDED", 2)
    assert {r.dir: r["at"] for r in relate.nearest_ancestor(dirs, marked).collect()} == want
    assert relate.nearest_ancestor(dirs.limit(0), marked).count() == 0 == relate.nearest_ancestor(dirs, marked.limit(0)).count()


def test_percentiles_read_what_they_rank_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            read.add(len(f))
            yield f

    a = spark.range(900).select((F.col("id") % 30).alias("k"), (F.col("id") * 7 % 100).cast("double").alias("v"))
    a = a.repartition(3, "k").mapInPandas(counted, "k long, v double")
    got = {r.k: r for r in exact_percentiles(a.join(a.select("k").distinct().hint("merge"), "k"), ["k"], "v", {"m": 0.5, "q": 0.9}).collect()}
    n = read.value
    for k, r in got.items():
        v = [i * 7 % 100 for i in range(900) if i % 30 == k]
        assert r.n == 30 and np.allclose((r.m, r.q), np.percentile(v, (50, 90)))
    assert len(got) == 30 and n <= 2 * 900  # once for each side of the join


def test_bounds_of_overlapping_intervals_are_gathered_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            read.add(len(f))
            yield f

    iv = spark.range(60).select((F.col("id") % 6).alias("k"), (F.col("id") * 7 % 50).alias("lo"), F.when(F.col("id") % 5 != 0, F.col("id") * 7 % 50 + 9).alias("hi"), F.col("id").alias("ord"))
    segs = resolve_intervals(iv.mapInPandas(counted, "k long, lo long, hi long, ord long"), ["k"], [F.max("ord").alias("ord")], width=20, cover_all=True).collect()
    n = read.value
    at = lambda k, t: [s for s in segs if s.k == k and (s.lo is None or s.lo <= t) and (s.hi is None or t < s.hi)]
    for k in range(6):
        for t in range(-3, 70):
            held = [i for i in range(k, 60, 6) if i * 7 % 50 <= t and (i % 5 == 0 or t < i * 7 % 50 + 9)]
            (s,) = at(k, t)
            assert (s.ord, s.matched) == (max(held, default=None), bool(held))
    assert n <= 60 * 6  # three kinds of bounds, the intervals twice, their ends


def test_buckets_follow_the_length_of_the_intervals(spark):
    iv = spark.range(2000).select(F.lit("a").alias("g"), (F.col("id") * 10_000_000).alias("lo"), (F.col("id") * 10_000_000 + 12_000_000).alias("hi"), F.col("id").alias("iv"))
    pts = spark.range(2000).select(F.lit("a").alias("g"), (F.col("id") * 10_000_000 + 1).alias("t"), "id")
    out = stab_join(pts, iv, ["g"], "t", width=None, how="inner", open_ended=False)
    assert out.count() == 3999
    pairs = pts.crossJoin(iv.select("lo", "hi", "iv")).where("lo <= t AND t < hi").select("id", "iv")
    assert out.select("id", "iv").exceptAll(pairs).isEmpty()
    assert mean_length(iv) == 12_000_000 and mean_length(iv.limit(0)) == HOUR


def test_windows_end_within_the_recording(spark):
    sql = workload.ORACLES["grid_windows"]
    rows = [(k, at, length) for k, (at, length) in enumerate((at, length) for at in (0, 10_000, 1_230_000, 1_900_000, 2_300_000, 2_810_000)
                                                               for length in (n / 100 for n in range(0, 2000)))]
    e = spark.createDataFrame(rows, "event_id bigint, us bigint, value double").select("event_id", F.timestamp_micros("us").alias("ts"), "value")
    with tempfile.TemporaryDirectory() as d:
        e.coalesce(1).write.parquet(f"{d}/events.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT event_id, ts::TIMESTAMP AS ts, value FROM '{d}/events.parquet/*.parquet'")
        con.execute("SET TimeZone = 'UTC'")
        assert not oracle.compare(workload.QUERIES["grid_windows"](spark, d), con, sql)


def test_a_stated_length_goes_before_the_stamps(spark):
    files = spark.createDataFrame([(0, 1_680_000, 1.68), (0, 1_680_000, 0.68 + 1), (0, 1_680_000, None)], "a bigint, b bigint, stated_seconds double")
    files = files.select(F.timestamp_micros("a").alias("start_datetime"), F.timestamp_micros("b").alias("file_end"), F.timestamp_micros(F.lit(2_500_000)).alias("call_datetime"),
                         F.lit(2_711_730).alias("datalen"), F.lit(44100).alias("rate"), F.lit("SOLARBAR").alias("recorder_type"), "stated_seconds")
    assert [r["first_sample"] for r in localize.clip_requests(files).collect()] == [2_421_188, 2_421_187, 2_421_188]


@pytest.mark.parametrize("name", ["clock_rates", "true_rate_mapping"])
def test_clock_ties_match_the_sql(spark, name):
    keys = [171173, 172529, 209771, 273793, 272562, 341223]
    with tempfile.TemporaryDirectory() as d:
        e = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
        e = e.withColumn("event_id", F.explode(F.sequence(F.col("event_id"), F.col("event_id") + 500_000, F.lit(100_000))))
        e.where(F.col("event_id").isin(keys)).coalesce(1).write.parquet(f"{d}/events.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet/*.parquet'")
        assert not oracle.compare(workload.QUERIES[name](spark, d), con, workload.ORACLES[name])


def test_falloff_hears_every_recorder_of_any_source(spark):
    with tempfile.TemporaryDirectory() as d:
        e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(1)
        e.withColumn("vec_id", F.explode(F.array(*[F.lit(k).cast("bigint") for k in (10249, 14431, 14800, 16317)]))).write.parquet(f"{d}/embeddings.parquet")
        assert [r["n_recorders"] for r in workload.QUERIES["intensity_falloff"](spark, d).collect()] == [6] * 4


@pytest.mark.parametrize("n, reach", [(5000, 37), (4999, 120), (300, 40)])
def test_blocks_correlate_as_the_whole_does(n, reach):
    rng = np.random.default_rng(n)
    a, b = rng.normal(size=n), np.zeros(n)
    b[n // 2:n // 2 + 60] = a[n // 2 - 20:n // 2 + 40]
    size = spectra.fast_len(2 * n - 1)
    at, lags, qual = spectra.correlate(np.fft.rfft(a, size), np.fft.rfft(b, size), size, 2000, (reach - 0.5) / 2000)
    got = spectra.correlate_blocks(spectra.BlockSpectra(a, reach), spectra.BlockSpectra(b, reach), size // 2, 2000, reach - 1)
    assert np.allclose(got[0], at, atol=1e-12) and (got[1] == lags).all() and abs(got[2] - qual) < 1e-12


def test_clips_dealt_by_event_are_not_shuffled_again(spark):
    plan = workload.QUERIES["localize_full_clips"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("FlatMapGroupsInPandas"):]
    assert below.count("Exchange") == 1 and below.index("Generate") < below.index("Exchange")


@pytest.mark.parametrize("options", [{}, {"n_best": 3, "include_top": False}, {"include_disjoint": True, "prefer_zeros": True}, {"n_best": 4, "max_outlier_pairs": 2, "shallow_cap": 1},
                                     {"n_best": 2, "include_disjoint": True, "prefer_zeros": True, "max_outlier_pairs": 1}])
@pytest.mark.parametrize("sizes", [(2, 2, 2, 2, 2, 2), (3, 1, 2, 0, 4, 1), (1, 1, 1, 1, 1, 1)])
def test_many_events_are_chosen_as_one(options, sizes):
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    values = np.random.default_rng(5).integers(0, 6, (300, sum(sizes))) / 4.0  # many ties
    many = combos.choose_many(values, sizes, pairs, **options)
    assert many == [combos.choose(np.split(v, np.cumsum(sizes)[:-1]), pairs, **options) for v in values]


def test_choose_many_leaves_the_rest_to_one_by_one():
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    assert combos.choose_many(np.full((2, 12), np.nan), (2,) * 6, pairs) is None
    assert combos.choose_many(np.zeros((2, 48)), (8,) * 6, pairs) is None
    assert combos.choose_many(np.zeros((2, 2)), (1, 1), [(0, 1), (2, 3)]) is None


def test_cards_of_long_numbers_stay_apart(spark):
    c = spark.range(120).select(F.explode(F.array(F.col("id"), F.col("id") + 100_000, F.col("id") * 10 + 1_000_000, F.col("id") * 10 + 1_000_001)).alias("c_custkey"))
    with tempfile.TemporaryDirectory() as d:
        c.coalesce(1).write.parquet(f"{d}/customer.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW customer AS SELECT * FROM '{d}/customer.parquet/*.parquet'")
        assert not oracle.compare(workload.QUERIES["archive_scan"](spark, d), con, workload.ORACLES["archive_scan"])


def test_displaced_recorders_that_fit_another_position(spark):
    """Customers whose recorders, moved by 5 or 10 m, leave less than 0.01 ms by chance: the position has moved by metres."""
    rows = [(86038, 15), (90938, 11), (233304, 8), (263113, 7), (692758, 8)]
    with tempfile.TemporaryDirectory() as d:
        spark.createDataFrame(rows, "c_custkey bigint, c_nationkey int").coalesce(1).write.parquet(f"{d}/customer.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW customer AS SELECT * FROM '{d}/customer.parquet/*.parquet'")
        assert not oracle.compare(workload.QUERIES["perturbation_control"](spark, d), con, workload.ORACLES["perturbation_control"])


def _problems(n, moved):
    rng = np.random.default_rng(4)
    at = np.array([r[1:] for r in RECORDERS])
    i, j = np.triu_indices(len(at), 1)
    src = np.column_stack([rng.uniform(10, 50, n), rng.uniform(5, 50, n), rng.uniform(5, 20, n)])
    toa = np.linalg.norm(at - src[:, None], axis=2) / 343.0
    at = at + moved * rng.normal(size=(n, *at.shape))
    box = at.min(1), at.max(1), at.mean(1)
    return (at[:, i], at[:, j], toa[:, i] - toa[:, j], np.ones((n, len(i)), bool), *box, np.full(n, 343.0)), src


@pytest.mark.parametrize("fit_speed", [False, True])
def test_starts_that_meet_are_solved_once(monkeypatch, fit_speed):
    """The outcome of letting every start run to its end, for less than 0.75 of the work."""
    for moved in (0.0, 3.0):
        args, src = _problems(600, moved)
        work, counted = [], solve._solve
        monkeypatch.setattr(solve, "_solve", lambda h, g: work.append(len(h)) or counted(h, g))
        x, c, cost, _, done = solve.locate(*args, fit_speed=fit_speed)
        some = sum(work)
        work.clear()
        monkeypatch.setattr(solve, "_beaten", lambda v, *rest: np.zeros(v.shape[1], bool))
        x2, c2, cost2, _, done2 = solve.locate(*args, fit_speed=fit_speed)
        monkeypatch.undo()
        assert some < 0.75 * sum(work), (moved, some, sum(work))
        assert (done == done2).all() and np.allclose(cost, cost2, rtol=1e-9, atol=1e-12)
        assert (np.abs(x - x2).max(1) < 1e-3).mean() > 0.995 and moved or np.abs(x - src).max() < 1e-6


def test_events_stay_spread_after_the_join_with_their_pairs(spark):
    """Adaptive execution merges the few bytes of the events; choice and solve must not follow them into one task."""
    clips = spark.range(64).select(F.col("id").cast("string").alias("event_id"), F.inline(F.array(*[
        F.struct(F.lit(r[0]).alias("recorder"), *[F.lit(v).alias(n) for n, v in zip("xyz", r[1:])]) for r in RECORDERS])),
        F.transform(F.sequence(F.lit(0), F.lit(199)), lambda k: F.sin(k * k)).alias("samples"))
    events = clips.select("event_id", F.lit(343.0).alias("speed")).distinct()
    cfg = localize.LocalizeConfig(rate=2000, use_profile=False, qualcut=1.0, max_peaks_per_pair=1, fallback_to_max=True)
    out = localize.localize(clips, events, cfg)
    assert out.count() == 64
    plan = out._jdf.queryExecution().executedPlan().toString().split("BroadcastHashJoin")[0]
    assert "REPARTITION_BY_NUM" in plan


def test_pairs_at_once_are_the_pairs_one_by_one(monkeypatch):
    rng = np.random.default_rng(3)
    clips = rng.normal(size=(4, 300))
    n = spectra.fast_len(599)
    spec = np.fft.rfft(clips, n)
    which = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    lags = [None, 0.0, 0.01, 0.02, 0.149, 9.0]
    for phat in (False, True):
        for at_once in (1, 2 * n, 1 << 20):
            monkeypatch.setattr(spectra, "AT_ONCE", at_once)
            for (i, j), lag, (cc, at, qual) in zip(which, lags, spectra.correlate_pairs(spec, which, n, 2000, lags, phat)):
                full = np.fft.irfft(spec[i] * spec[j].conj() / ((np.abs(spec[i] * spec[j].conj()) + np.finfo(float).eps) if phat else 1), n)
                reach = spectra.reach_of(n, 2000, lag)
                steps = np.arange(-reach, reach + 1) if reach < n // 2 else np.arange(-(n // 2), n // 2)
                want = full[steps % n] / np.abs(full[steps % n]).max()
                inner = cc[1:-1] if reach < n // 2 else cc
                assert np.allclose(inner, want, atol=1e-12) and len(cc) == len(at) and np.isclose(qual, np.abs(want[want != 0]).std())


def test_directions_are_even_and_drawn_once(spark):
    at = F.array(*[F.array(*[F.lit(v) for v in r[1:]]) for r in RECORDERS])
    out = analysis.perturb(spark.range(4000).select(F.col("id").alias("call_id"), at.alias("coords")), [0.0, 7.0], seed=1)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(") == 2
    got = {d: np.array([r["coords"] for r in out.where(F.col("perturb") == d).collect()]) - [r[1:] for r in RECORDERS] for d in (0.0, 7.0)}
    assert (got[0.0] == 0).all() and np.allclose(np.linalg.norm(got[7.0], axis=2), 7.0, atol=1e-9)
    unit = got[7.0].reshape(-1, 3) / 7
    # even over the sphere: no mean direction, the same second moments on every axis
    assert np.abs(unit.mean(0)).max() < 0.02 and np.abs(unit.T @ unit / len(unit) - np.eye(3) / 3).max() < 0.02
    assert len(np.unique(unit.round(9), axis=0)) == len(unit)


def test_all_peaks_enter_and_equal_closures_go_to_the_taller_ones(spark, monkeypatch):
    """Calls that repeat themselves close around every triangle in several ways; rounded delays must not choose among them."""
    rng = np.random.default_rng(7)
    rows = []
    for event in range(24):
        src, call = np.array([10.0 + event, 5.0 + event, 5.0 + event % 17]), rng.normal(size=200)
        call[40:] += 0.7 * call[:-40]
        for name, *at in RECORDERS:
            late = round(np.linalg.norm(np.array(at) - src) / 343 * 2000)
            rows.append((str(event), name, *at, [float(v) for v in np.r_[np.zeros(100 + late), call, np.zeros(700 - late)]]))
    clips = spark.createDataFrame(rows, "event_id string, recorder string, x double, y double, z double, samples array<double>")
    events = clips.select("event_id", F.lit(343.0).alias("speed")).distinct()
    cfg = localize.LocalizeConfig(rate=2000, use_profile=False, qualcut=1.0, peak_min_distance=5, fit_speed=False)
    got = localize.localize(clips, events, cfg).select("total_peak_combos", "best_score", "peak_indexes").collect()
    assert len(got) == 24 and all(r["total_peak_combos"] > 1 for r in got)
    assert all(r["best_score"] == 0 and set(r["peak_indexes"]) == {0} for r in got)


def test_localize_events_drops_no_peak(spark, tmp_path, monkeypatch):
    call = [float(v) for v in np.tile(np.random.default_rng(1).normal(size=32), 2)]
    spark.createDataFrame([(k, call) for k in range(3)], "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    held, whole = [], localize.localize
    monkeypatch.setattr(localize, "localize", lambda *a, **kw: held.append(whole(*a, **kw)) or held[-1])
    rows = workload.QUERIES["localize_events"](spark, str(tmp_path)).collect()
    assert {(r["off_by"], r["error_ms"]) for r in rows} == {(0, 0)} and len(rows) == 3
    assert all(max(r["combo_sizes"]) > 1 for r in held[0].select("combo_sizes").collect())


@pytest.mark.parametrize("options", [{}, {"n_best": 3, "include_disjoint": True}, {"prefer_zeros": True}, {"max_outlier_pairs": 1}])
def test_closures_counted_in_samples_are_the_same_one_by_one(options):
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    lags = np.random.default_rng(5).integers(-4, 5, size=(40, 18)) / 2000
    many = combos.choose_many(lags, (3,) * 6, pairs, **options, rate=2000)
    for row, got in zip(lags, many):
        peaks = list(row.reshape(6, 3))
        assert got == combos.choose(peaks, pairs, **options, rate=2000)
        ids = np.indices((3,) * 6).reshape(6, -1).T
        score = [max(abs(round(2000 * row[3 * p + c[p]]) + round(2000 * row[3 * q + c[q]]) - round(2000 * row[3 * r + c[r]])) for p, q, r in combos.triangle_rows(pairs)) for c in ids]
        if not options:
            k = int(np.argmin(score))
            assert got[0][1:] == (score[k] / 2000, tuple(ids[k]))
