"""Interval algebra against sequential statements of the semantics; each key is one random example."""

import random

import pandas as pd
import pytest

from fieldecho.operators.asof import asof_join
from fieldecho.operators.intervals import (CLOSED, END_OF_DAY, STRICT, coalesce_intervals, resolve_intervals, stab_join,
                                           step_counts)
from fieldecho.operators.running import Run, running
from fieldecho.operators.stats import exact_percentiles
from pyspark.sql import functions as F


def random_intervals(keys=60, seed=1):
    rng = random.Random(seed)
    return [(k, lo, lo + rng.randint(0, 60)) for k in range(keys) for lo in (rng.randint(0, 500) for _ in range(rng.randint(1, 25)))]


def merge(rows, gap):
    out = []
    for lo, hi in sorted(rows):
        if out and lo <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("width", [7, 50, 10_000])
def test_coalesce(spark, width):
    rows = random_intervals()
    df = spark.createDataFrame(rows, "k int, lo bigint, hi bigint")
    got = {}
    for r in coalesce_intervals(df, ["k"], gap=10, width=width).collect():
        got.setdefault(r["k"], []).append((r["lo"], r["hi"]))
    for k in range(60):
        assert sorted(got[k]) == merge([(lo, hi) for kk, lo, hi in rows if kk == k], 10)


def test_step_counts_equal_direct_count(spark):
    rows = random_intervals(20, 2)
    df = spark.createDataFrame(rows, "k int, lo bigint, hi bigint")
    steps = step_counts(df, ["k"], width=40).collect()
    for k in range(20):
        for t in range(0, 580, 13):
            want = sum(kk == k and lo <= t < hi for kk, lo, hi in rows)
            got = sum(s["n"] for s in steps if s["k"] == k and s["lo"] <= t and (s["hi"] is None or t < s["hi"]))
            assert got == want


def test_running_equals_plain_window(spark):
    rng = random.Random(3)
    rows = [(k, t, rng.randint(-5, 9)) for k in range(5) for t in rng.sample(range(1000), 80)]
    df = spark.createDataFrame(rows, "k int, t bigint, v int")
    runs = {"s": Run("sum", F.col("v")), "p": Run("max", F.col("t"), include_current=False), "n": Run("min", F.col("t"), False, False)}
    for r in running(df, ["k"], "t", 64, runs).collect():
        mine = sorted((t, v) for k, t, v in rows if k == r["k"])
        assert r["s"] == sum(v for t, v in mine if t <= r["t"])
        assert r["p"] == max((t for t, _ in mine if t < r["t"]), default=None)
        assert r["n"] == min((t for t, _ in mine if t > r["t"]), default=None)


def test_running_without_key(spark):
    df = spark.createDataFrame([(t, 1) for t in range(0, 300, 7)], "t bigint, v int")
    got = sorted((r["t"], r["s"]) for r in running(df, [], "t", 50, {"s": Run("sum", F.col("v"))}).collect())
    assert got == [(t, k + 1) for k, t in enumerate(range(0, 300, 7))]


def test_resolve_last_writer_and_gaps(spark):
    df = spark.createDataFrame([("a", 0, 100, "x", 1), ("a", 50, 80, "y", 2), ("a", 200, None, "z", 3), ("b", None, 10, "w", 4)],
                               "k string, lo bigint, hi bigint, g string, ord int")
    segs = resolve_intervals(df, ["k"], [F.max_by("g", "ord").alias("g")], width=30, cover_all=True)
    got = {(r["k"], r["lo"], r["hi"]): (r["g"], r["matched"]) for r in segs.collect()}
    assert got == {("a", None, 0): (None, False), ("a", 0, 50): ("x", True), ("a", 50, 80): ("y", True), ("a", 80, 100): ("x", True),
                   ("a", 100, 200): (None, False), ("a", 200, None): ("z", True), ("b", None, 10): ("w", True), ("b", 10, None): (None, False)}


def test_bound_policies():
    day = 86_400_000_000
    for policy, want in ((END_OF_DAY, (5, 9 + day)), (CLOSED, (5, 10)), (STRICT, (6, 9))):
        assert policy.lower_inclusive == (want[0] == 5)
        assert 9 + policy.upper_pad + (1 if policy.upper_inclusive else 0) == want[1]


def test_stab_join_keeps_every_match_and_misses(spark):
    rng = random.Random(5)
    iv = random_intervals(10, 6)
    pts = [(k, t) for k in range(12) for t in rng.sample(range(-50, 700), 30)]
    i = spark.createDataFrame([(k, lo, hi if n % 9 else None, n) for n, (k, lo, hi) in enumerate(iv)], "k int, lo bigint, hi bigint, n int")
    p = spark.createDataFrame(pts, "k int, t bigint")
    got = sorted((r["k"], r["t"], r["n"] if r["n"] is not None else -1) for r in stab_join(p, i, ["k"], "t", width=25).collect())
    want = []
    for k, t in pts:
        hits = [n for n, (kk, lo, hi) in enumerate(iv) if kk == k and lo <= t and (n % 9 == 0 or t < hi)]
        want += [(k, t, n) for n in hits] or [(k, t, -1)]
    assert got == sorted(want)


@pytest.mark.parametrize("direction,tolerance", [("backward", None), ("nearest", None), ("nearest", 9), ("backward", 15)])
def test_asof_equals_pandas(spark, direction, tolerance):
    rng = random.Random(7)
    left = pd.DataFrame({"t": sorted(rng.sample(range(1000), 150))})
    right = pd.DataFrame({"u": sorted(rng.sample(range(100, 900), 40))})
    right["v"] = right["u"] * 10
    want = pd.merge_asof(left, right, left_on="t", right_on="u", direction=direction, tolerance=tolerance)
    got = asof_join(spark.createDataFrame(left), spark.createDataFrame(right), "t", "u", direction=direction, tolerance=tolerance,
                    width=20, right_width=100).toPandas().sort_values("t")
    assert got["v"].fillna(-1).tolist() == want["v"].fillna(-1).tolist()


def test_nearest_tie_goes_to_the_earlier(spark):
    got = asof_join(spark.createDataFrame([(5,)], "t bigint"), spark.createDataFrame([(0, "a"), (10, "b")], "u bigint, v string"),
                    "t", "u", direction="nearest").collect()
    assert got[0]["v"] == "a"


def test_exact_percentiles_with_ties_infinities_and_nulls(spark):
    rng = random.Random(8)
    rows = [(g, rng.choice([rng.gauss(0, 100), 1.0, -3.5, 0.0])) for g in "ab" for _ in range(301)]
    rows += [("a", float("inf")), ("a", None), ("b", float("nan"))]
    got = {r["g"]: r for r in exact_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"m": 0.5, "p": 0.9, "lo": 0.0}).collect()}
    for g in "ab":
        s = pd.Series([v for k, v in rows if k == g and v is not None and v == v])
        assert got[g]["n"] == len(s)
        for name, q in (("m", 0.5), ("p", 0.9), ("lo", 0.0)):
            assert got[g][name] == pytest.approx(s.quantile(q))
