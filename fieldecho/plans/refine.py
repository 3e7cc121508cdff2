"""Refine recorder positions from calls located without them (leave one recorder out).

Each robust least-squares step is one Spark aggregation: every residual row adds its
share to a 3x3 system per recorder, summed with map-side combine. The sums stay a table
from step to step; neither they nor a recorder's rows are gathered in one place.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, geo
from ..session import cut_lineage
from .localize import locate_sources

MIN_RESIDUALS, MIN_RESIDUALS_XY = 10, 6
#: A table of one row per recorder is sent to every task while it has no more rows than this.
FEW_RECORDERS = 20_000
#: A recorder has settled when its step is shorter than this, in metres, or gains no more than this share of the cost.
SETTLED_M, SETTLED_GAIN = 1e-5, 1e-8


def _is_small(df: DataFrame) -> bool:
    return df.limit(FEW_RECORDERS + 1).count() <= FEW_RECORDERS


def _per_recorder(df: DataFrame) -> DataFrame:
    """One row per recorder: sent to the tasks if its count is small, else merged with the calls by key."""
    return F.broadcast(df) if _is_small(df) else df.hint("merge")


def observations(results: DataFrame) -> DataFrame:
    """Usable rows: at least three recorders, one delay per pair, every pair resolvable."""
    pairs = arrays.local_pairs(F.col("recorders"), F.col("pair_ids")) if "pair_ids" in results.columns else F.col("pairs")
    df = results.withColumn("pairs", pairs)
    n = F.size("recorders")
    return (df.where((n >= 3) & F.col("pairs").isNotNull() & (F.size("pairs") == F.size("tdoas")))
            .where(~F.exists("pairs", lambda p: (p["i"] >= n) | (p["j"] >= n)))
            .select("call_id", "recorders", "pairs", "tdoas"))


def drop_recorder(obs: DataFrame, dropped: str = "drop_rid") -> DataFrame:
    """Remove one recorder from each row's lists and renumber the pairs.

    Rows left with fewer than three recorders or three pairs are removed; rows that do
    not hold the recorder pass unchanged.
    """
    rid, recs = F.col(dropped), F.col("recorders")
    keep = F.filter(recs, lambda r: r != rid)
    z = F.arrays_zip(F.col("pairs").alias("p"), F.col("tdoas").alias("t"))
    left = F.filter(z, lambda s: (F.get(recs, s["p"]["i"]) != rid) & (F.get(recs, s["p"]["j"]) != rid))
    at = lambda i: (F.array_position(F.col("__keep"), F.get(recs, i)) - 1).cast("int")
    held = F.array_contains(recs, rid)
    out = (obs.withColumn("__keep", keep).withColumn("__left", left)
           .withColumn("pairs", F.transform("__left", lambda s: F.struct(at(s["p"]["i"]).alias("i"), at(s["p"]["j"]).alias("j"))))
           .withColumn("tdoas", F.transform("__left", lambda s: s["t"])).withColumn("__held", held)
           .withColumn("recorders", F.col("__keep")))
    return out.where(~F.col("__held") | ((F.size("recorders") >= 3) & (F.size("pairs") >= 3))).drop("__keep", "__left", "__held")


def sources_without(obs: DataFrame, positions: DataFrame, speed: float = 343.2, bounds: tuple[float, float] = (330.0, 360.0),
                    min_recorders: int = 4, min_pairs: int = 6) -> DataFrame:
    """One located source per (call, dropped recorder): call_id, drop_rid, x_src, c_est.

    ``positions``: recorder, x, y, z. Every recorder with a position is left out in turn
    of the calls that hold it.
    """
    positions = _per_recorder(positions)
    known = positions.select(F.col("recorder").alias("drop_rid"))
    each = obs.withColumn("drop_rid", F.explode("recorders")).join(known, "drop_rid", "left_semi")
    sub = drop_recorder(each).where((F.size("recorders") >= min_recorders) & (F.size("pairs") >= min_pairs))
    xyz = (sub.select("call_id", "drop_rid", F.posexplode("recorders").alias("k", "recorder"))
           .join(positions, "recorder").groupBy("call_id", "drop_rid")
           .agg(F.array_sort(F.collect_list(F.struct("k", F.array("x", "y", "z").alias("c")))).alias("g"))
           .select("call_id", "drop_rid", F.transform("g", lambda s: s["c"]).alias("coords")))
    # both sides hold every call: array columns look small to the planner, which must not send one of them to the driver
    ready = sub.hint("merge").join(xyz, ["call_id", "drop_rid"]).where(F.size("coords") == F.size("recorders")).withColumn("speed", F.lit(sum(bounds) / 2))
    out = locate_sources(ready, pairs="pairs", fit_speed=True, speed_margin=(bounds[1] - bounds[0]) / 2,
                         spread_by="call_id")
    return out.select("call_id", "drop_rid", F.col("x_est").alias("x_src"), "c_est")


def residual_rows(obs: DataFrame, sources: DataFrame, positions: DataFrame) -> DataFrame:
    """Every pair touching the dropped recorder: (drop_rid, source, sign, other distance, delay, speed).

    The residual at position p is sign * (|src - p| - d_other) / c - t.
    """
    pos = _per_recorder(positions).select(F.col("recorder").alias("other"), F.array("x", "y", "z").alias("o"))
    flat = (obs.hint("merge").join(sources, "call_id")
            .withColumn("s", F.explode(F.arrays_zip(F.col("pairs").alias("p"), F.col("tdoas").alias("t"))))
            .withColumn("ri", F.get("recorders", F.col("s.p.i"))).withColumn("rj", F.get("recorders", F.col("s.p.j")))
            .where("ri = drop_rid OR rj = drop_rid")
            .withColumn("sign", F.when(F.col("ri") == F.col("drop_rid"), 1.0).otherwise(-1.0))
            .withColumn("other", F.when(F.col("ri") == F.col("drop_rid"), F.col("rj")).otherwise(F.col("ri"))))
    return (flat.join(pos, "other").select("drop_rid", "x_src", "sign", geo.distance(F.col("x_src"), F.col("o")).alias("d_other"),
                                           F.col("s.t").alias("t"), F.col("c_est").alias("c")))


def _systems(rows: DataFrame, places: DataFrame, axes: int, scale: float, loss: str, sigma: float | None, few: bool) -> DataFrame:
    """Normal equations per recorder at its place ``q``: drop_rid, cost, g (axes), h (axes x axes, flat), n.

    ``places``: drop_rid, q, x0. One row per recorder; ``few`` are sent to the tasks, so the rows stay where they are and only sums are shuffled.
    """
    d = F.sqrt(sum((F.col("x_src")[k] - F.col("q")[k]) * (F.col("x_src")[k] - F.col("q")[k]) for k in range(3)))  # spelt out: compiled, as a function over arrays is not
    at = places.select("drop_rid", "q")
    df = rows.join(F.broadcast(at) if few else at.hint("merge"), "drop_rid").withColumn("__d", d)
    df = df.withColumn("r", F.col("sign") * (F.col("__d") - F.col("d_other")) / F.col("c") - F.col("t")).withColumn("__d", F.greatest("__d", F.lit(1e-9)))
    robust = loss == "huber"
    for k in range(axes):
        df = df.withColumn(f"j{k}", F.col("sign") * (F.col("q")[k] - F.col("x_src")[k]) / F.col("__d") / F.col("c"))

    def weighed(r):
        """Weight and loss of a residual."""
        size = F.abs(r)
        if not robust:
            return F.lit(1.0), r * r
        return F.when(size <= scale, 1.0).otherwise(scale / size), F.when(size <= scale, r * r).otherwise(2 * scale * size - scale * scale)

    w, rho = weighed(F.col("r"))
    total = lambda c: F.sum(w * c)
    out = df.groupBy("drop_rid").agg(
        F.count(F.lit(1)).alias("n"), (F.sum(rho) / 2).alias("cost"), F.array(*[total(F.col(f"j{k}") * F.col("r")) for k in range(axes)]).alias("g"),
        F.array(*[total(F.col(f"j{k}") * F.col(f"j{m}")) for k in range(axes) for m in range(axes)]).alias("h"))
    if not sigma:
        return out
    out = out.join(places, "drop_rid")
    u = [(F.col("q")[k] - F.col("x0")[k]) / sigma for k in range(axes)]
    pulls = [weighed(x) for x in u]
    g = F.array(*[F.col("g")[k] + pulls[k][0] * u[k] / sigma for k in range(axes)])
    h = F.array(*[F.col("h")[k * axes + m] + (pulls[k][0] / sigma ** 2 if k == m else 0.0) for k in range(axes) for m in range(axes)])
    return out.select("drop_rid", (F.col("n") + axes).alias("n"), (F.col("cost") + sum(p[1] for p in pulls) / 2).alias("cost"), g.alias("g"), h.alias("h"))


def _step_udf(axes: int):
    """Damped step from a recorder's normal equations, zero on the kept axes."""
    @F.pandas_udf("array<double>")
    def step(g: pd.Series, h: pd.Series, lam: pd.Series) -> pd.Series:
        out = []
        for gi, hi, li in zip(g, h, lam):
            m = np.asarray(hi, float).reshape(axes, axes)
            out.append(np.pad(np.linalg.lstsq(m + np.diag(li * np.maximum(m.diagonal(), 1e-12)), -np.asarray(gi, float), rcond=None)[0], (0, 3 - axes)))
        return pd.Series(out)
    return step


def refine(rows: DataFrame, positions: DataFrame, loss: str = "huber", f_scale: float = 0.003,
           prior_sigma_m: float | None = None, xy_only: bool = False, steps: int = 25) -> DataFrame:
    """Robust refinement of every dropped recorder at once.

    Returns recorder, x, y, z, x0, y0, z0, cost, n_residuals, converged. Recorders with too
    few residuals are left out. With ``xy_only`` the height is kept. The state of all
    recorders is a table, stored after every step; the driver sees how many still move.
    Those that have not settled after ``steps`` steps come out with ``converged`` false.
    """
    axes, need = (2, MIN_RESIDUALS_XY) if xy_only else (3, MIN_RESIDUALS)
    need -= axes if prior_sigma_m else 0
    rows = cut_lineage(rows)
    enough = rows.groupBy("drop_rid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= need).select("drop_rid")
    x0 = F.array("x", "y", "z").cast("array<double>")
    start = enough.join(positions.withColumnRenamed("recorder", "drop_rid"), "drop_rid").select("drop_rid", x0.alias("x0"))
    start = cut_lineage(start.withColumn("q", F.col("x0")))
    few = _is_small(start)  # checkpoints tell the planner no sizes: it would deal all rows anew by recorder in every step
    system = lambda at: _systems(rows, at, axes, f_scale, loss, prior_sigma_m, few)
    state = cut_lineage(start.join(system(start), "drop_rid").withColumn("lam", F.lit(1e-3)).withColumn("converged", F.lit(False)))
    step = _step_udf(axes)
    for _ in range(steps):
        open_ = state.where(~F.col("converged"))
        if open_.isEmpty():
            break
        moved = open_.withColumn("s", step("g", "h", "lam"))
        tried = moved.select("drop_rid", "x0", F.zip_with("q", "s", lambda p, d: p + d).alias("q"))
        new = system(tried).select("drop_rid", *[F.col(c).alias(f"new_{c}") for c in ("cost", "g", "h")])
        met = moved.join(new, "drop_rid").join(tried.select("drop_rid", F.col("q").alias("new_q")), "drop_rid")
        better = F.col("new_cost") < F.col("cost")
        pick = lambda c: F.when(better, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
        still = (F.array_max(F.transform("s", F.abs)) >= SETTLED_M) & ~(better & (F.col("cost") - F.col("new_cost") <= SETTLED_GAIN * F.col("cost")))
        met = met.select("drop_rid", "x0", pick("q"), "n", pick("cost"), pick("g"), pick("h"),
                         F.when(better, F.col("lam") / 5).otherwise(F.col("lam") * 4).alias("lam"), (~still).alias("converged"))
        state = cut_lineage(met.unionByName(state.where("converged")))
    named = [F.col(c)[k].alias(n + tail) for c, tail in (("q", ""), ("x0", "0")) for k, n in enumerate("xyz")]
    return state.select(F.col("drop_rid").alias("recorder"), *named, "cost", F.col("n").cast("bigint").alias("n_residuals"), "converged")


def leave_one_out(results: DataFrame, positions: DataFrame, **options) -> DataFrame:
    """Locate sources without each recorder, then refine that recorder against them."""
    obs = observations(results)
    rows = residual_rows(obs, sources_without(obs, positions), positions)
    return refine(rows, positions, **options)
