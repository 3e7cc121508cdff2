"""Array functions: all higher-order expressions, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    A column used inside a lambda is otherwise recomputed for every array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def mean_abs(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(F.transform(a, F.abs)) / F.size(a))


def sparse_pairs(probs: Column, threshold: float) -> Column:
    """Dense probabilities -> [(class_idx, prob)] at or above the threshold."""
    pairs = F.transform(probs, lambda p, i: F.struct(i.cast("int").alias("class_idx"), p.alias("prob")))
    return F.filter(pairs, lambda s: s["prob"] >= threshold)


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    norm = F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    return let(F.when(norm < eps, F.lit(1.0)).otherwise(norm), lambda n: F.transform(v, lambda x: x.cast("double") / n))


def peak_scale(v: Column, target: float = 1.0, eps: float = 1e-7) -> Column:
    """Scale so the largest magnitude is ``target``; unchanged below ``eps``."""
    return _scale(v, F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))), target, eps)


def _scale(v: Column, top: Column, target: float, eps: float) -> Column:
    gain = F.when(top < eps, F.lit(1.0)).otherwise(F.lit(target) / top)
    return let(gain, lambda g: F.transform(v, lambda x: x.cast("double") * g))


def percentile_abs(v: Column, p: float = 99.0) -> Column:
    """Linear-interpolated percentile of the magnitudes of one array."""
    pos = (F.size(v) - 1) * F.lit(p / 100.0)
    lo = F.floor(pos).cast("int")

    def between(s: Column) -> Column:
        a, b = F.get(s, lo), F.coalesce(F.get(s, lo + 1), F.get(s, lo))
        return a + (pos - lo) * (b - a)

    return F.coalesce(let(F.array_sort(F.transform(v, lambda x: F.abs(x.cast("double")))), between), F.lit(0.0))


def percentile_scale(v: Column, p: float = 99.0, target: float = 0.99, eps: float = 1e-7) -> Column:
    return let(percentile_abs(v, p), lambda top: _scale(v, top, target, eps))


def argmax(a: Column) -> Column:
    """Zero-based index of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def rolling_max(a: Column, w: int) -> Column:
    """Centered maximum over +-w samples; outside the array counts as zero."""
    if w == 0:
        return a
    return let(_padded(a, w, w), lambda p: F.transform(
        F.sequence(F.lit(1), F.size(a)), lambda i: F.array_max(F.slice(p, i, 2 * w + 1))))


def _padded(a: Column, left: int, right: int) -> Column:
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    return F.concat(zeros(left), F.transform(a, lambda x: x.cast("double")), zeros(right))


def rolling_argmax(a: Column, w: int) -> Column:
    """Offset in [-w, w] of the centered maximum (earliest on ties, outside counts as zero)."""
    if w == 0:
        return F.transform(a, lambda x: F.lit(0))
    return let(_padded(a, w, w), lambda p: F.transform(
        F.sequence(F.lit(1), F.size(a)), lambda i: let(F.slice(p, i, 2 * w + 1), argmax) - w))


def moving_average(a: Column, w: int) -> Column:
    """Centered mean of ``w`` samples, zero beyond the ends, same length as the input."""
    return let(_padded(a, w // 2, (w - 1) // 2), lambda p: F.transform(
        F.sequence(F.lit(1), F.size(a)), lambda i: total(F.slice(p, i, w)) / w))


def runs_of_ones(a: Column) -> Column:
    """[(start, end)) of each run of ones, zero-based, end exclusive."""
    flag = lambda i: F.coalesce(F.get(a, i), F.lit(0)) == 1
    idx = F.sequence(F.lit(0), F.size(a))
    starts = F.filter(idx, lambda i: flag(i) & ~flag(i - 1))
    ends = F.filter(idx, lambda i: ~flag(i) & flag(i - 1))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), e.alias("end")))


def half_energy_index(a: Column) -> Column:
    """First index whose running energy reaches half of the total; 0 for silence."""
    energy = F.transform(a, lambda x: x.cast("double") * x.cast("double"))
    start = F.struct(F.lit(0.0).alias("run"), F.lit(-1).alias("hit"), F.lit(0).alias("i"))
    first = let(total(energy) / 2, lambda half: F.aggregate(energy, start, lambda s, v: F.struct(
        (s["run"] + v).alias("run"),
        F.when((s["hit"] < 0) & (s["run"] + v >= half), s["i"]).otherwise(s["hit"]).alias("hit"),
        (s["i"] + 1).alias("i")), lambda s: s["hit"]))
    return F.greatest(first, F.lit(0))


def local_pairs(recorders: Column, pairs: Column) -> Column:
    """Pairs of recorder ids -> zero-based positions; null array if any id is missing."""
    at = lambda r: (F.array_position(recorders, r) - 1).cast("int")
    out = F.transform(pairs, lambda p: F.struct(at(p["i"]).alias("i"), at(p["j"]).alias("j")))
    return F.when(~F.exists(out, lambda p: (p["i"] < 0) | (p["j"] < 0)), out)


def signed_pair_error(recorders: Column, pairs: Column, errors: Column) -> Column:
    """Per-recorder sum of pair errors: +e for the first, -e for the second."""
    zipped = F.zip_with(pairs, errors, lambda p, e: F.struct(p["i"].alias("i"), p["j"].alias("j"), e.alias("e")))
    idx = F.sequence(F.lit(0), F.size(recorders) - 1)
    return let(zipped, lambda zs: F.transform(idx, lambda k: F.aggregate(zs, F.lit(0.0), lambda s, z: s + F.when(
        z["i"] == k, z["e"]).when(z["j"] == k, -z["e"]).otherwise(F.lit(0.0)))))
