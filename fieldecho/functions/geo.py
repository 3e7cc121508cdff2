"""Distances, map projection and polygon tests as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cover

#: Columns of an edge, and cells of a cover handed on at once.
EDGE, CELLS = ("x1", "y1", "x2", "y2"), 4096


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6367.0) -> Column:
    """Great-circle distance in km."""
    dlon, dlat = F.radians(lon2) - F.radians(lon1), F.radians(lat2) - F.radians(lat1)
    a = (F.pow(F.sin(dlat / 2), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2))
    return 2 * radius * F.asin(F.sqrt(a))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance between two coordinate arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


def travel_time(a: Column, b: Column, speed: Column | float = 344.0) -> Column:
    return distance(a, b) / speed


# WGS-84 ellipsoid and the UTM scale and false origin.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
UTM_SCALE, UTM_EAST, UTM_NORTH_SOUTH = 0.9996, 500_000.0, 10_000_000.0


def utm(lon: Column, lat: Column, zone: int, south: bool = False) -> Column:
    """Struct(x, y) in metres: transverse Mercator by the Krueger series to n^4."""
    n = WGS84_F / (2 - WGS84_F)
    big_a = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
             13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
             61 * n**3 / 240 - 103 * n**4 / 140,
             49561 * n**4 / 161280)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - F.lit(zone * 6.0 - 183.0))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x = eta + sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))
    y = xi + sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))
    return F.struct((UTM_EAST + UTM_SCALE * big_a * x).alias("x"),
                    ((UTM_NORTH_SOUTH if south else 0.0) + UTM_SCALE * big_a * y).alias("y"))


def ring_edges(rings: Column) -> Column:
    """array<array<[lon, lat]>> rings -> array of edge structs (x1, y1, x2, y2)."""
    def edges(ring):
        return F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(
            F.get(F.get(ring, i - 1), F.lit(0)).alias("x1"), F.get(F.get(ring, i - 1), F.lit(1)).alias("y1"),
            F.get(F.get(ring, i), F.lit(0)).alias("x2"), F.get(F.get(ring, i), F.lit(1)).alias("y2")))
    return F.flatten(F.transform(rings, edges))


def within(x: Column, y: Column, edges: Column, more: Column | int = 0) -> Column:
    """Strictly inside by even-odd crossing; a point on an edge is outside. Holes are just more rings. ``more`` crossings are known already."""
    crosses = F.size(F.filter(edges, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (
        x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])))
    on_edge = F.exists(edges, lambda e: (
        ((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"]))
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))))
    return ((crosses + more) % 2 == 1) & ~on_edge


def zone_cells(zones: DataFrame, cell: float = 0.01) -> DataFrame:
    """(group, level, cx, cy, crossings, edges): cells of ``cover.LEVELS`` sizes that cover the zones; their number grows with the outline of a
    zone. Cells without edges lie inside. A zone without edges has no cells."""
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for group, edges in zip(frame["group"], frame["edges"]):
                own = cover.cells(np.array([list(e) for e in edges], dtype=float).reshape(-1, 4), cell)
                while part := list(islice(own, CELLS)):
                    level, cx, cy, crossings, kept = zip(*part)
                    yield pd.DataFrame({"group": [group] * len(part), "level": level, "cx": cx, "cy": cy, "crossings": crossings, "edges": [k.tolist() for k in kept]})

    flat = F.transform("edges", lambda e: F.array(*[e[c].cast("double") for c in EDGE]))
    found = zones.where("edges IS NOT NULL").select("group", flat.alias("edges")).mapInPandas(
        work, f"group {zones.schema['group'].dataType.simpleString()}, level int, cx long, cy long, crossings int, edges array<array<double>>")
    return found.withColumn("edges", F.transform("edges", lambda e: F.struct(*[e[i].alias(c) for i, c in enumerate(EDGE)])))


def join_zones(points: DataFrame, zones: DataFrame, x: str = "longitude", y: str = "latitude",
               cell: float = 0.01) -> DataFrame:
    """Left join points to the polygon holding them (``zones``: group, edges).

    Each size of cells is an equi join on the cell of a point, whose residual test runs in the JVM over the few edges of that cell;
    points without coordinates keep a null group. Zones must not overlap.
    """
    out, covered = points, zone_cells(zones, cell)
    for level in range(cover.LEVELS):
        at = lambda c: F.floor(F.col(c) / F.lit(cell * cover.PARTS**level)).cast("bigint")  # noqa: B023, E731
        own = covered.where(F.col("level") == level).select(*[F.col(c).alias(f"__{c}{level}") for c in ("group", "cx", "cy", "crossings", "edges")])
        hit = ((at(x) == F.col(f"__cx{level}")) & (at(y) == F.col(f"__cy{level}"))
               & within(F.col(x), F.col(y), F.col(f"__edges{level}"), F.col(f"__crossings{level}")))
        out = out.join(own, hit, "left").drop(*[f"__{c}{level}" for c in ("cx", "cy", "crossings", "edges")])
    groups = [f"__group{level}" for level in range(cover.LEVELS)]
    return out.withColumn("recorder_group", F.coalesce(*groups)).drop(*groups)
