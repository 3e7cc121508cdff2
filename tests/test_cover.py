"""Zone cover by cells of several sizes against the test over all edges."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from fieldecho.functions import cover, geo


def ring(points):
    return np.array([(*a, *b) for a, b in zip(points, points[1:] + points[:1])], dtype=float)


def star(cx, cy, inner, outer, n):
    at = lambda i, r: (cx + r * math.cos(2 * math.pi * i / n), cy + r * math.sin(2 * math.pi * i / n))
    return ring([at(i, outer if i % 2 else inner) for i in range(n)])


def inside(edges, x, y):
    """Even-odd rule over all edges; points on an edge are outside."""
    n = 0
    for a, b, c, d in edges:
        if (c - a) * (y - b) == (d - b) * (x - a) and min(a, c) <= x <= max(a, c) and min(b, d) <= y <= max(b, d):
            return False
        n += (b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a
    return n % 2 == 1


def zone_frame(spark, zones):
    rows = [(name, [tuple(map(float, e)) for e in edges]) for name, edges in zones.items()]
    return spark.createDataFrame(rows, "group string, edges array<struct<x1 double, y1 double, x2 double, y2 double>>")


def test_cells_are_disjoint_and_decide_as_all_edges():
    rnd = random.Random(2)
    shapes = [star(0.3, -0.2, 0.2, 0.5, 41), np.concatenate([ring([(0, 0), (1, 0), (1, 1), (0, 1)]), ring([(0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6)])]), ring([(0, 0), (3, 0.01), (0, 0.02)])]
    for edges in shapes:
        found = {}
        for level, cx, cy, base, kept in cover.cells(edges, 0.01):
            assert (level, cx, cy) not in found
            found[level, cx, cy] = base, kept
        ends = [tuple(e[:2]) for e in edges]
        points = [(rnd.uniform(-0.3, 1.1), rnd.uniform(-0.8, 1.1)) for _ in range(3000)] + ends + [((a + c) / 2, (b + d) / 2) for a, b, c, d in edges]
        for x, y in points:
            got = []
            for level in range(cover.LEVELS):
                size = 0.01 * cover.PARTS**level
                hit = found.get((level, math.floor(x / size), math.floor(y / size)))
                if hit is not None:
                    base, kept = hit
                    own = inside(np.concatenate([kept, ring([(x + 1, y - 1), (x + 1, y + 1)])[:1]]) if base else kept, x, y)
                    got.append(own)
            assert len(got) <= 1 and any(got) == inside(edges, x, y)


def test_number_of_cells_follows_the_outline():
    count = lambda r: sum(1 for _ in cover.cells(star(0, 0, r, r, 1500), 0.01))
    small, large = count(1.25), count(5.0)  # the large one has 16 times the area, and 785,000 cells of the smallest size
    assert large < 8 * small and large < 20_000
    assert sum(1 for _ in cover.cells(ring([(0, 0), (10, 0), (10, 10), (0, 10)]), 0.01)) < 1000


def test_join_takes_awkward_rows(spark):
    zones = zone_frame(spark, {"A": star(0, 0, 0.3, 0.5, 30), "B": ring([(2, 0), (3, 0), (3, 1), (2, 1)]), "none": []}).unionByName(
        spark.createDataFrame([("null", None)], "group string, edges array<struct<x1 double, y1 double, x2 double, y2 double>>"))
    points = spark.createDataFrame([(1, 0.1, 0.1, "x"), (1, 0.1, 0.1, "x"), (2, 2.5, 0.5, "x"), (3, 2.0, 0.5, "x"), (4, None, 0.5, "x"), (5, 9.0, 9.0, "x"), (6, float("nan"), 0.5, "x")],
                                   "k int, longitude double, latitude double, level string")
    got = sorted((r["k"], r["recorder_group"]) for r in geo.join_zones(points, zones).collect())
    assert got == [(1, "A"), (1, "A"), (2, "B"), (3, None), (4, None), (5, None), (6, None)]
    assert geo.join_zones(points.limit(0), zones).count() == 0
    assert geo.join_zones(points, zones.limit(0)).where(F.col("recorder_group").isNotNull()).count() == 0
