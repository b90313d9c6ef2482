"""Nearest neighbours and rays through cells that follow the data, against all pairs."""

import math
import random

import pytest

from cloudloom.operators import cells, spatial

POINT = "idx long, x double, y double, z double"


def uneven(seed=4, n=300):
    """A dense spot, a line, two far outliers, and a place that holds a third of the points."""
    r = random.Random(seed)
    rows = [(r.gauss(0, 1e-3), r.gauss(0, 1e-3), r.gauss(0, 1e-3)) for _ in range(n)]
    rows += [(k / n, k / n, 2 * k / n) for k in range(n)] + [(1e7, 0.0, 0.0), (-1e6, 3e6, 1.0)] + [(0.5, 0.25, 0.125)] * n
    return [(k, *p) for k, p in enumerate(rows)] + [(9001, None, 0.0, 0.0), (9002, math.nan, 0.0, 0.0), (9003, math.inf, 0.0, 0.0)]


def distance2(p, q):
    return (p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]) + (p[2] - q[2]) * (p[2] - q[2])


@pytest.mark.parametrize(("k", "most", "same"), [(1, None, False), (5, None, False), (3, 0.01, True)])
def test_nearest_same_as_all_pairs(spark, k, most, same):
    rows = uneven()
    whole = [r for r in rows if None not in r and all(map(math.isfinite, r[1:]))]
    asked = [r for r in whole if r[0] % 40 == 0 or r[0] in (600, 601)]
    df = spark.createDataFrame(rows, POINT)
    got = cells.nearest(spark.createDataFrame([*asked, (9009, None, 1.0, 1.0)], POINT), df, k, most, same, size=16)
    want = {}
    for q in asked:
        near = sorted((distance2(p[1:], q[1:]), p[0]) for p in whole if same or p[0] != q[0])
        for rank, (d, i) in enumerate(near[:k]):
            if most is None or d <= most * most:
                want[q[0], rank + 1] = (i, d)
    assert {(r["q_idx"], r["rank"]): (r["idx"], r["d2"]) for r in got.collect()} == want


def test_few_cells_are_searched(spark):
    """A query far outside meets few cells, and an outlier leaves no cell with most points."""
    r = random.Random(7)
    n = 4000
    df = spark.createDataFrame([(k, r.random(), r.random(), r.random()) for k in range(n)] + [(n, 1e9, 1e9, 1e9)], POINT)
    grown = cells.grow(df, 32)
    assert grown.nodes.filter("leaf").agg({"n": "max"}).first()[0] <= 32
    assert sum(x["n"] for x in grown.nodes.filter("leaf").collect()) == n + 1 == grown.points.count()
    met = []
    real = cells.descend
    def seen(front, of, keep):
        out = real(front, of, keep)
        met.append(out.groupBy("q_idx").sum("n").collect())
        return out
    cells.descend = seen
    try:
        asked = spark.createDataFrame([(-1, -50.0, 0.5, 0.5), (-2, 0.5, 0.5, 0.5), (n, 1e9, 1e9, 1e9)], POINT)
        assert cells.nearest(asked, df, 3, size=32).count() == 9
    finally:
        cells.descend = real
    assert max(r[1] for r in met[0]) < n / 4


def test_rays_same_as_all_pairs(spark):
    rows = uneven()
    whole = [r for r in rows if None not in r and all(map(math.isfinite, r[1:]))]
    r = random.Random(2)
    lines = [(k, *(r.gauss(0, 0.3) for _ in range(3)), *(r.gauss(0, 1) for _ in range(3))) for k in range(20)]
    for k in range(20, 40):  # towards the line of points
        o, u = [r.gauss(0, 2) for _ in range(3)], r.random()
        lines.append((k, *o, *(c - v for c, v in zip((u, u, 2 * u), o, strict=True))))
    lines += [(100, 0.5, 0.25, -5.0, 0.0, 0.0, 2.0), (101, 0.5, 0.25, 5.0, 0.0, 0.0, 2.0), (102, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (103, None, 0.0, 0.0, 1.0, 0.0, 0.0), (104, 1e7, 0.01, 50.0, 0.0, 1e-10, -1.0), (105, 0.0, 0.0, 0.0, math.nan, 0.0, 1.0)]
    want, tol = {}, 0.05
    for q, *v in lines:
        if None in v or not all(map(math.isfinite, v)):
            continue
        o, d = v[:3], v[3:]
        n = math.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
        if not n:
            continue
        d = [c / n for c in d]
        best = []
        for i, *p in whole:
            t = (p[0] - o[0]) * d[0] + (p[1] - o[1]) * d[1] + (p[2] - o[2]) * d[2]
            w = [p[j] - (o[j] + d[j] * t) for j in range(3)]
            perp2 = w[0] * w[0] + w[1] * w[1] + w[2] * w[2]
            if t >= -tol and perp2 <= tol * tol:
                best.append((perp2, i, t))
        if best:
            want[q] = min(best)
    got = cells.rays(spark.createDataFrame(lines, "q_id long, ox double, oy double, oz double, dx double, dy double, dz double"), spark.createDataFrame(rows, POINT), tol, size=16)
    assert {r["q_id"]: (r["perp2"], r["idx"], r["t"]) for r in got.collect()} == want and len(want) > 10 and 100 in want and 101 not in want


def test_no_points_and_one(spark):
    none, one = spark.createDataFrame([], POINT), spark.createDataFrame([(1, 2.0, 3.0, 4.0)], POINT)
    assert spatial.nearest_join(one, none).count() == 0 and spatial.nearest_join(none, one).count() == 0
    assert spatial.nearest_join(one, one).count() == 0 and spatial.nearest_join(one, one, same=True).first()["d2"] == 0.0
    lines = "q_id long, ox double, oy double, oz double, dx double, dy double, dz double"
    assert spatial.ray_join(spark.createDataFrame([], lines), one, 1.0).count() == 0 and spatial.ray_join(spark.createDataFrame([], lines), none, 1.0).count() == 0
