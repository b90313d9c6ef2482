"""Nearest, radius, grid and ray joins.

Distances are bounded by grid cells: both sides meet in equal cells, so these are equi-joins that
shuffle by cell and never compare all pairs. Nearest neighbours and rays of a table go down through cells
that follow the data (module cells).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cells
from .aggregates import AXES, Box, box_of, whole_point

CELL = ("cx", "cy", "cz")
#: A cell's queries are dealt to this many keys, and its points go to each: no full cell is one task's work.
PARTS = 8


def cell(c: str | Column, size: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / F.lit(float(size)))


def cell_size(radius: float) -> float:
    """A side a little over radius, so that rounding puts no two points within radius two cells apart; any side does for radius 0."""
    return radius * (1 + 1e-9) or 1.0


def gridded(points: DataFrame, size: float) -> DataFrame:
    return points.filter(whole_point()).withColumns({k: cell(a, size) for k, a in zip(CELL, AXES, strict=True)})


def reaching(queries: DataFrame, size: float) -> DataFrame:
    """Each query once for its own cell and once for each of the 26 around it."""
    around = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip((i, j, k), "ijk", strict=True))) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)))
    q = gridded(queries, size).withColumn("__o", F.explode(around))
    return q.withColumns({c: F.col(c) + F.col(f"__o.{n}") for c, n in zip(CELL, "ijk", strict=True)}).drop("__o")


def radius_join(queries: DataFrame, points: DataFrame, radius: float, same: bool = True) -> DataFrame:
    """(q_idx, idx, d2) of all points within radius (inclusive) of each query; same: a point is its own neighbour."""
    q = reaching(queries.select(F.col("idx").alias("q_idx"), *AXES), radius).select("q_idx", *(F.col(a).alias(f"q{a}") for a in AXES), *CELL)
    p = gridded(points.select("idx", *AXES), radius)
    d2 = sum(((F.col(a) - F.col(f"q{a}")) * (F.col(a) - F.col(f"q{a}")) for a in AXES[1:]), (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")))
    near = q.join(p, list(CELL)).select("q_idx", "idx", d2.alias("d2")).filter(F.col("d2") <= F.lit(radius * radius))
    return near if same else near.filter("q_idx != idx")


def nearest_join(queries: DataFrame, points: DataFrame, k: int = 1, most: float | None = None, same: bool = False) -> DataFrame:
    """(q_idx, rank, idx, d2) of the k nearest points of each query, ties by idx, none beyond `most` (inclusive)."""
    found = cells.nearest(queries, points, k, most, same)
    return queries.sparkSession.createDataFrame([], "q_idx long, rank int, idx long, d2 double") if found is None else found


def ray_join(rays: DataFrame, points: DataFrame, tolerance: float) -> DataFrame:
    """(q_id, idx, t, perp2) for a table of rays (q_id, ox, oy, oz, dx, dy, dz): the point of each that ray_pick would pick."""
    found = cells.rays(rays, points, tolerance)
    return rays.sparkSession.createDataFrame([], "q_id long, idx long, t double, perp2 double") if found is None else found


def slab(origin: tuple[Column, ...], direction: tuple[Column, ...], lo: tuple[Column, ...], hi: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    """(hit, entry, exit) of a ray through a box; parallel to an axis: it must start between the two sides."""
    hit, enters, leaves = F.lit(True), [], []
    for o, d, a, b in zip(origin, direction, lo, hi, strict=True):
        flat = F.abs(d) < 1e-9
        safe = F.when(flat, F.lit(1.0)).otherwise(d)
        t1, t2 = (a - o) / safe, (b - o) / safe
        enters.append(F.when(flat, F.lit(float("-inf"))).otherwise(F.least(t1, t2)))
        leaves.append(F.when(flat, F.lit(float("inf"))).otherwise(F.greatest(t1, t2)))
        hit = hit & (~flat | ((o >= a) & (o <= b)))
    entry, leave = F.greatest(*enters), F.least(*leaves)
    return hit & (entry <= leave), entry, leave


def ray_pick(points: DataFrame, rays: list[tuple[int, tuple, tuple]], tolerance: float) -> DataFrame:
    """(q_id, idx, t, perp2): of the points within tolerance of each ray, the one nearest to it (ties by idx).

    rays (id, origin, direction) are parameters, not a table: a few rays are literals of one pass over
    points, each clipped to the bounds; only the best candidate of each ray leaves a task.
    """
    box: Box | None = box_of(points)
    made = []
    for q, o, d in rays if box else ():
        n = math.sqrt(sum(c * c for c in d))
        if not n:
            continue
        d = tuple(c / n for c in d)
        grown = box.grown(tolerance)
        entry, leave, hit = -math.inf, math.inf, True
        for i, a in enumerate(AXES):
            lo, hi = getattr(grown, f"min_{a}"), getattr(grown, f"max_{a}")
            if abs(d[i]) < 1e-9:
                hit = hit and lo <= o[i] <= hi
            else:
                t1, t2 = (lo - o[i]) / d[i], (hi - o[i]) / d[i]
                entry, leave = max(entry, min(t1, t2)), min(leave, max(t1, t2))
        if hit and entry <= leave and leave >= 0:
            made.append((q, o, d, max(entry, 0.0), leave))
    if not made:
        return points.sparkSession.createDataFrame([], "q_id int, idx long, t double, perp2 double")
    rows = F.array(*(F.struct(F.lit(q).alias("q_id"), *(F.lit(float(v)).alias(n) for n, v in zip(("ox", "oy", "oz", "dx", "dy", "dz", "t0", "t1"), (*o, *d, a, b), strict=True))) for q, o, d, a, b in made))
    p = points.filter(whole_point()).select("idx", *AXES, F.explode(rows).alias("r"))
    v = [F.col(a) - F.col(f"r.o{a}") for a in AXES]
    t = v[0] * F.col("r.dx") + v[1] * F.col("r.dy") + v[2] * F.col("r.dz")
    p = p.withColumn("t", t)
    w = [F.col(a) - (F.col(f"r.o{a}") + F.col(f"r.d{a}") * F.col("t")) for a in AXES]
    p = p.withColumn("perp2", w[0] * w[0] + w[1] * w[1] + w[2] * w[2])
    near = p.filter((F.col("t") >= F.col("r.t0") - tolerance) & (F.col("t") <= F.col("r.t1") + tolerance) & (F.col("perp2") <= tolerance * tolerance))
    return near.groupBy("r.q_id").agg(F.min(F.struct("perp2", "idx", "t")).alias("b")).select("q_id", "b.idx", "b.t", "b.perp2")


def _neighbourhoods(points: DataFrame, radius: float) -> DataFrame:
    """covariance, and the places that a neighbourhood's points lie at.

    Pairs are summed up where they meet, as offsets from the query: what leaves a task is at most one row for each query and
    cell around it, never a pair. Points at one place are counted and not compared; they get the same row to the last bit.
    """
    size = cell_size(radius)
    places = points.filter(whole_point()).groupBy(*AXES).agg(F.count("*").alias("w"))
    at = [f"q{a}" for a in AXES]
    q = reaching(places, size).select(*(F.col(a).alias(k) for a, k in zip(AXES, at, strict=True)), *CELL, F.pmod(F.xxhash64(*AXES), F.lit(PARTS)).cast("int").alias("part"))
    p = gridded(places, size).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    off = q.join(p.hint("merge"), [*CELL, "part"]).select(*at, "w", *((F.col(a) - F.col(k)).alias(a) for a, k in zip(AXES, at, strict=True)))
    near = off.filter(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z") <= F.lit(radius * radius))
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    sums = near.groupBy(*at).agg(F.sum("w").alias("n"), F.count("*").alias("places"), *(F.sum(F.col("w") * F.col(a)).alias(f"s{a}") for a in AXES), *(F.sum(F.col("w") * F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in pairs))
    mean = {a: F.col(f"s{a}") / F.col("n") for a in AXES}
    cov = {(a, b): F.col(f"s{a}{b}") / F.col("n") - mean[a] * mean[b] for a, b in pairs}
    found = sums.select("n", "places", *(F.col(k).alias(a) for a, k in zip(AXES, at, strict=True)), *((F.col(k) + mean[a]).alias(f"m{a}") for a, k in zip(AXES, at, strict=True)), *((F.greatest(c, F.lit(0.0)) if a == b else c).alias(f"c{a}{b}") for (a, b), c in cov.items()))
    return points.select("idx", *AXES).join(found, list(AXES)).select("idx", "n", *(f"m{a}" for a in AXES), *(f"c{a}{b}" for a, b in pairs), "places")


def covariance(points: DataFrame, radius: float) -> DataFrame:
    """Neighbours, centroid and population covariance of each point's neighbourhood."""
    return _neighbourhoods(points, radius).drop("places")


def curvature(points: DataFrame, radius: float) -> DataFrame:
    """1 - least eigenvalue / trace of each neighbourhood's covariance, in closed form; 0 with fewer than 3 neighbours or no spread, 1 (to the last bit) with no more than 3 places, which are always in a plane."""
    c = _neighbourhoods(points, radius)
    a, b, d = F.col("cxx"), F.col("cyy"), F.col("czz")
    xy, xz, yz = F.col("cxy"), F.col("cxz"), F.col("cyz")
    tr = a + b + d
    q = tr / 3
    p1 = xy * xy + xz * xz + yz * yz
    p2 = (a - q) * (a - q) + (b - q) * (b - q) + (d - q) * (d - q) + 2 * p1
    p = F.sqrt(p2 / 6)
    safe = F.when(p > 0, p).otherwise(F.lit(1.0))
    ba, bb, bd, bxy, bxz, byz = ((v / safe) for v in (a - q, b - q, d - q, xy, xz, yz))
    half_det = (ba * (bb * bd - byz * byz) - bxy * (bxy * bd - byz * bxz) + bxz * (bxy * byz - bb * bxz)) / 2
    phi = F.acos(F.least(F.greatest(half_det, F.lit(-1.0)), F.lit(1.0))) / 3
    least = F.when(p > 0, q + 2 * p * F.cos(phi + 2 * math.pi / 3)).otherwise(q)
    least = F.when(F.col("places") <= 3, 0.0).otherwise(least)
    flat = F.least(F.greatest(least / F.when(tr > 0, tr).otherwise(F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    return c.select("idx", "n", F.when((F.col("n") >= 3) & (tr > 0), 1.0 - flat).otherwise(F.lit(0.0)).alias("curvature"))
