"""Octree leaves and frustum queries as columns and small node tables.

A point's path has one digit 0-7 for each level. Counts are taken of full paths first (at most 8^depth
rows, whatever the number of points), nodes from those; the leaf of a path is its shortest prefix with
few enough points. Nothing but distinct paths is joined back, on equal keys.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import AXES, Box, box_of, whole_point
from .lineage import written

NEAR, FAR = 0.1, 10_000.0
#: Up to this depth the ends of an axis' cells are a literal of 2^depth numbers.
LOOKUP_DEPTH = 12
EMPTY = Box(*[0.0] * 6)  # of a cloud without points


def octant(x: Column, y: Column, z: Column, center: tuple[Column, Column, Column]) -> Column:
    bits = [F.coalesce((c >= m).cast("int"), F.lit(0)) for c, m in zip((x, y, z), center, strict=True)]
    return bits[0] + bits[1] * 2 + bits[2] * 4


def edges(low: float, high: float, depth: int) -> list[float]:
    """The lower ends of an axis' 2^depth cells, halved level by level, so they agree with a recursive split to the last bit."""
    out = [low, high]
    for _ in range(depth):
        out = [v for a, b in zip(out, out[1:], strict=False) for v in (a, (a + b) / 2)] + [high]
    return out[:-1]


def _looked_up(low: float, high: float, depth: int) -> bool:
    """Whether division finds a cell but for one: cells are much wider than the rounding of the ends."""
    return depth <= LOOKUP_DEPTH and math.isfinite(high - low) and (high - low) / (1 << depth) > 64 * math.ulp(max(abs(low), abs(high)))


def _folded(c: Column, low: float, high: float, depth: int) -> Column:
    def halve(at: Column, _: Column) -> Column:
        mid = (at["low"] + at["high"]) / 2
        up = F.coalesce(c >= mid, F.lit(False))
        return F.struct(F.when(up, mid).otherwise(at["low"]).alias("low"), F.when(up, at["high"]).otherwise(mid).alias("high"), (at["cell"] * 2 + up.cast("long")).alias("cell"))

    whole = F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(0).cast("long").alias("cell"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), whole, halve)["cell"] if depth else F.lit(0).cast("long")


def cells(points: DataFrame, box: Box, depth: int = 8) -> DataFrame:
    """points (whole ones) with their cell on each axis, 0 .. 2^depth - 1, as __cx, __cy, __cz: what lies outside the box is in an outermost one, NaN in the last.

    A guess by division is corrected by the ends of the cells, in a projection of its own, so no expression grows with the depth.
    """
    last = (1 << depth) - 1
    sides = {a: (float(getattr(box, f"min_{a}")), float(getattr(box, f"max_{a}"))) for a in AXES}
    guesses, found = {}, {}
    for a, (low, high) in sides.items():
        c, g = F.col(a), F.col(f"__g{a}")
        if _looked_up(low, high, depth):
            ends = F.lit(np.array([*edges(low, high, depth), math.inf]))
            guesses[f"__g{a}"] = F.when(F.isnan(c), F.lit(last)).otherwise(F.least(F.greatest(F.floor((c - low) * ((last + 1) / (high - low))), F.lit(0)), F.lit(last))).cast("int")
            below = (g > 0) & (c < F.element_at(ends, g + 1))
            above = (g < last) & (c >= F.element_at(ends, g + 2))
            found[f"__c{a}"] = (g - below.cast("int") + above.cast("int")).cast("long")
        else:
            found[f"__c{a}"] = _folded(c, low, high, depth)
    return points.filter(whole_point()).withColumns(guesses).withColumns(found).drop(*guesses)


def _digit(level: int, depth: int) -> Column:
    bits = [F.shiftright(f"__c{a}", depth - 1 - level).bitwiseAND(1) for a in AXES]
    return bits[0] + bits[1] * 2 + bits[2] * 4


def path_of_cells(depth: int) -> Column:
    """The path of the cell __cx, __cy, __cz. It is never null, and says so: a test for null would be pushed down with a copy of every cell in each digit."""
    digits = [_digit(k, depth).cast("string") for k in range(depth)]
    return F.coalesce(F.concat(*digits), F.lit("")) if digits else F.lit("")


def paths(points: DataFrame, box: Box, depth: int = 8) -> DataFrame:
    """points (whole ones) with path."""
    return cells(points, box, depth).withColumn("path", path_of_cells(depth)).drop(*(f"__c{a}" for a in AXES))


def nodes(with_paths: DataFrame, most: int, depth: int = 8) -> DataFrame:
    """(node, depth, n, leaf) of every node of the tree: leaves hold `most` points at most, or lie at the last level."""
    return tree_of(with_paths.groupBy("path").agg(F.count("*").alias("n")), most, depth)


def tree_of(full: DataFrame, most: int, depth: int, *more: Column) -> DataFrame:
    """Like nodes, from the number n of points of each path; more: named aggregates over the other columns of full, which nodes then hold too."""
    prefixes = full.withColumn("node", F.explode(_prefixes("path", depth))).drop("path")
    counts = prefixes.groupBy("node").agg(F.sum("n").alias("n"), *more).withColumn("depth", F.length("node"))
    split = (F.col("n") > most) & (F.col("depth") < depth)
    parents = counts.filter(split).select(F.col("node").alias("parent"))
    inner = counts.filter("depth = 0").unionByName(counts.filter("depth > 0").join(parents, F.expr("substring(node, 1, depth - 1)") == F.col("parent"), "left_semi"))
    return inner.select("node", "depth", "n", (~split).alias("leaf"), *(c for c in counts.columns if c not in ("node", "depth", "n")))


def _prefixes(path: str, depth: int) -> Column:
    return F.array(*(F.substring(path, 1, d) for d in range(depth + 1)))


def with_leaf(placed: DataFrame, full: DataFrame, leaf: DataFrame, depth: int) -> DataFrame:
    """placed (points with path) of these leaves, with leaf; full: their distinct paths."""
    ups = full.select("path", F.explode(_prefixes("path", depth)).alias("leaf"))
    return placed.join(ups.join(leaf, "leaf"), "path").drop("path")


def leaves(points: DataFrame, most: int, depth: int = 8, box: Box | None = None) -> DataFrame:
    """points with leaf (path of their leaf). Paths are counted once and written."""
    placed = paths(points, box or box_of(points) or EMPTY, depth)
    full = written(placed.groupBy("path").agg(F.count("*").alias("n")))
    return with_leaf(placed, full, tree_of(full, most, depth).filter("leaf").select(F.col("node").alias("leaf")), depth)


def stats(tree: DataFrame) -> DataFrame:
    leaf = F.col("leaf")
    return tree.agg(F.count("*").alias("total_nodes"), F.count_if(leaf).alias("leaf_count"), F.avg(F.when(leaf, F.col("n"))).alias("avg_points_per_leaf"), F.max("depth").alias("max_depth"))


def node_box(node: Column, box: Box) -> Column:
    """The box of a node as a struct: a fold over the digits of its path, so the expression has one size at every depth."""
    names = [f"{n}_{a}" for n in ("min", "max") for a in AXES]
    whole = F.struct(*(F.lit(float(getattr(box, n))).alias(n) for n in names))

    def halve(b: Column, digit: Column) -> Column:
        mid = {a: (b[f"min_{a}"] + b[f"max_{a}"]) / 2 for a in AXES}
        up = {a: F.shiftright(digit, i).bitwiseAND(1) == 1 for i, a in enumerate(AXES)}
        low = [F.when(up[a], mid[a]).otherwise(b[f"min_{a}"]).alias(f"min_{a}") for a in AXES]
        return F.struct(*low, *(F.when(up[a], b[f"max_{a}"]).otherwise(mid[a]).alias(f"max_{a}") for a in AXES))

    digits = F.transform(F.filter(F.split(node, ""), lambda d: d != ""), lambda d: d.cast("int"))
    return F.aggregate(digits, whole, halve)


def box_corners(lo: tuple[Column, ...], hi: tuple[Column, ...]) -> list[tuple[Column, Column, Column]]:
    return [tuple(hi[i] if k >> i & 1 else lo[i] for i in range(3)) for k in range(8)]


def unit(v: tuple[float, float, float]) -> tuple[float, float, float]:
    n = math.sqrt(sum(c * c for c in v))
    return tuple(c / n for c in v) if n else v


def cross(a: tuple, b: tuple) -> tuple[float, float, float]:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def frustum(eye: tuple, target: tuple, up: tuple = (0.0, 0.0, 1.0), fov: float = 35.0, aspect: float = 1.0, near: float = NEAR, far: float = FAR) -> list[tuple[tuple, tuple]]:
    """Six planes (point, inward normal) of a perspective camera: near, far and four sides through the eye. No planes without a direction or a field of view."""
    forward = tuple(t - e for t, e in zip(target, eye, strict=True))
    if not any(forward) or fov <= 0:
        return []
    forward = unit(forward)
    near = near if near > 0 else NEAR
    far = far if far > near else FAR
    side = cross(forward, unit(up) if any(up) else (0.0, 0.0, 1.0))
    if not any(side):
        side = cross(forward, (0.0, 0.0, 1.0))
    side = unit(side) if any(side) else (1.0, 0.0, 0.0)
    above = unit(cross(side, forward))
    at = lambda d: tuple(e + f * d for e, f in zip(eye, forward, strict=True))
    height = math.tan(math.radians(fov) * 0.5)
    width = height * aspect
    corner = lambda v, h: tuple(f + a * v * height + s * h * width for f, a, s in zip(forward, above, side, strict=True))
    out = [(at(near), forward), (at(far), tuple(-c for c in forward))]
    rim = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    for k in range(4):  # once around the far end: each side spans two neighbouring corners
        normal = cross(corner(*rim[k]), corner(*rim[(k + 1) % 4]))
        if any(normal):
            normal = unit(normal)
            if sum(n * f for n, f in zip(normal, forward, strict=True)) < 0:
                normal = tuple(-n for n in normal)
            out.append((tuple(eye), normal))
    return out


def plane_distance(plane: tuple[tuple, tuple], at: tuple[Column, Column, Column]) -> Column:
    (px, py, pz), (nx, ny, nz) = plane
    return (at[0] - px) * nx + (at[1] - py) * ny + (at[2] - pz) * nz


def _extreme(box: Column, plane: tuple[tuple, tuple], most: bool) -> Column:
    """The largest (or least) distance of a corner of the box: each axis takes its own end, as rounded sums grow with their terms."""
    pick = F.greatest if most else F.least
    part = [pick(*((box[f"{n}_{a}"] - plane[0][i]) * plane[1][i] for n in ("min", "max"))) for i, a in enumerate(AXES)]
    return part[0] + part[1] + part[2]


def intersects(box: Column, planes: list) -> Column:
    """Not all corners of the box (a struct) lie behind one plane."""
    out = F.lit(bool(planes))
    for p in planes:
        out = out & (_extreme(box, p, True) >= 0.0)
    return out


def contains(box: Column, planes: list) -> Column:
    out = F.lit(bool(planes))
    for p in planes:
        out = out & (_extreme(box, p, False) >= 0.0)
    return out


def marked(tree: DataFrame, box: Box, planes: list) -> DataFrame:
    """tree with meets and inside, written: else the optimizer would carry the test below counts and to the other side of joins, onto every row there.

    The box is named once (a lambda variable), so no optimizer rule multiplies its expression.
    """
    both = F.transform(F.array(node_box(F.col("node"), box)), lambda b: F.struct(intersects(b, planes).alias("meets"), contains(b, planes).alias("inside")))
    return written(tree.withColumn("__m", both[0]).select(*tree.columns, F.col("__m.meets").alias("meets"), F.col("__m.inside").alias("inside")))


def frustum_leaves(tree: DataFrame, box: Box, planes: list) -> DataFrame:
    """The leaves that meet the frustum, and whether they lie inside. A box behind a plane has all its children behind it, so leaves alone decide."""
    return marked(tree.filter("leaf"), box, planes).filter("meets").select("node", "depth", "n", "inside")


def frustum_query(points: DataFrame, planes: list, most: int, depth: int = 8) -> DataFrame:
    """All points of the leaves that meet the frustum (whole leaves, no test of single points), with leaf."""
    box = box_of(points) or EMPTY
    placed = paths(points, box, depth)
    full = written(placed.groupBy("path").agg(F.count("*").alias("n")))
    seen = frustum_leaves(tree_of(full, most, depth), box, planes).select(F.col("node").alias("leaf"))
    return with_leaf(placed, full, seen, depth)


def frustum_stats(tree: DataFrame, box: Box, planes: list) -> DataFrame:
    """Nodes visited and culled, and points returned. Below a node inside the frustum nothing is visited."""
    known = marked(tree, box, planes)
    stop = known.filter(~F.col("meets") | F.col("inside")).select(F.col("node").alias("above"))
    ups = known.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.length("node")), lambda d: F.substring(F.col("node"), F.lit(1), d))).alias("above")).filter(F.length("above") < F.col("depth"))
    hidden = ups.join(stop, "above", "left_semi").select("node").distinct()
    seen = known.join(hidden, "node", "left_anti")
    taken = F.col("inside") | (F.col("leaf") & F.col("meets"))
    return seen.agg(F.count("*").alias("visited"), F.count_if(~F.col("meets")).alias("culled"), F.coalesce(F.sum(F.when(taken, F.col("n"))), F.lit(0)).alias("points"))


def depth_color(depth: Column) -> Column:
    """A debug colour of each level: hue by depth modulo 8, saturation 0.6, value 0.9."""
    from ..functions.color import pack

    out = F.lit(0).cast("long")
    for k in range(8):
        h, s, v = k / 8 * 6.0, 0.6, 0.9
        i, f = int(h), h - int(h)
        p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
        rgb = [(v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q)][i % 6]
        out = F.when(depth % 8 == k, pack(*(F.round(F.lit(c) * 255) for c in rgb))).otherwise(out)
    return out
