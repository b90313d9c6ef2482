"""Cells that follow the data, and searches that descend through them level by level.

Each axis is first stretched to its quantiles, so that a far outlier or a dense spot does not leave most points in one cell;
in these coordinates points get octree paths, and a cell is split until it holds few enough points. Every node keeps its number
of points and their own bounds (tight, in the true coordinates), so what is read off them holds for any cuts; these only decide the balance.

A search keeps a frontier of (query, node) rows. A round joins the open nodes with the nodes two levels below on equal names and
drops what the bounds rule out; at the end frontier leaves meet their points, again on equal names. No step pairs all rows of anything.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import octree
from .aggregates import AXES, whole_point
from .lineage import written

#: Cuts of an axis, points of a cell, levels beyond those that evenly spread points need (surfaces need half as many again), the most levels, and levels of a round. Only speed depends on them.
CUTS, MOST, SPARE, MOST_DEPTH, STEP = 256, 256, 4, 20, 2
_BOUNDS = [f"{e}_{a}" for e in ("min", "max") for a in AXES]


@dataclass(frozen=True)
class Cells:
    """points (idx, x, y, z, leaf) and nodes (node, depth, n, leaf, bounds of their points)."""

    points: DataFrame
    nodes: DataFrame


def _stretched(points: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """points with __ux, __uy, __uz, growing with x, y, z, in 0 .. the number of ranges of the axis."""
    probs = [k / CUTS for k in range(CUTS + 1)]
    row = points.agg(*(F.percentile_approx(a, probs, 20 * CUTS).alias(a) for a in AXES), *(F.min(a).alias(f"min_{a}") for a in AXES), *(F.max(a).alias(f"max_{a}") for a in AXES)).first()
    out, ranges = points, {}
    for a in AXES:
        ends = sorted({float(c) for c in (*(row[a] or ()), row[f"min_{a}"], row[f"max_{a}"]) if c is not None})
        if len(ends) < 2:
            ends = [ends[0] if ends else 0.0, (ends[0] if ends else 0.0) + 1.0]
        n = ranges[a] = len(ends) - 1
        if n > 1:
            splits = [-math.inf, *ends[1:-1], math.inf]
            out = Bucketizer(splits=splits, inputCol=a, outputCol=f"__b{a}").transform(out).withColumn(f"__b{a}", F.col(f"__b{a}").cast("int"))
        else:
            out = out.withColumn(f"__b{a}", F.lit(0))
        low, high = (F.element_at(F.array(*map(F.lit, e)), F.col(f"__b{a}") + 1) for e in (ends[:-1], ends[1:]))
        share = F.least(F.greatest((F.col(a) - low) / (high - low), F.lit(0.0)), F.lit(1.0))
        out = out.withColumn(f"__u{a}", F.col(f"__b{a}") + F.coalesce(share, F.lit(0.0))).drop(f"__b{a}")
    return out, ranges


def grow(points: DataFrame, most: int = MOST) -> Cells | None:
    """The cells of a cloud (its points without a null or non-finite coordinate); None without a point."""
    ok = whole_point()
    for a in AXES:
        ok = ok & ~F.isnan(a) & (F.abs(a) < math.inf)
    own = points.filter(ok).select("idx", *AXES)
    total = own.count()
    if not total:
        return None
    depth = min(MOST_DEPTH, max(0, math.ceil(math.log(max(total / most, 1), 8))) + SPARE)
    side = 1 << depth
    placed, ranges = _stretched(own)
    placed = placed.withColumns({f"__c{a}": F.least(F.floor(F.col(f"__u{a}") * (side / ranges[a])), F.lit(side - 1)) for a in AXES})
    placed = placed.select("idx", *AXES, octree.path_of_cells(depth).alias("path"))
    full = written(placed.groupBy("path").agg(F.count("*").alias("n"), *(f(a).alias(f"{e}_{a}") for e, f in (("min", F.min), ("max", F.max)) for a in AXES)))
    merged = [(F.min if b.startswith("min") else F.max)(b).alias(b) for b in _BOUNDS]
    tree = written(octree.tree_of(full, most, depth, *merged))
    return Cells(octree.with_leaf(placed, full, tree.filter("leaf").select(F.col("node").alias("leaf")), depth), tree)


def descend(front: DataFrame, cells: Cells, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """front (rows of queries) with node, depth, n, leaf and bounds of each leaf that `keep` leaves in the frontier, from the root on."""
    columns = ["node", "depth", "n", "leaf", *_BOUNDS]
    named = cells.nodes.select(*columns)
    last = named.agg(F.max("depth")).first()[0]
    root = named.filter("depth = 0").first()
    now = keep(front.select("*", *(F.lit(root[c]).cast(named.schema[c].dataType).alias(c) for c in columns)))
    for level in range(0, last, STEP):
        below = named.filter((F.col("depth") == level + STEP) | ((F.col("depth") > level) & (F.col("depth") < level + STEP) & F.col("leaf")))
        below = below.withColumn("__up", F.substring("node", 1, level))
        now = written(now)
        opened = now.filter("not leaf").withColumnRenamed("node", "__up").drop(*columns[1:]).join(below, "__up").drop("__up")
        now = keep(now.filter("leaf").unionByName(opened))
    return now.filter("leaf")


def _least2(at: tuple[str, ...]) -> Column:
    """The least squared distance of a point of the node: rounded as the distances of points are, never above one of them."""
    part = [F.greatest(F.col(f"min_{a}") - F.col(q), F.col(q) - F.col(f"max_{a}"), F.lit(0.0)) for a, q in zip(AXES, at, strict=True)]
    return part[0] * part[0] + part[1] * part[1] + part[2] * part[2]


def _most2(at: tuple[str, ...]) -> Column:
    part = [F.greatest(F.abs(F.col(q) - F.col(f"min_{a}")), F.abs(F.col(f"max_{a}") - F.col(q))) for a, q in zip(AXES, at, strict=True)]
    return part[0] * part[0] + part[1] * part[1] + part[2] * part[2]


def nearest(queries: DataFrame, points: DataFrame, k: int = 1, most: float | None = None, same: bool = False, size: int = MOST) -> DataFrame | None:
    """(q_idx, rank, idx, d2) of the k nearest points of each query, ties by idx; None without a point.

    The bound of a query is the least distance within which the nodes of its frontier hold k points for certain; it tightens with each level, and
    nodes beyond it go. Of points in one place only the first k can be among the nearest, so a crowded place costs no more.
    """
    cells = grow(points, size)
    if cells is None:
        return None
    need, at = k + (not same), ("qx", "qy", "qz")
    ok = whole_point()
    for a in AXES:
        ok = ok & ~F.isnan(a) & (F.abs(a) < math.inf)
    front = queries.filter(ok).select(F.col("idx").alias("q_idx"), *(F.col(a).alias(q) for a, q in zip(AXES, at, strict=True)))

    def keep(rows: DataFrame) -> DataFrame:
        by = Window.partitionBy("q_idx")
        upto = by.orderBy("__most", "node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumns({"__least": _least2(at), "__most": _most2(at)}).withColumn("__held", F.sum("n").over(upto))
        rows = rows.withColumn("__bound", F.coalesce(F.min(F.when(F.col("__held") >= need, F.col("__most"))).over(by), F.lit(math.inf)))
        near = F.col("__least") <= F.col("__bound")
        if most is not None:
            near = near & (F.col("__least") <= F.lit(float(most) * float(most)))
        return rows.filter(near).drop("__least", "__most", "__held", "__bound")

    found = written(descend(front, cells, keep).select("q_idx", *at, F.col("node").alias("leaf"), (F.col("n") > size).alias("crowded")))
    crowded = cells.nodes.filter(F.col("leaf") & (F.col("n") > size)).select(F.col("node").alias("leaf"))
    held = cells.points
    if not crowded.isEmpty():
        place = Window.partitionBy(*AXES).orderBy("idx")
        first = held.join(crowded, "leaf", "left_semi").withColumn("__n", F.row_number().over(place)).filter(F.col("__n") <= need).drop("__n")
        held = held.join(crowded, "leaf", "left_anti").unionByName(first)
    d2 = (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx"))
    for a in AXES[1:]:
        d2 = d2 + (F.col(a) - F.col(f"q{a}")) * (F.col(a) - F.col(f"q{a}"))
    near = found.join(held, "leaf").select("q_idx", "idx", d2.alias("d2"))
    if not same:
        near = near.filter("q_idx != idx")
    if most is not None:
        near = near.filter(F.col("d2") <= F.lit(float(most) * float(most)))
    order = Window.partitionBy("q_idx").orderBy("d2", "idx")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("q_idx", "rank", "idx", "d2")


def rays(lines: DataFrame, points: DataFrame, tolerance: float, size: int = MOST) -> DataFrame | None:
    """(q_id, idx, t, perp2) for a table of rays (q_id, ox, oy, oz, dx, dy, dz): of the points within tolerance of each ray and not behind it, the nearest to it (ties by idx).

    A ray goes down to the cells that it passes at the tolerance or nearer, from the whole cloud on. Rays without a direction, or with
    a null or non-finite number, have no point. None without a point.
    """
    cells = grow(points, size)
    if cells is None:
        return None
    o, d = [f"o{a}" for a in AXES], [f"d{a}" for a in AXES]
    ok = F.lit(True)
    for c in (*o, *d):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)
    length = F.sqrt(sum((F.col(c) * F.col(c) for c in d[1:]), F.col(d[0]) * F.col(d[0])))
    front = lines.select("q_id", *(F.col(c).cast("double").alias(c) for c in (*o, *d))).filter(ok).withColumn("__n", length).filter("__n > 0")
    front = front.select("q_id", *o, *((F.col(c) / F.col("__n")).alias(c) for c in d))
    grown = tolerance * (1 + 1e-9)

    def keep(rows: DataFrame) -> DataFrame:
        enters, leaves, hit = [F.lit(-tolerance)], [F.lit(math.inf)], F.lit(True)
        for a in AXES:
            low, high, start, step = F.col(f"min_{a}") - grown, F.col(f"max_{a}") + grown, F.col(f"o{a}"), F.col(f"d{a}")
            flat = step == 0.0
            one, two = (low - start) / F.when(flat, F.lit(1.0)).otherwise(step), (high - start) / F.when(flat, F.lit(1.0)).otherwise(step)
            enters.append(F.when(flat, F.lit(-math.inf)).otherwise(F.least(one, two)))
            leaves.append(F.when(flat, F.lit(math.inf)).otherwise(F.greatest(one, two)))
            hit = hit & (~flat | ((start >= low) & (start <= high)))
        enter, leave = F.greatest(*enters), F.least(*leaves)
        slack = 1e-9 * (F.abs(enter) + F.abs(leave))  # of the divisions
        return rows.filter(hit & (enter <= leave + F.coalesce(F.when(slack < math.inf, slack), F.lit(0.0))))

    found = written(descend(front, cells, keep).select("q_id", *o, *d, F.col("node").alias("leaf")))
    met = found.join(cells.points, "leaf")
    v = [F.col(a) - F.col(f"o{a}") for a in AXES]
    met = met.withColumn("t", v[0] * F.col("dx") + v[1] * F.col("dy") + v[2] * F.col("dz"))
    w = [F.col(a) - (F.col(f"o{a}") + F.col(f"d{a}") * F.col("t")) for a in AXES]
    met = met.withColumn("perp2", w[0] * w[0] + w[1] * w[1] + w[2] * w[2])
    near = met.filter((F.col("t") >= -tolerance) & (F.col("perp2") <= tolerance * tolerance))
    return near.groupBy("q_id").agg(F.min(F.struct("perp2", "idx", "t")).alias("b")).select("q_id", "b.idx", "b.t", "b.perp2")
