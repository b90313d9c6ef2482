"""Split statistics of a node: binned surface-area histogram, prefix and suffix bounds, best split, median."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import AXES, Box, box_of, whole_point

MIN_ROWS, MIN_RATIO, MAX_BINS, FLAT = 32, 4.0, 16, 1e-9


def bin_count(n: int) -> int:
    return min(max(math.ceil(math.log2(max(n, 1))), 8), MAX_BINS)


def histogram(points: DataFrame, box: Box, bins: int) -> DataFrame:
    """(axis, bin, n, bounds) for each axis with an extent; partially aggregated, at most 3 x bins rows leave a task."""
    p = points.filter(whole_point())
    out = None
    for k, a in enumerate(AXES):
        low, extent = getattr(box, f"min_{a}"), getattr(box, f"max_{a}") - getattr(box, f"min_{a}")
        if extent <= FLAT:
            continue
        at = F.least(F.greatest(F.floor((F.col(a) - F.lit(low)) * F.lit((bins - 1) / extent)), F.lit(0)), F.lit(bins - 1)).cast("int")
        part = p.select(F.lit(k).alias("axis"), at.alias("bin"), *AXES)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = p.select(F.lit(0).alias("axis"), F.lit(0).alias("bin"), *AXES).filter("false")
    return out.groupBy("axis", "bin").agg(F.count("*").alias("n"), *(f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in AXES))


def _area(prefix: str) -> Column:
    e = [F.greatest(F.col(f"{prefix}max_{a}") - F.col(f"{prefix}min_{a}"), F.lit(FLAT)) for a in AXES]
    return 2.0 * (e[0] * e[1] + e[1] * e[2] + e[2] * e[0])


def prefix_suffix(hist: DataFrame) -> DataFrame:
    """Counts and bounds of the bins up to each bin and of those after it (windows over at most `bins` rows)."""
    left = Window.partitionBy("axis").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    right = Window.partitionBy("axis").orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    cols = [f(F.col(f"{n}_{a}")) for n, f in (("min", F.min), ("max", F.max)) for a in AXES]
    names = [f"{n}_{a}" for n in ("min", "max") for a in AXES]
    return hist.select(
        "axis", "bin", "n",
        F.sum("n").over(left).alias("left_n"), F.coalesce(F.sum("n").over(right), F.lit(0)).alias("right_n"),
        *(c.over(left).alias(f"left_{n}") for c, n in zip(cols, names, strict=True)), *(c.over(right).alias(f"right_{n}") for c, n in zip(cols, names, strict=True)),
    )


def best_split(points: DataFrame) -> DataFrame:
    """(axis, split, cost) of the cheapest split; no row for few points or a box that is not elongated."""
    box = box_of(points)
    n = points.filter(whole_point()).count()
    none = points.sparkSession.createDataFrame([], "axis int, split double, cost double")
    if box is None or n < MIN_ROWS:
        return none
    extents = [getattr(box, f"max_{a}") - getattr(box, f"min_{a}") for a in AXES]
    wide = [e for e in extents if e > FLAT]
    if not wide or max(extents) / min(wide) < MIN_RATIO:
        return none
    bins = bin_count(n)
    e = [max(v, FLAT) for v in extents]
    whole = 2.0 * (e[0] * e[1] + e[1] * e[2] + e[2] * e[0])
    low = F.element_at(F.array(*(F.lit(getattr(box, f"min_{a}")) for a in AXES)), F.col("axis") + 1)
    extent = F.element_at(F.array(*map(F.lit, extents)), F.col("axis") + 1)
    cost = _area("left_") / whole * F.col("left_n") + _area("right_") / whole * F.col("right_n")
    # a bin without points would split where the bin before it does, at a lower value: the earlier bin wins a tie
    cuts = prefix_suffix(histogram(points, box, bins)).filter((F.col("right_n") > 0) & (F.col("bin") < bins - 1))
    costs = cuts.select("axis", "bin", cost.alias("cost"), (low + (F.col("bin") + 1) / F.lit(float(bins)) * extent).alias("split"))
    return costs.agg(F.min(F.struct("cost", "axis", "bin", "split")).alias("b")).filter("b is not null").select("b.axis", "b.split", "b.cost")


def median_entry(points: DataFrame, axis: str) -> DataFrame:
    """The entry at place n/2 by (axis, idx): the upper median."""
    from .numbering import positions

    p = points.filter(whole_point())
    at = p.count() // 2
    return positions(p, axis, tie="idx").filter(F.col("pos") == at).select("idx", F.col(axis).alias("value"))
