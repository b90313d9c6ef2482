"""Bounds, ranges and statistics. All are partial/final hash aggregates: one row leaves each task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def number(c: str | Column) -> Column:
    """NaN as null, as running minima and maxima ignore it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c), None).otherwise(c)


def micros(c: str | Column) -> Column:
    """Microseconds of a timestamp with or without a zone."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def whole_point() -> Column:
    """A point of which any coordinate is null is no point."""
    return F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()


def finite(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _bounds_columns() -> list[Column]:
    ok = whole_point()
    return [f(F.when(ok, number(a))).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in AXES]


def bounds(points: DataFrame, *by: str) -> DataFrame:
    """min_x .. max_z, in all or for each group."""
    return points.groupBy(*by).agg(*_bounds_columns()) if by else points.agg(*_bounds_columns())


def merge_bounds(partials: DataFrame) -> DataFrame:
    """The bounds of partial bounds; partials that hold a non-finite value are left out."""
    names = [f"{n}_{a}" for n in ("min", "max") for a in AXES]
    ok = finite(names[0])
    for n in names[1:]:
        ok = ok & finite(n)
    return partials.filter(ok).agg(*((F.min if n.startswith("min") else F.max)(n).alias(n) for n in names))


def intensity_range(points: DataFrame, c: str = "intensity") -> DataFrame:
    ok = finite(c)
    return points.agg(F.min(F.when(ok, F.col(c))).alias("min_intensity"), F.max(F.when(ok, F.col(c))).alias("max_intensity"))


@dataclass(frozen=True)
class Box:
    """Bounds on the driver (six numbers)."""

    min_x: float
    min_y: float
    min_z: float
    max_x: float
    max_y: float
    max_z: float

    @property
    def center(self) -> tuple[float, float, float]:
        return tuple((getattr(self, f"min_{a}") + getattr(self, f"max_{a}")) * 0.5 for a in AXES)

    @property
    def diagonal(self) -> float:
        return sum((getattr(self, f"max_{a}") - getattr(self, f"min_{a}")) ** 2 for a in AXES) ** 0.5

    def grown(self, d: float) -> Box:
        return Box(self.min_x - d, self.min_y - d, self.min_z - d, self.max_x + d, self.max_y + d, self.max_z + d)


def box_of(points: DataFrame) -> Box | None:
    """The bounds as a driver-side value; None without a point."""
    r = bounds(points).first()
    return None if r["min_x"] is None else Box(**r.asDict())


def center_radius(points: DataFrame) -> DataFrame:
    """Centre of the bounds and the largest distance of a point from it (two passes)."""
    box = box_of(points)
    if box is None:
        return points.sparkSession.createDataFrame([], "cx double, cy double, cz double, radius double, half_diagonal double")
    d = distance2(box.center)
    return points.filter(whole_point()).agg(*(F.lit(c).alias(f"c{a}") for a, c in zip(AXES, box.center, strict=True)), F.sqrt(F.max(d)).alias("radius"), F.lit(box.diagonal * 0.5).alias("half_diagonal"))


def distance2(to: tuple[float, float, float], names: tuple[str, str, str] = AXES) -> Column:
    dx, dy, dz = (F.col(n) - F.lit(float(v)) for n, v in zip(names, to, strict=True))
    return dx * dx + dy * dy + dz * dz


def presence(points: DataFrame) -> DataFrame:
    """Row count and which optional columns hold anything."""
    has = lambda c: (F.count(c) > 0).alias(f"has_{c}") if c in points.columns else F.lit(False).alias(f"has_{c}")
    return points.agg(F.count("*").alias("n"), has("rgb"), has("intensity"))


def rates(rows: DataFrame, group: str, ts: str, amount: str) -> DataFrame:
    """Duration, processed amount (largest gauge), total and rate of each group of telemetry rows."""
    seconds = (micros(F.max(ts)) - micros(F.min(ts))) / 1e6
    return rows.groupBy(group).agg(seconds.alias("duration"), F.max(amount).alias("peak"), F.count("*").alias("processed"), F.when(seconds > 0, F.count("*") / seconds).otherwise(F.lit(0.0)).alias("rate"))
