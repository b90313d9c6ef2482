"""What a viewer asks for: display colours by mode, the visible rows of a camera, camera keys and snapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color
from ..functions.text import fixed
from . import numbering, octree, sampling
from .aggregates import AXES, box_of, intensity_range

#: Steps to which a camera is rounded, pixels within which a click snaps, and the change of the display limit that asks for a new tree.
POSITION_STEP, FOV_STEP = 0.1, 0.25
SNAP_PIXELS = 20.0
REBUILD_SHARE = 0.5
FIRST_DENSITY = 0.3


def colorize(points: DataFrame, mode: str | None = None, gradient: str | None = None, single: str = "#ffffff", seed: int = 0) -> DataFrame:
    """idx and the packed display colour of every point, as one expression chosen while planning.

    An unknown mode is `original`, an unknown gradient viridis; `intensity` on a cloud without the column, and single points
    without a value, take the height; `original` without a colour is white; so is rgb_xyz where a coordinate is missing.
    """
    mode = color.mode_of(mode)
    white = F.lit(color.WHITE).cast("long")
    if mode == "original":
        rgb = F.col("rgb").cast("long").bitwiseAND(color.WHITE) if "rgb" in points.columns else white
    elif mode == "single":
        rgb = color.from_hex(F.lit(single))
    elif mode == "random":
        rgb = color.random_color(F.col("idx"), seed)
    else:
        box = box_of(points)
        part = lambda a: color.normalized(F.col(a), getattr(box, f"min_{a}", None), getattr(box, f"max_{a}", None))
        if mode == "rgb_xyz":
            whole = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
            rgb = F.when(whole, color.rgb_xyz(*map(part, AXES)))
        elif mode == "intensity" and "intensity" in points.columns:
            low, high = intensity_range(points).first()
            rgb = F.when(F.col("intensity").isNotNull(), color.gradient(color.normalized(F.col("intensity"), low, high, missing=0.0), gradient)).otherwise(color.gradient(part("z"), gradient))
        else:
            rgb = color.gradient(part("z"), gradient)
    return points.select("idx", F.coalesce(rgb, white).alias("rgb"))


def first_limit(startup_cap: int, cached: int, density: float) -> tuple[int, float]:
    """Limit and density of the first picture."""
    return max(1, min(startup_cap, cached)), min(density, FIRST_DENSITY)


def view(points: DataFrame, planes: list, most: int, depth: int = 8, density: float = 1.0, limit: int | None = None, visible: bool = True) -> DataFrame:
    """Runs of ordinals (start_idx, end_idx, n) to draw: the rows in sight, thinned to the density, then to the limit; none of a hidden cloud.

    The ordinals in sight are numbered twice; they are written once, so that the tree is not built again for each numbering.
    """
    from .lineage import written

    seen = octree.frustum_query(points if visible else points.filter("false"), planes, most, depth).select("idx")
    if density < 0.999:
        seen = sampling.by_density(written(seen), density).select("idx")
    if limit is not None:
        seen = sampling.by_limit(written(seen), limit).select("idx")
    return numbering.runs(written(seen))


def camera_key(eye: tuple[Column, ...], target: tuple[Column, ...], fov: Column) -> Column:
    """Seven rounded numbers that name a camera; a missing one counts as 0."""
    near = lambda v, q: F.coalesce(F.round(v / q) * q, F.lit(0.0))
    return F.concat_ws(":", *(fixed(near(v, POSITION_STEP), 3) for v in (*eye, *target)), fixed(near(fov, FOV_STEP), 3))


def world_tolerance(pixels: float, per_pixel: float | None = None, diagonal: float = 0.0, viewport: float = 0.0) -> float:
    """Pixels in units of the model: by the camera's scale, else by the diagonal across the viewport, else as they are."""
    if per_pixel is not None and per_pixel * pixels > 0:
        return per_pixel * pixels
    return diagonal / viewport * pixels if diagonal > 0 and viewport > 0 else pixels


def snaps(x: Column, y: Column, at: tuple[float, float], pixels: float = SNAP_PIXELS) -> Column:
    """Whether a screen point lies nearer than `pixels` to the pointer."""
    return F.hypot(x - F.lit(float(at[0])), y - F.lit(float(at[1]))) < pixels


def rebuilds(limit: Column, snapshot: Column, share: float = REBUILD_SHARE) -> Column:
    """Whether the display limit has changed so much since the snapshot that the tree is built anew; without a positive snapshot it is not."""
    return F.coalesce((snapshot > 0) & (F.abs(limit - snapshot) / F.when(snapshot > 0, snapshot) > share), F.lit(False))


def alpha(weight: Column) -> Column:
    """The opacity 0..255 of a fading level; a weight of nearly 1 is opaque, null is transparent."""
    w = F.least(F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.when(w >= 0.999, 255).otherwise(F.round(255 * w)).cast("long")


def lerp(start: Column, target: Column, progress: Column) -> Column:
    """From start to target by progress, clamped to 0..1 (null counts as 0)."""
    return start + (target - start) * F.least(F.greatest(F.coalesce(progress, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def subtree(with_leaves: DataFrame, node: str) -> DataFrame:
    """The rows of all leaves below a node (a path), which are those whose leaf begins with it."""
    return with_leaves.filter(F.col("leaf").startswith(node))


def candidates(catalog: DataFrame) -> DataFrame:
    """Clouds that a preview shows: visible ones that still load and have points."""
    return catalog.filter("visible AND pending AND points > 0")


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """The range of partial ranges (min_intensity, max_intensity): either end may be missing, and ends in the wrong order are swapped."""
    low, high = F.col("min_intensity"), F.col("max_intensity")
    swap = low > high
    return ranges.agg(F.min(F.when(swap, high).otherwise(low)).alias("min_intensity"), F.max(F.when(swap, low).otherwise(high)).alias("max_intensity"))
