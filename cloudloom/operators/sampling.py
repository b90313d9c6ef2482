"""Strides, display limits and levels of detail."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import positions

#: Level, enter ratio and exit ratio (eye distance by bounding radius) of each level of detail.
LEVELS = [(1.0, 0.0, 1.5), (0.5, 1.2, 2.5), (0.25, 2.0, 3.5), (0.1, 3.0, 5.0), (0.05, 4.5, math.inf)]
LARGE, CAP = 3_000_000, 1_200_000
FADE_SECONDS = 0.35


def half_up(v: float) -> int:
    return math.floor(v + 0.5)


def density_step(density: float) -> int:
    return 1 if density >= 0.999 else max(1, half_up(1.0 / max(density, 0.01)))


def stride(total: int, density: float, limit: int) -> int:
    """Rows from one kept row to the next for a cloud of `total` rows."""
    if total <= 0 or density >= 0.999:
        return 1
    step = density_step(density)
    limit = limit if limit > 0 else CAP
    if total > LARGE:
        limit = min(limit, CAP)
    if total // step > limit:
        step = math.ceil(total / limit)
    return max(1, min(step, total))


def every(df: DataFrame, step: int, limit: int | None = None, by: str = "idx") -> DataFrame:
    """Every step-th row by position, at most `limit` of them; pos is the place among the kept rows."""
    kept = positions(df, by).filter(F.col("pos") % step == 0).withColumn("pos", (F.col("pos") / step).cast("long"))
    return kept.filter(F.col("pos") < limit) if limit is not None else kept


def by_density(df: DataFrame, density: float, by: str = "idx") -> DataFrame:
    return every(df, density_step(density), by=by)


def by_limit(df: DataFrame, limit: int, by: str = "idx") -> DataFrame:
    """A stride that brings the rows down to `limit`."""
    return every(df, max(1, math.ceil(df.count() / limit)), limit, by)


def base_cache(df: DataFrame, density: float = 1.0, limit: int = 2_000_000, mode: str = "head") -> DataFrame:
    """The finest level: every step-th row. At full density a larger cloud keeps its first rows (mode head) or a stride (mode stride)."""
    total = df.count()
    step = math.ceil(total / limit) if mode == "stride" and total > limit else stride(total, density, limit)
    return every(df, max(1, step), limit)


def levels(base: DataFrame) -> DataFrame:
    """All coarser levels of a base cache (column pos) at once: level, pos in the level, idx."""
    steps = F.array(*(F.struct(F.lit(lv).alias("level"), F.lit(half_up(1.0 / lv)).alias("step")) for lv, _, _ in LEVELS))
    return base.select("idx", "pos", F.explode(steps).alias("s")).filter(F.col("pos") % F.col("s.step") == 0).select(F.col("s.level").alias("level"), (F.col("pos") / F.col("s.step")).cast("long").alias("pos"), "idx")


def first_level(ratio: Column) -> Column:
    """The level of a camera that had none before."""
    out = F.lit(LEVELS[-1][0])
    for lv, _, leave in reversed(LEVELS[:-1]):
        out = F.when(ratio <= leave, F.lit(lv)).otherwise(out)
    return F.when(ratio.isNull() | F.isnan(ratio), F.lit(1.0)).otherwise(out)


def next_level(ratio: Column, level: Column) -> Column:
    """The level after one step of the hysteresis from `level`."""
    out = level
    for k in range(len(LEVELS)):
        coarser, finer = F.lit(LEVELS[-1][0]), F.lit(LEVELS[0][0])
        for j in range(len(LEVELS) - 2, k - 1, -1):
            coarser = F.when(ratio > LEVELS[j][2], coarser).otherwise(F.lit(LEVELS[j][0]))
        for j in range(1, k + 1):
            finer = F.when(ratio < LEVELS[j][1], finer).otherwise(F.lit(LEVELS[j][0]))
        here = F.lit(LEVELS[k][0])
        moved = F.when(ratio > LEVELS[k][2], coarser).when(ratio < LEVELS[k][1], finer).otherwise(here) if k < len(LEVELS) - 1 else F.when(ratio < LEVELS[k][1], finer).otherwise(here)
        out = F.when(level == LEVELS[k][0], moved).otherwise(out)
    return F.when(ratio.isNull() | F.isnan(ratio), F.lit(1.0)).when(level.isNull(), first_level(ratio)).otherwise(out)


def step_level(ratio: float, level: int | None) -> int:
    """next_level for a single value, by the number of the level (None: the camera had none)."""
    if ratio is None or math.isnan(ratio):
        return 0
    if level is None or ratio > LEVELS[level][2]:
        return next((k for k in range(level or 0, len(LEVELS)) if ratio <= LEVELS[k][2]), len(LEVELS) - 1)
    if ratio < LEVELS[level][1]:
        return next((k for k in range(level, 0, -1) if ratio >= LEVELS[k][1]), 0)
    return level


def fade(elapsed: Column) -> Column:
    return F.least(F.greatest(elapsed / FADE_SECONDS, F.lit(0.0)), F.lit(1.0))


def index_sizes(total: int, most: int = 100_000, least: int = 50_000) -> list[int]:
    return sorted({min(least, total), min(max(most, least), total)})


def economy(heavy: bool, total: int, visible: int, threshold: int = 750_000) -> bool:
    return heavy and total > threshold and visible > threshold


def preview(df: DataFrame, target: int = 2000, window: int = 50_000) -> DataFrame:
    """At most `target` rows, by a stride, from the first `window` rows."""
    placed = positions(df, "idx").filter(F.col("pos") < window)
    step = max(1, math.ceil(min(df.count(), window) / target))
    return placed.filter(F.col("pos") % step == 0).orderBy("idx").limit(target)


def ramp(limit: int, target: int) -> int:
    """The next display limit on the way to `target`."""
    gap = target - limit
    return target if gap <= 0 else min(target, limit + max(math.ceil(gap * 0.25), 25_000))


def batches(df: DataFrame, size: int, by: str = "idx") -> DataFrame:
    """Consecutive ranges of `size` positions: batch, start_pos, end_pos, n."""
    return positions(df.select(by), by).groupBy((F.col("pos") / size).cast("long").alias("batch")).agg(F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.count("*").alias("n"))


def chunk_ids(df: DataFrame, capacity: int) -> DataFrame:
    """Rows of each chunk of a chunked column."""
    return df.groupBy(F.floor(F.col("idx") / capacity).alias("chunk_id")).agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))
