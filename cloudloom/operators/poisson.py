"""Greedy samples: take points in a fixed order, each excluding its neighbours.

The sequential result is found in blocks of ranks. A block first loses what the points taken before it reach; what is left is
settled in rounds. In a round each tile of cells goes through its candidates in order and settles those that do not hang on an
open candidate of another tile; what the taken ones reach there goes before the next round, whose tiles lie half a tile off.
Once few candidates of a block are open (WHOLE), one tile settles them all. No pairs are written.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import INCHES_PER_METER
from .aggregates import AXES, box_of, distance2, whole_point
from .lineage import shared_folder, written
from .numbering import positions
from .spatial import CELL, cell_size, curvature, gridded, reaching

TARGET, MIN_METERS = 50_000, 0.05
#: Blocks of ranks: the first has 2 * FIRST candidates, each later one as many as all before it, but none more than MOST.
FIRST, MOST = 1 << 13, 1 << 20
#: Cells along the side of a tile, and the open candidates that one tile takes wherever they lie.
TILE, WHOLE = 8, 1 << 16
_TILED = ("tx", "ty", "tz")
_OPEN = "rank long, x double, y double, z double, r double, cx long, cy long, cz long"


def adaptive_radius(distance: float, bounding: float, target: int = TARGET, least: float = MIN_METERS * INCHES_PER_METER) -> float:
    base = max(bounding / math.sqrt(target + 1.0) if bounding > 0 else least, least)
    return base * (1.0 + 0.5 * (min(max(distance / bounding, 0.0), 1.0) if bounding > 0 else 0.0))


def _block() -> Column:
    """The block (1, 2, ...) of a rank."""
    part = F.floor(F.col("rank") / F.lit(FIRST))
    return (F.length(F.bin(F.least(part, F.lit(MOST // FIRST).cast("long")))) + F.greatest(F.floor(F.col("rank") / F.lit(MOST)) - 1, F.lit(0).cast("long"))).cast("int")


def _tiles(candidates: DataFrame, shift: int) -> DataFrame:
    """Each candidate once for its own tile (own) and once for each other tile that one of the 26 cells around its own lies in; tiles begin at -shift."""
    out = candidates.withColumn("own", F.lit(True))
    tile = lambda c, i: F.floor((F.col(c) + (i + shift)) / F.lit(TILE))
    for c, t in zip(CELL, _TILED, strict=True):
        out = out.withColumn(t, F.explode(F.array_distinct(F.array(*(tile(c, i) for i in (-1, 0, 1)))))).withColumn("own", F.col("own") & (F.col(t) == tile(c, 0)))
    return out


def _settle(tile: pd.DataFrame) -> pd.DataFrame:
    """A tile's own candidates that are taken, and those that are still open; the excluded ones go."""
    tile = tile.sort_values("rank", ignore_index=True)
    at, own = tile[list(AXES)].to_numpy(), tile["own"].to_numpy()
    cells, members = list(zip(*(tile[c].tolist() for c in CELL), strict=True)), tile.groupby(list(CELL)).indices
    taken, gone = np.zeros(len(tile), bool), np.zeros(len(tile), bool)
    told, waits = set(), set()  # cells of open candidates, and all cells that these may reach
    for i, (cell, r2) in enumerate(zip(cells, (tile["r"] * tile["r"]).tolist(), strict=True)):
        if gone[i] or cell in told:
            continue
        around = [(cell[0] + a, cell[1] + b, cell[2] + c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
        if own[i] and cell not in waits:
            taken[i] = True
            near = np.concatenate([members[k] for k in around if k in members])
            near = near[near > i]
            d = at[near] - at[i]
            gone[near[d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2] <= r2]] = True
        else:
            told.add(cell)
            waits.update(around)
    return tile.assign(taken=taken)[own & ~gone].drop(columns=["own", *_TILED])


def _out_of_reach(candidates: DataFrame, taken: DataFrame, size: float) -> DataFrame:
    """The candidates that no taken one reaches."""
    by = reaching(taken.select(*AXES, "r"), size).select(*(F.col(a).alias(f"q{a}") for a in AXES), F.col("r").alias("by"), *(F.col(c).alias(f"q{c}") for c in CELL))
    d = [F.col(a) - F.col(f"q{a}") for a in AXES]
    meet = d[0] * d[0] + d[1] * d[1] + d[2] * d[2] <= F.col("by") * F.col("by")
    for c in CELL:
        meet = (F.col(c) == F.col(f"q{c}")) & meet
    return candidates.join(by, meet, "left_anti")


def greedy(candidates: DataFrame, reach: float, target: int | None = None) -> DataFrame:
    """candidates (idx, rank from 0, x, y, z, r: what it excludes if taken, at most reach) -> taken rows (idx, rank), the first `target` of them."""
    spark, size = candidates.sparkSession, cell_size(reach)
    folder = shared_folder(spark, "ranked")
    out = candidates.select("idx", "rank", *AXES, "r").withColumn("block", _block())
    out.write.partitionBy("block").parquet(folder)
    ranked = spark.read.schema(out.schema).parquet(folder)
    last, taken = ranked.agg(F.max("block")).first()[0] or 0, None
    for block in range(1, last + 1):
        left, shift = gridded(ranked.filter(F.col("block") == block).drop("idx", "block"), size), 0
        left = written(left if taken is None else _out_of_reach(left, taken, size))
        while n := left.count():
            whole = n <= WHOLE
            tiles = left.withColumns({"own": F.lit(True)} | {t: F.lit(0) for t in _TILED}) if whole else _tiles(left, shift)
            settled = written(tiles.groupBy(*_TILED).applyInPandas(_settle, f"{_OPEN}, taken boolean"))
            new = settled.filter("taken").select("rank", *AXES, "r")
            taken = new if taken is None else taken.union(new)
            if whole:
                break
            left, shift = written(_out_of_reach(settled.filter("not taken").drop("taken"), new, size)), TILE // 2 - shift
        taken = written(taken)
        if target and taken.count() >= target:
            break
    if taken is None:
        return ranked.select("idx", "rank")
    found = ranked.filter(F.col("block") <= block).select("idx", "rank").join(taken.select("rank"), "rank").select("idx", "rank")
    return found.orderBy("rank").limit(target) if target else found


def _ranked(points: DataFrame, by: str) -> DataFrame:
    return positions(points, by, tie="idx", descending=True, name="rank")


def candidate_order(points: DataFrame) -> DataFrame:
    """points by distance from the centre of the bounds, far ones first: idx, distance, rank."""
    box = box_of(points)
    p = points.filter(whole_point()).withColumn("distance", F.sqrt(distance2(box.center if box else (0.0, 0.0, 0.0))))
    return _ranked(p, "distance")


def poisson(points: DataFrame, target: int = TARGET, least: float = MIN_METERS * INCHES_PER_METER) -> DataFrame:
    """The Poisson-disk sample: idx, rank."""
    ranked = candidate_order(points)
    bounding = ranked.agg(F.max("distance")).first()[0] or 0.0
    base = max(bounding / math.sqrt(target + 1.0) if bounding > 0 else least, least)
    own = ranked.withColumn("r", F.lit(base) * (1.0 + 0.5 * (F.least(F.col("distance") / F.lit(bounding), F.lit(1.0)) if bounding > 0 else F.lit(0.0))))
    return greedy(own, base * 1.5, target)


def curvature_sample(points: DataFrame, radius: float, exclude: float, target: int = TARGET) -> DataFrame:
    """Points of positive curvature, most curved first, none within `exclude` of an earlier one: idx, rank."""
    bent = written(curvature(points, radius)).filter("curvature > 0")
    bent = written(bent.join(points.select("idx", *AXES), "idx"))
    return greedy(_ranked(bent, "curvature").withColumn("r", F.lit(float(exclude))), exclude, target)
