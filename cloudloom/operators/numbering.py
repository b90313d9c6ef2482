"""Positions in a global order without a single-task window.

The order column is cut at its approximate quantiles, so that skewed values make ranges of like counts too;
rows of a range are numbered on their own and start where the counts of the ranges before end. Only cuts and
counts (one for each range) pass the driver. Any cuts give the right places; only the balance depends on them.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_range(df: DataFrame, order: Column, name: str = "__part") -> DataFrame:
    """df with the range (0, 1, ...) of each row: about as many rows in each, all values of a range before those of the next."""
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    value = order.cast("double")
    cuts = df.agg(F.percentile_approx(value, [i / n for i in range(1, n)], 100 * n).alias("cuts")).first()["cuts"]
    splits = [-math.inf, *sorted({c for c in cuts or () if math.isfinite(c)}), math.inf]
    if len(splits) == 2:
        return df.withColumn(name, F.lit(0))
    found = Bucketizer(splits=splits, inputCol="__value", outputCol="__bucket", handleInvalid="keep").transform(df.withColumn("__value", value))
    return found.withColumn(name, F.col("__bucket").cast("int")).drop("__value", "__bucket")


def positions(df: DataFrame, by: str = "idx", tie: str | None = None, descending: bool = False, name: str = "pos") -> DataFrame:
    """df with the 0-based place of each row in the order of `by` (numeric, not null), ties by `tie` ascending."""
    order = -F.col(by) if descending else F.col(by)
    ranged = with_range(df, order)
    sizes = {r["__part"]: r["count"] for r in ranged.groupBy("__part").count().collect()}
    if not sizes:
        return df.withColumn(name, F.lit(None).cast("long"))
    before = [0, *accumulate(sizes.get(i, 0) for i in range(max(sizes) + 1))]
    window = Window.partitionBy("__part").orderBy(order, *([F.col(tie)] if tie else []))
    place = F.element_at(F.array(*(F.lit(b).cast("long") for b in before)), F.col("__part") + 1) + F.row_number().over(window) - 1
    return ranged.withColumn(name, place).drop("__part")


def runs(df: DataFrame, idx: str = "idx") -> DataFrame:
    """Maximal ranges of consecutive ordinals: start_idx, end_idx, n."""
    placed = positions(df.select(idx), idx)
    return placed.groupBy((F.col(idx) - F.col("pos")).alias("g")).agg(F.min(idx).alias("start_idx"), F.max(idx).alias("end_idx"), F.count("*").alias("n")).drop("g")
