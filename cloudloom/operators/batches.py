"""A cloud that grows by batches, with a small table of what is known of each.

A batch is one folder of points and one row of aggregates: its number of rows, its bounds, its range of intensity, and when it was written. Those that come with the batch
are taken as they are; the others are observed while the batch is written, so no point is read twice. Bounds and range
of the whole cloud are merged from these rows and never need the points. The row is written last, and a batch without one does
not belong to the cloud; a batch that is written again under its name takes the place of the first.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .aggregates import AXES, Box, finite, number, whole_point

_BOUNDS = [f"{e}_{a}" for e in ("min", "max") for a in AXES]
_RANGE = ["min_intensity", "max_intensity"]
SCHEMA = T.StructType([T.StructField("n", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in (*_BOUNDS, *_RANGE)), T.StructField("schema", T.StringType()), T.StructField("at", T.TimestampType()), T.StructField("batch", T.StringType())])


def _usable(box: Box | None) -> bool:
    """Six finite numbers, none of the least above the largest."""
    return box is not None and all(map(math.isfinite, (getattr(box, c) for c in _BOUNDS))) and all(getattr(box, f"min_{a}") <= getattr(box, f"max_{a}") for a in AXES)


def append(points: DataFrame, root: str, name: str, bounds: Box | None = None, intensity: tuple[float, float] | None = None) -> None:
    """Write a batch. bounds and intensity: what its producer knows already (taken if finite, and ends of the range in either order)."""
    if not name or any(c in name for c in "/=\\"):
        raise ValueError("a batch is named without slashes and equal signs")
    spark, base = points.sparkSession, root.rstrip("/")
    given: dict[str, float | None] = {}
    if _usable(bounds):
        given |= {c: float(getattr(bounds, c)) for c in _BOUNDS}
    if intensity is not None and all(v is not None and math.isfinite(v) for v in intensity):
        given |= dict(zip(_RANGE, sorted(map(float, intensity)), strict=True))
    measures = [F.count(F.lit(1)).alias("n")]
    if _BOUNDS[0] not in given:
        measures += [(F.min if c.startswith("min") else F.max)(F.when(whole_point(), number(c[4:]))).alias(c) for c in _BOUNDS]
    if _RANGE[0] not in given:
        shade = F.when(finite("intensity"), F.col("intensity")) if "intensity" in points.columns else F.lit(None).cast("double")
        measures += [f(shade).alias(c) for c, f in zip(_RANGE, (F.min, F.max), strict=True)]
    seen = Observation()
    points.observe(seen, *measures).write.mode("overwrite").parquet(f"{base}/points/batch=b-{name}")
    row = seen.get | given | {"schema": points.schema.json()}
    fields = SCHEMA.fields[:-2]
    made = spark.createDataFrame([tuple(row.get(f.name) for f in fields)], T.StructType(fields)).withColumn("at", F.current_timestamp())
    made.coalesce(1).write.mode("overwrite").parquet(f"{base}/aggregates/batch=b-{name}")


def aggregates(spark: SparkSession, root: str) -> DataFrame:
    """The rows of aggregates, one of each batch."""
    return spark.read.schema(SCHEMA).parquet(f"{root.rstrip('/')}/aggregates").withColumn("batch", F.expr("substring(batch, 3)"))


def points(spark: SparkSession, root: str) -> DataFrame:
    """The points of all batches that have their row; columns that a batch lacks are null there."""
    own = aggregates(spark, root).select("schema", "batch")
    fields: dict[str, T.StructField] = {}
    for r in own.select("schema").distinct().collect():  # one row of each shape of batch
        for f in T.StructType.fromJson(json.loads(r["schema"])).fields:
            fields.setdefault(f.name, T.StructField(f.name, f.dataType, True))
    read = spark.read.schema(T.StructType([*fields.values(), T.StructField("batch", T.StringType())])).parquet(f"{root.rstrip('/')}/points")
    return read.withColumn("batch", F.expr("substring(batch, 3)")).join(own.select("batch"), "batch", "left_semi").select(*fields)


def summary(spark: SparkSession, root: str) -> DataFrame:
    """One row: batches, n, bounds and range of intensity of the cloud, from the aggregates alone. Batches without points, or whose bounds are not finite, add none."""
    whole = F.lit(True)
    for c in _BOUNDS:
        whole = whole & finite(c)
    merged = [(F.min if c.startswith("min") else F.max)(F.when(whole, F.col(c))).alias(c) for c in _BOUNDS]
    return aggregates(spark, root).agg(F.count("*").alias("batches"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *merged, F.min(_RANGE[0]).alias(_RANGE[0]), F.max(_RANGE[1]).alias(_RANGE[1]))
