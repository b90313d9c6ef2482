"""Changes to clouds and the catalog: merge, remainders, semi-joins, names, measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import AXES
from .numbering import with_range


def append(cloud: DataFrame, batch: DataFrame) -> DataFrame:
    return cloud.unionByName(batch, allowMissingColumns=True)


def merge(cloud: DataFrame, changes: DataFrame) -> DataFrame:
    """The last change (by seq) of each ordinal wins, column by column where it is given; unknown ordinals are ignored."""
    names = [c for c in (*AXES, "rgb", "intensity") if c in changes.columns and c in cloud.columns]
    last = changes.groupBy("idx").agg(F.max_by(F.struct(*names), "seq").alias("__new"))
    joined = cloud.join(last, "idx", "left")
    return joined.select(*(F.coalesce(F.col(f"__new.{c}"), F.col(c)).alias(c) if c in names else c for c in cloud.columns))


def remainder(cloud: DataFrame, primary: DataFrame) -> DataFrame:
    return cloud.join(primary.select("idx"), "idx", "left_anti")


def guides(cloud: DataFrame, sample: DataFrame) -> DataFrame:
    return cloud.join(sample.select("idx"), "idx", "left_semi").select("idx", *AXES)


def at_ordinal(cloud: DataFrame, i: int) -> DataFrame:
    """The row of an ordinal; negative ones count from the end."""
    if i < 0:
        last = cloud.agg(F.max("idx")).first()[0]
        i = last + 1 + i if last is not None else i
    return cloud.filter(F.col("idx") == i)


def recolor(levels: DataFrame, colors: DataFrame) -> DataFrame:
    """Colours (idx, rgb) in every level that holds their point."""
    return levels.join(colors.select("idx", "rgb"), "idx", "left").select("level", "pos", "idx", "rgb")


def register(catalog: DataFrame, new: DataFrame, uid: str = "import_uid") -> DataFrame:
    """Adds clouds whose uid is not in the catalog."""
    return catalog.unionByName(new.join(catalog.select(uid), uid, "left_anti"), allowMissingColumns=True)


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """The first cloud of a name keeps it, the next are `name (2)`, `name (3)` ... `order` is numeric.

    Rows are numbered within ranges of a name and start where the counts of its ranges before end: a common name is not one task.
    """
    base = F.when(F.trim(F.coalesce(F.col(name), F.lit(""))) == "", F.lit("Point Cloud")).otherwise(F.col(name))
    rows = with_range(rows.withColumn("__base", base), F.col(order))
    sizes = rows.groupBy("__base", "__part").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("__base").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__base", "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    k = F.col("__start") + F.row_number().over(Window.partitionBy("__base", "__part").orderBy(order))
    return rows.join(starts, ["__base", "__part"]).withColumn("unique_name", F.when(k == 1, F.col("__base")).otherwise(F.concat("__base", F.lit(" ("), k.cast("string"), F.lit(")")))).drop("__base", "__part", "__start")


def remove(catalog: DataFrame, uids: DataFrame, uid: str = "import_uid") -> DataFrame:
    return catalog.join(uids.select(uid), uid, "left_anti")


def measure(pairs: DataFrame) -> DataFrame:
    """from_x .. to_z -> distance and midpoint."""
    d = [F.col(f"to_{a}") - F.col(f"from_{a}") for a in AXES]
    return pairs.withColumns({"distance": F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])} | {f"mid_{a}": F.col(f"from_{a}") * 0.5 + F.col(f"to_{a}") * 0.5 for a in AXES})


def dimension_offset(pairs: DataFrame, least: float = 0.1) -> DataFrame:
    """Offset of a dimension line: the unit vector across the line and up (or x, if it is vertical) times max(0.25 length, least)."""
    dx, dy, dz = (F.col(f"to_{a}") - F.col(f"from_{a}") for a in AXES)
    length = F.sqrt(dx * dx + dy * dy + dz * dz)
    # line x (0, 0, 1) = (dy, -dx, 0); line x (1, 0, 0) = (0, dz, -dy)
    flat = F.sqrt(dx * dx + dy * dy)
    side = F.sqrt(dz * dz + dy * dy)
    size = F.greatest(length * 0.25, F.lit(least))
    up = flat > 1e-9
    one = lambda v, n: v / F.when(n > 0, n).otherwise(F.lit(1.0)) * size
    return pairs.select("*", F.when(up, one(dy, flat)).otherwise(F.lit(0.0)).alias("off_x"), F.when(up, one(-dx, flat)).otherwise(one(dz, side)).alias("off_y"), F.when(up, F.lit(0.0)).otherwise(one(-dy, side)).alias("off_z"))


def last_rows(rows: DataFrame, order: str, keep: int = 20, *by: str) -> DataFrame:
    """A ring buffer: the last `keep` rows, in all (a distributed top-k) or of each group."""
    if not by:
        return rows.orderBy(F.col(order).desc()).limit(keep)
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order).desc()))).filter(F.col("__k") <= keep).drop("__k")


def csv_row(*cols: Column) -> Column:
    """Fields of a row, all quoted."""
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), '"', '""'), F.lit('"'))
    return F.concat_ws(",", *map(quote, cols))
