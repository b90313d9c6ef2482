"""Length units of point clouds, as factors to inches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import AXES, finite

#: Key, host code, factor and words of each unit, in the order in which they are tried.
UNITS = [
    ("inch", 0, 1.0, "in inch inches дюйм дюймы"),
    ("foot", 1, 12.0, "ft foot feet фут футы"),
    ("millimeter", 2, 1.0 / 25.4, "mm millimeter millimeters миллиметр миллиметры мм"),
    ("centimeter", 3, 1.0 / 25.4 * 10.0, "cm centimeter centimetre centimeters centimetres сантиметр сантиметры см"),
    ("meter", 4, 1.0 / 25.4 * 1_000.0, "m meter metre meters metres метр метры м"),
    ("kilometer", 5, 1.0 / 25.4 * 1_000_000.0, "km kilometer kilometre kilometers kilometres километр километры км"),
    ("yard", 6, 36.0, "yd yard yards ярд ярды"),
    ("mile", 7, 63_360.0, "mi mile miles миля мили"),
]
INCHES_PER_METER = 39.37007874
EPSILON = 2.220446049250313e-16


def by_code(code: Column) -> Column:
    """Factor of a host unit code; unknown codes count as inches."""
    pairs = [v for u in UNITS for v in (F.lit(u[1]), F.lit(u[2]))]
    return F.coalesce(F.element_at(F.create_map(*pairs), code.cast("int")), F.lit(1.0))


def by_key(key: Column) -> Column:
    """Factor of a unit's key; null for an unknown one."""
    return F.try_element_at(F.create_map(*[v for u in UNITS for v in (F.lit(u[0]), F.lit(u[2]))]), key)


def detect(text: Column) -> Column:
    """The unit that a header line names: the first unit with a word in it, else the one nearest to `scale = number` (within 5 %)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    named = F.coalesce(*(F.when(low.rlike(r"(?U)\b(" + "|".join(u[3].split()) + r")s?\b"), F.lit(u[0])) for u in UNITS))
    value = F.regexp_extract(low, r"scale\s*[:=]\s*([\d.e+-]+)", 1).try_cast("double")
    near = F.array_min(F.array(*(F.struct(F.abs(F.lit(u[2]) - value).alias("d"), F.lit(i).alias("i"), F.lit(u[2]).alias("f"), F.lit(u[0]).alias("key")) for i, u in enumerate(UNITS))))
    by_scale = F.when(value.isNotNull() & (near["d"] <= near["f"] * 0.05), near["key"])
    return F.when(low.contains("unit") | low.contains("scale"), F.coalesce(named, by_scale))


def resolve(explicit: Column, model_code: Column) -> Column:
    """The explicit factor if it is positive and finite, else the model's."""
    return F.coalesce(F.when(finite(explicit) & (explicit > 0), explicit), by_code(model_code))


def choose(source: Column, target: Column, explicit: Column, model_code: Column) -> Column:
    """The factor of the source unit; without one that of the target unit; without both the explicit factor, then the model's. The two units are never set against each other."""
    return F.coalesce(by_key(source), by_key(target), resolve(explicit, model_code))


def scale(points: DataFrame, factor: float) -> DataFrame:
    """Coordinates times a factor; points without all three coordinates stay as they are."""
    if abs(factor - 1.0) < EPSILON:
        return points
    ok = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    return points.withColumns({a: F.when(ok, F.col(a) * F.lit(float(factor))).otherwise(F.col(a)) for a in AXES})
