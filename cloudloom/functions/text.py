"""Formatting and normalising functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.aggregates import finite


def fixed(v: Column, places: int) -> Column:
    """v with so many places, rounded from its binary value (format_string rounds the shortest decimal digits instead)."""
    return F.regexp_replace(F.format_number(v.cast("double"), places), ",", "")


def count(v: Column, suffix: str = "") -> Column:
    """1 234 as 1.2k, from a million on M; nothing positive and finite: 0."""
    v = v.cast("double")
    body = F.when(v >= 1e6, F.concat(fixed(v / 1e6, 1), F.lit("M"))).when(v >= 1e3, F.concat(fixed(v / 1e3, 1), F.lit("k"))).otherwise(F.round(v).cast("long").cast("string"))
    return F.concat(F.when(finite(v) & (v > 0), body).otherwise(F.lit("0")), F.lit(suffix))


def _strip_zeros(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"\.0+$", ""), r"(\.\d*?)0+$", "$1")


def size(v: Column, places: int = 2) -> Column:
    """Bytes as B, KB, MB or GB."""
    v = v.cast("double")
    a = F.abs(v)
    unit = lambda p, n: F.concat(_strip_zeros(fixed(a / float(1024**p), places)), F.lit(f" {n}"))
    body = F.when(a >= 1024.0**3, unit(3, "GB")).when(a >= 1024.0**2, unit(2, "MB")).when(a >= 1024.0, unit(1, "KB")).otherwise(F.concat(F.round(a).cast("long").cast("string"), F.lit(" B")))
    return F.when(finite(v), F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), body)).otherwise(F.lit("0 B"))


def points(v: Column) -> Column:
    """1.5K, 2M; a trailing .0 goes."""
    v = v.cast("double")
    short = lambda d, n: F.concat(F.regexp_replace(fixed(v / d, 1), r"\.0$", ""), F.lit(n))
    return F.when(v >= 1e6, short(1e6, "M")).when(v >= 1e3, short(1e3, "K")).otherwise(v.cast("long").cast("string"))


def duration(v: Column) -> Column:
    return F.concat(fixed(v, 3), F.lit("s"))


def progress(done: Column, total: Column) -> Column:
    """percent (done/total)."""
    share = F.when(total > 0, F.least(F.greatest(done / total, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return F.format_string("%d%% (%s/%s)", F.round(share * 100).cast("int"), points(done), points(total))


def fraction(done: Column, total: Column, done_bytes: Column, total_bytes: Column) -> Column:
    """done/total, or by bytes where done exceeds total; 0..1."""
    by_count = F.when(total > 0, done / total)
    by_bytes = F.when(total_bytes > 0, done_bytes / total_bytes)
    return F.least(F.greatest(F.coalesce(F.when(done <= total, by_count), by_bytes, by_count, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def boolean(s: Column) -> Column:
    """true/1/yes/on and any other text are true; false/0/no/off and blank are false; null is false."""
    t = F.lower(F.trim(s))
    return F.when(s.isNull() | (t == ""), False).when(t.isin("false", "0", "no", "off"), False).otherwise(True)


def leading_int(s: Column) -> Column:
    """The integer at the start of a text, else 0."""
    return F.coalesce(F.regexp_extract(F.coalesce(s, F.lit("")), r"^\s*([+-]?\d{1,18})", 1).try_cast("long"), F.lit(0).cast("long"))


def positive_int(s: Column, default: int) -> Column:
    n = leading_int(s)
    return F.when(n > 0, n).otherwise(F.lit(default).cast("long"))


def leading_float(s: Column) -> Column:
    """The number at the start of a text, else 0.0 (as the scan of ASCII files reads tokens)."""
    return F.coalesce(F.regexp_extract(F.coalesce(s, F.lit("")), r"^\s*([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def preset_key(s: Column) -> Column:
    t = F.lower(F.trim(s))
    return F.when(t.isin("fast", "balanced", "quality", "custom"), t).otherwise(F.lit("custom"))


def file_name(s: Column) -> Column:
    """A safe file name that ends in .ply."""
    t = F.regexp_replace(s, r"[^\w\-.]+", "_")
    return F.when(F.lower(t).endswith(".ply"), t).otherwise(F.concat(t, F.lit(".ply")))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")


def point(x: Column, y: Column, z: Column) -> Column:
    return F.concat(F.lit("("), F.concat_ws(", ", *(fixed(c, 3) for c in (x, y, z))), F.lit(")"))


def memory_limit(s: Column) -> Column:
    """512mb and the like in bytes; blank is 0; a bare number is bytes."""
    t = F.lower(F.trim(F.coalesce(s, F.lit(""))))
    n = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)\s*([kmgt]?)i?b?$", 1).try_cast("double")
    unit = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)\s*([kmgt]?)i?b?$", 2)
    power = F.when(unit == "k", 1024.0).when(unit == "m", 1024.0**2).when(unit == "g", 1024.0**3).when(unit == "t", 1024.0**4).otherwise(1.0)
    return F.coalesce((n * power).cast("long"), F.lit(0).cast("long"))
