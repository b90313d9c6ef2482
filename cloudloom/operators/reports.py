"""Telemetry tables: their columns, summaries, and CSV folders that runs append to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed

#: The columns of each table.
COLUMNS = {
    "color_rebuild": "timestamp cloud generation success processed total primary_total duration primary_duration rate peak_memory color_mode economy_enabled economy_step economy_visible economy_threshold".split(),
    "color_bench": "timestamp scenario color_mode color_gradient duration processed_points rate peak_memory economy_enabled notes".split(),
    "stress": "timestamp preset phase duration_sec status peak_memory_bytes fps notes".split(),
    "measurements": "timestamp distance label from_x from_y from_z to_x to_y to_z".split(),
}


#: Columns of the colour tables that are counts (0 if missing), flags (0 or 1) and numbers of three decimals (empty if missing).
COUNTS = "generation processed total primary_total peak_memory economy_step economy_visible economy_threshold processed_points".split()
FLAGS = ["success", "economy_enabled"]
DECIMALS = ["duration", "primary_duration", "rate"]


def rows(df: DataFrame, kind: str) -> DataFrame:
    """df in the columns of a table, in their order; lists joined by bars; others are left out.

    The colour tables hold 0 for a missing count or flag, and three decimals of durations and rates; a row without a timestamp gets the time
    of the query. Other missing columns and values are empty.
    """
    types, colour = dict(df.dtypes), kind.startswith("color")

    def own(c: str) -> Column:
        there = c in types
        if colour and c in COUNTS:
            return F.coalesce(F.col(c).cast("double").cast("long"), F.lit(0)).cast("string") if there else F.lit("0")
        if colour and c in FLAGS:
            kept = F.coalesce(F.col(c), F.lit(False)) if there and types[c] == "boolean" else F.col(c).isNotNull() if there else F.lit(False)
            return kept.cast("int").cast("string")
        if colour and c in DECIMALS:
            return F.coalesce(fixed(F.col(c).cast("double"), 3), F.lit("")) if there else F.lit("")
        now = iso(F.current_timestamp()) if colour and c == "timestamp" else F.lit("")
        if not there:
            return now
        value = F.col(c).cast("int") if types[c] == "boolean" else F.concat_ws("|", c) if types[c].startswith("array") else F.col(c)
        return F.coalesce(value.cast("string"), now)

    return df.select(*(own(c).alias(c) for c in COLUMNS[kind]))


def append(df: DataFrame, kind: str, path: str) -> None:
    """Adds rows to a table's CSV folder; every part has a header, and fields are quoted where a table asks for it."""
    rows(df, kind).write.mode("append").option("header", True).option("quoteAll", kind == "measurements").csv(path)


def summary(entries: DataFrame, *by: str) -> DataFrame:
    """duration, processed, rate and peak memory of each scenario (or job): entries have duration, processed and peak_memory."""
    out = entries.groupBy(*by).agg(F.sum("duration").alias("duration"), F.sum("processed").alias("processed"), F.max("peak_memory").alias("peak_memory"))
    return out.withColumn("rate", F.when(F.col("duration") > 0, F.col("processed") / F.col("duration")).otherwise(F.lit(0.0)))


def import_summary(phases: DataFrame, job: str = "job") -> DataFrame:
    """total, parse and append seconds, points and peak memory of each import: phases have phase, duration, points and peak_memory."""
    of = lambda p: F.coalesce(F.sum(F.when(F.col("phase") == p, F.col("duration"))), F.lit(0.0))
    return phases.groupBy(job).agg(F.sum("duration").alias("total"), of("parsing").alias("parse"), of("append").alias("append"), F.max("points").alias("points"), F.max("peak_memory").alias("peak_memory"))


def timestamp(v: Column) -> Column:
    """A time from text: seconds since 1970 or a date and time; anything else is the time of the query."""
    seconds = v.cast("string").try_cast("double")
    return F.coalesce(F.timestamp_micros((seconds * 1e6).cast("long")), F.try_to_timestamp(v.cast("string")), F.current_timestamp())


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def shown(ts: Column) -> Column:
    return F.date_format(ts, "dd.MM.yyyy HH:mm:ss")
