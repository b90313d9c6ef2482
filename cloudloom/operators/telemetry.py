"""Event-stream operators in batch form: windows per job, not over all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .aggregates import micros
from .lineage import written

#: The states of an import job, the states that may follow each, and time limits in seconds.
FOLLOW = {
    "init": ("parsing", "cancelled", "failed"),
    "parsing": ("sampling", "cancelled", "failed"),
    "sampling": ("build_index", "cancelled", "failed"),
    "build_index": ("register", "cancelled", "failed"),
    "register": ("ready", "cancelled", "failed"),
    "ready": ("cancelled", "failed"),
    "cancelled": (),
    "failed": (),
}
LIMITS = {"parsing": 120.0, "sampling": 60.0, "build_index": 120.0, "register": 30.0}


def seconds(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / 1e6


def _over(job: str, ts: str, tie: str) -> Window:
    return Window.partitionBy(job).orderBy(ts, tie)


def phase_durations(rows: DataFrame, job: str, ts: str, tie: str) -> DataFrame:
    """Seconds until the next event of the job."""
    return rows.withColumn("duration", seconds(F.lead(ts).over(_over(job, ts, tie)), F.col(ts)))


def emit_interval(rows: DataFrame, job: str, ts: str, tie: str) -> DataFrame:
    gap = seconds(F.col(ts), F.lag(ts).over(_over(job, ts, tie)))
    return rows.withColumn("interval", gap).withColumn("frequency", F.when(F.col("interval") > 0, 1.0 / F.col("interval")))


def debounce(rows: DataFrame, job: str, ts: str, tie: str, quiet: float) -> DataFrame:
    """Events that no other event of the job follows within `quiet` seconds."""
    gap = seconds(F.lead(ts).over(_over(job, ts, tie)), F.col(ts))
    return rows.withColumn("__gap", gap).filter(F.col("__gap").isNull() | (F.col("__gap") >= quiet)).drop("__gap")


def latest(rows: DataFrame, job: str, version: str) -> DataFrame:
    """Rows of the current version of each job: stale work is dropped."""
    now = rows.groupBy(job).agg(F.max(version).alias("__now"))
    return rows.join(now, job).filter(F.col(version) == F.col("__now")).drop("__now")


def fsm_check(rows: DataFrame, job: str, state: str, ts: str, tie: str) -> DataFrame:
    """Whether each state may follow the one before (the first must be init)."""
    before = F.coalesce(F.lag(state).over(_over(job, ts, tie)), F.lit("init"))
    allowed = F.create_map(*[v for s, n in FOLLOW.items() for v in (F.lit(s), F.array(*map(F.lit, n)).cast("array<string>"))])
    first = F.lag(state).over(_over(job, ts, tie)).isNull()
    ok = F.when(first, F.col(state) == "init").otherwise(F.coalesce(F.array_contains(F.element_at(allowed, before), F.col(state)), F.lit(False)))
    return rows.withColumn("valid", ok)


def state_timeout(rows: DataFrame, job: str, state: str, ts: str, tie: str) -> DataFrame:
    """States that lasted longer than their limit."""
    limit = F.element_at(F.create_map(*[v for s, n in LIMITS.items() for v in (F.lit(s), F.lit(n))]), F.col(state))
    return phase_durations(rows, job, ts, tie).filter(F.col("duration") > limit)


def suppress_repeats(rows: DataFrame, job: str, text: str, ts: str, tie: str) -> DataFrame:
    """Consecutive equal messages of a job as one: first_ts, last_ts, n."""
    w = _over(job, ts, tie)
    new = F.when(F.lag(text).over(w).eqNullSafe(F.col(text)), 0).otherwise(1)
    runs = rows.withColumn("__new", new).withColumn("run", F.sum("__new").over(w))
    return runs.groupBy(job, "run").agg(F.first(text).alias(text), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))


def bypass(force: str | None, fraction: str | None) -> Column:
    """Whether an event goes through whatever the time: it is forced, or the work is complete."""
    forced = F.coalesce(F.col(force), F.lit(False)) if force else F.lit(False)
    return forced | F.coalesce(F.col(fraction) >= 1.0, F.lit(False)) if fraction else forced


def throttle(rows: DataFrame, job: str, ts: str, tie: str, interval: float, message: str | None = None, force: str | None = None, fraction: str | None = None) -> DataFrame:
    """Events at least `interval` seconds after the last one let through, and the first of each job; with a message, force or fraction column also those
    whose message (not null) is not that of the last one let through, forced ones, and those whose fraction is 1 or more.

    Some events go through whatever came before: those `interval` or more after the one before, forced and complete ones, and those whose
    message differs from that of the event before (neither null). So a job falls into bursts that are folded apart, each in a
    stream of sorted batches: only the time and message last let through are held.
    """
    step = int(round(interval * 1e6))
    said = F.col(message).cast("string") if message else F.lit(None).cast("string")
    timed = rows.select(job, tie, micros(ts).alias("__us"), said.alias("__said"), bypass(force, fraction).alias("__go"))
    window = Window.partitionBy(job).orderBy("__us", tie)
    new = (F.col("__us") - F.lag("__us").over(window) >= step) | F.col("__go") | F.coalesce(F.col("__said") != F.lag("__said").over(window), F.lit(False))
    bursts = timed.withColumn("__new", F.coalesce(new.cast("int"), F.lit(1))).withColumn("__burst", F.sum("__new").over(window))
    ordered = bursts.select(job, tie, "__us", "__said", "__burst").repartition(F.col(job), F.col("__burst")).sortWithinPartitions(job, "__burst", "__us", tie)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last, told = None, 0, None
        for b in batches:
            us, said, burst, keys = b["__us"].to_numpy(), b["__said"].to_numpy(), b["__burst"].to_numpy(), b[job].to_numpy()
            go = np.zeros(len(b), bool)
            for i in range(len(b)):
                if at != (here := (keys[i], burst[i])) or us[i] - last >= step or (said[i] is not None and said[i] != told):
                    go[i], at, last, told = True, here, us[i], said[i]
            yield b.loc[go, [job, tie]]

    return ordered.mapInPandas(run, T.StructType([rows.schema[job], rows.schema[tie]]))


def _alike(a: object, b: object) -> bool:
    return a == b or (a is None or a != a) and (b is None or b != b)


def hysteresis(rows: DataFrame, job: str, ratio: str, ts: str, tie: str) -> DataFrame:
    """The level of detail after each event of a camera: each depends on the one before.

    Events are sorted by range, so one camera may lie in many tasks. What a range does to a camera that goes on from the range before
    is a map from the levels (and none) to levels. Each range folds its map alone; the maps are composed in the order of the ranges, which takes
    one row of each range, and then every range knows with which level it begins.
    """
    from .sampling import LEVELS, step_level

    none = len(LEVELS)  # the state before the first event of a camera
    own = rows.select(job, micros(ts).alias("__us"), tie, F.col(ratio).cast("double").alias("__ratio"))
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = own.repartitionByRange(n, job, "__us", tie).sortWithinPartitions(job, "__us", tie)
    ordered = written(ordered.withColumn("__part", F.spark_partition_id()))

    def ratios(b: pd.DataFrame) -> Iterator[tuple[object, float]]:
        return zip(b[job].to_numpy(), b["__ratio"].to_numpy(np.float64, na_value=np.nan), strict=True)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, first, last, level = None, None, None, none
        ends: list[int] | None = None
        for b in batches:
            for key, r in ratios(b):
                if ends is None:
                    part, first, last, ends, one = int(b["__part"].iloc[0]), key, key, [*range(none + 1)], True
                if one and not _alike(key, first):
                    one, level = False, none
                if one:
                    after = {k: step_level(r, None if k == none else k) for k in {*ends}}
                    ends = [after[k] for k in ends]
                else:
                    level = step_level(r, level if _alike(key, last) and level != none else None)
                last = key
        if ends is not None:
            yield pd.DataFrame({"part": [part], "first": [first], "last": [last], "ends": [ends], "level": [None if one else level]}).astype({"level": "Int64"})

    kind = rows.schema[job].dataType.simpleString()
    folded = ordered.mapInPandas(fold, f"part int, first {kind}, last {kind}, ends array<long>, level long").collect()  # one row of each range
    begin, before, carried = {}, None, none
    for r in sorted(folded, key=lambda r: r["part"]):
        start = carried if before is not None and _alike(before["last"], r["first"]) else none
        begin[r["part"]] = start
        carried = r["ends"][start] if r["level"] is None else r["level"]
        before = r

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, level, fresh = None, none, True
        for b in batches:
            out = np.empty(len(b))
            for i, (key, r) in enumerate(ratios(b)):
                if fresh:
                    at, level, fresh = key, begin[int(b["__part"].iloc[0])], False
                level = step_level(r, level if _alike(at, key) and level != none else None)
                at, out[i] = key, LEVELS[level][0]
            yield pd.DataFrame({job: b[job], tie: b[tie], "level": out})

    return ordered.mapInPandas(run, T.StructType([rows.schema[job], rows.schema[tie], T.StructField("level", T.DoubleType())]))
