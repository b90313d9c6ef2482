"""Streams of point chunks and of telemetry events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.units import scale
from ..operators import batches, telemetry
from ..operators.aggregates import bounds, intensity_range, micros
from ..operators.sampling import LEVELS, step_level
from ..operators.telemetry import bypass


def read_chunks(spark: SparkSession, path: str, schema: T.StructType, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def ingest(chunks: DataFrame, out: str, checkpoint: str, unit_scale: float = 1.0) -> StreamingQuery:
    """Scale and append each chunk to the table at `out`; a chunk that is replayed replaces its own files."""

    def append(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/chunk={epoch}")

    return scale(chunks, unit_scale).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_batches(chunks: DataFrame, root: str, checkpoint: str, unit_scale: float = 1.0) -> StreamingQuery:
    """Scale each micro-batch and append it to the cloud at `root` with its aggregates, which are observed while it is written; a replayed one takes its own place."""

    def append(batch: DataFrame, epoch: int) -> None:
        batches.append(batch, root, f"{epoch:012d}")

    return scale(chunks, unit_scale).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(spark: SparkSession, root: str, total: int, interval: float | None = None) -> DataFrame:
    """epoch, at, rows, processed and fraction of each micro-batch of ingest_batches so far: processed grows with every batch, and fraction reaches 1 at `total`.

    interval: only what the throttle lets through (complete progress always). Read from the rows that the batches keep, one of each; the points are not read.
    """
    own = batches.aggregates(spark, root).select(F.col("batch").cast("long").alias("epoch"), "at", F.col("n").alias("rows"), F.lit("import").alias("job"))
    done = F.sum("rows").over(Window.partitionBy("job").orderBy("epoch"))
    told = own.withColumn("processed", done).withColumn("fraction", F.least(F.col("processed") / F.lit(max(total, 1)), F.lit(1.0)) if total > 0 else F.lit(0.0))
    if interval is not None:
        told = told.join(telemetry.throttle(told, "job", "at", "epoch", interval, fraction="fraction"), ["job", "epoch"], "left_semi")
    return told.select("epoch", "at", "rows", "processed", "fraction")


def running_bounds(chunks: DataFrame, name: str) -> StreamingQuery:
    """Bounds of all chunks so far (complete mode: partial per chunk, merged in state)."""
    return bounds(chunks).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()


def running_intensity(chunks: DataFrame, name: str) -> StreamingQuery:
    return intensity_range(chunks).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by event-time window; events later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


class _Throttle(StatefulProcessor):
    def __init__(self, interval: float):
        self.interval = interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us long, said string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        every = pd.concat(list(rows)).sort_values(["us", "tie"])
        last, told = self.last.get() if self.last.exists() else (None, None)
        kept = []
        for us, tie, said, go in zip(every["us"].tolist(), every["tie"].tolist(), every["said"].tolist(), every["go"].tolist(), strict=True):
            if last is None or go or us - last >= self.interval * 1e6 or (said is not None and said != told):
                last, told = us, said
                kept.append(tie)
        if last is not None:
            self.last.update((last, told))
        yield pd.DataFrame({"key": [key[0]] * len(kept), "tie": kept})

    def close(self) -> None:
        pass


def throttle(events: DataFrame, key: str, ts: str, tie: str, interval: float, message: str | None = None, force: str | None = None, fraction: str | None = None) -> DataFrame:
    """Like telemetry.throttle; the time and the message last let through are state."""
    said = F.col(message).cast("string") if message else F.lit(None).cast("string")
    rows = events.select(F.col(key).cast("string").alias("key"), micros(ts).alias("us"), F.col(tie).cast("long").alias("tie"), said.alias("said"), bypass(force, fraction).alias("go"))
    return rows.groupBy("key").transformWithStateInPandas(_Throttle(interval), "key string, tie long", "append", "None")


def next_level(ratio: float, level: float | None) -> float:
    """One step of the level-of-detail hysteresis."""
    names = [lv for lv, _, _ in LEVELS]
    return names[step_level(ratio, None if level is None else names.index(level))]


class _Hysteresis(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.level = handle.getValueState("level", "level double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        every = pd.concat(list(rows)).sort_values(["us", "tie"])
        level = self.level.get()[0] if self.level.exists() else None
        out = []
        for ratio in every["ratio"].tolist():
            level = next_level(ratio, level)
            out.append(level)
        if level is not None:
            self.level.update((level,))
        yield pd.DataFrame({"key": [key[0]] * len(out), "tie": every["tie"].tolist(), "level": out})

    def close(self) -> None:
        pass


def hysteresis(events: DataFrame, key: str, ratio: str, ts: str, tie: str) -> DataFrame:
    """The level of detail after each event of a camera; the level is state."""
    rows = events.select(F.col(key).cast("string").alias("key"), micros(ts).alias("us"), F.col(tie).cast("long").alias("tie"), F.col(ratio).cast("double").alias("ratio"))
    return rows.groupBy("key").transformWithStateInPandas(_Hysteresis(), "key string, tie long, level double", "append", "None")
