import math
import random

from pyspark.sql import functions as F

from cloudloom.operators import aggregates as agg
from cloudloom.operators import clouds, telemetry
from cloudloom.streaming import ingest


def _chunks(spark, sf, tmp_path):
    p = clouds.events(spark, sf).drop("ts")
    for k in range(3):
        p.filter(F.col("idx") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return p, ingest.read_chunks(spark, str(tmp_path / "in"), p.schema)


def test_ingest_and_running_aggregates(spark, sf, tmp_path):
    p, chunks = _chunks(spark, sf, tmp_path)
    q = ingest.ingest(chunks, str(tmp_path / "out"), str(tmp_path / "cp"), 2.0)
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == p.count() and out.agg(F.sum("x")).first()[0] == 2 * p.agg(F.sum("x")).first()[0]
    q = ingest.running_bounds(ingest.read_chunks(spark, str(tmp_path / "in"), p.schema), "running")
    q.awaitTermination()
    assert tuple(spark.table("running").first()) == tuple(agg.bounds(p).first())


def test_streamed_throttle_and_hysteresis_equal_batch(spark, sf, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ratio", F.col("value") / 80.0)
    e.orderBy("ts", "event_id").coalesce(1).write.parquet(str(tmp_path / "ev"))
    read = lambda: spark.readStream.schema(e.schema).parquet(str(tmp_path / "ev"))
    q = ingest.throttle(read(), "user_id", "ts", "event_id", 86400.0).writeStream.format("memory").queryName("thr").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["key"], r["tie"]) for r in spark.table("thr").collect()}
    assert got == {(str(r["user_id"]), r["event_id"]) for r in telemetry.throttle(e, "user_id", "ts", "event_id", 86400.0).collect()}
    q = ingest.hysteresis(read(), "user_id", "ratio", "ts", "event_id").writeStream.format("memory").queryName("hys").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["key"], r["tie"], r["level"]) for r in spark.table("hys").collect()}
    assert got == {(str(r["user_id"]), r["event_id"], r["level"]) for r in telemetry.hysteresis(e, "user_id", "ratio", "ts", "event_id").collect()}
    more = ("message", "force", "fraction")
    told = lambda d: d.withColumns({"message": F.when(F.col("event_id") % 5 > 0, F.floor(F.col("event_id") / 90).cast("string")), "force": F.col("event_id") % 17 == 0, "fraction": F.col("value") / 400})
    q = ingest.throttle(told(read()), "user_id", "ts", "event_id", 604800.0, *more).writeStream.format("memory").queryName("thr2").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["key"], r["tie"]) for r in spark.table("thr2").collect()}
    assert got == {(str(r["user_id"]), r["event_id"]) for r in telemetry.throttle(told(e), "user_id", "ts", "event_id", 604800.0, *more).collect()} and len(got) < e.count()


def test_one_camera_over_many_tasks(spark):
    """Most events are one camera's; the levels are those of one pass over its events."""
    from cloudloom.operators import sampling

    r = random.Random(3)
    rows = [("one" if k % 9 else f"c{k % 5}", k, r.choice((0.5, 1.4, 1.6, 2.4, 2.7, 3.4, 3.7, 4.9, 6.0, float("nan"), None))) for k in range(3000)] + [(None, k, 2.0 + k % 3) for k in range(50)]
    df = spark.createDataFrame(rows, "camera string, k long, ratio double").withColumn("ts", F.timestamp_seconds(F.col("k")))
    want, level = {}, {}
    for camera, k, ratio in sorted(rows, key=lambda x: x[1]):
        level[camera] = sampling.step_level(math.nan if ratio is None else ratio, level.get(camera))
        want[camera, k] = sampling.LEVELS[level[camera]][0]
    got = telemetry.hysteresis(df.repartition(3), "camera", "ratio", "ts", "k")
    assert {(x["camera"], x["k"]): x["level"] for x in got.collect()} == want
    assert got.filter("camera = 'one'").select(F.spark_partition_id()).distinct().count() > 1


def test_throttle_bypass(spark):
    rows = [("a", 0, "x", False, 0.1), ("a", 1, "x", False, 0.2), ("a", 2, None, False, 0.2), ("a", 3, "x", False, 0.3), ("a", 4, "y", False, 0.3), ("a", 5, "y", True, 0.3), ("a", 6, "y", False, 1.0), ("a", 7, "y", None, None), ("a", 16, "y", False, 0.5), ("b", 3, None, False, 0.0), ("b", 4, "z", False, 0.0)]
    df = spark.createDataFrame(rows, "job string, i long, message string, force boolean, fraction double").withColumn("ts", F.timestamp_seconds(F.col("i")))
    got = telemetry.throttle(df, "job", "ts", "i", 10.0, "message", "force", "fraction").collect()
    assert sorted((x["job"], x["i"]) for x in got) == [("a", 0), ("a", 4), ("a", 5), ("a", 6), ("a", 16), ("b", 3), ("b", 4)]


def test_progress_of_a_stream(spark, tmp_path):
    from cloudloom.operators import batches

    rows = [(k, float(k), -float(k), 1.0) for k in range(1000)]
    df = spark.createDataFrame(rows, "idx long, x double, y double, z double")
    for k, (lo, hi) in enumerate([(0, 100), (100, 600), (600, 1000)]):
        df.filter(f"idx >= {lo} and idx < {hi}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k != 1:  # the first run takes one file, the second one the other two, one at a time
            ingest.ingest_batches(ingest.read_chunks(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "cloud"), str(tmp_path / "c"), 2.0).awaitTermination()
    got = ingest.progress(spark, str(tmp_path / "cloud"), 1000).orderBy("epoch").collect()
    sizes = [r["rows"] for r in got if r["rows"]]
    assert sorted(sizes) == [100, 400, 500] and sizes[0] == 100 and got[-1]["processed"] == 1000 and got[-1]["fraction"] == 1.0
    assert all(a["processed"] <= b["processed"] and a["at"] <= b["at"] for a, b in zip(got, got[1:]))
    whole = batches.summary(spark, str(tmp_path / "cloud")).first()
    assert (whole["n"], whole["max_x"], whole["min_y"]) == (1000, 1998.0, -1998.0) == (batches.points(spark, str(tmp_path / "cloud")).count(), 1998.0, -1998.0)
    few = [r["fraction"] for r in ingest.progress(spark, str(tmp_path / "cloud"), 1000, interval=3600.0).orderBy("epoch").collect()]
    assert few[0] == 0.1 and few[-1] == 1.0 and len(few) == 2


def test_rows_of_the_colour_tables(spark):
    from cloudloom.operators import reports

    df = spark.createDataFrame([("a", None, None, 7.9, None, 1.23456)], "cloud string, success boolean, generation int, processed double, duration double, rate double")
    row = reports.rows(df, "color_rebuild").first().asDict()
    assert (row["success"], row["generation"], row["processed"], row["total"], row["duration"], row["rate"], row["economy_enabled"], row["color_mode"]) == ("0", "0", "7", "0", "", "1.235", "0", "")
    assert row["timestamp"] > "2024" and [*row] == reports.COLUMNS["color_rebuild"]
