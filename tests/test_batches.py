"""Batches with their aggregates, and folders of files in several units."""

import math
import struct

import pytest

from cloudloom.functions import units
from cloudloom.operators import aggregates as agg
from cloudloom.operators import batches
from cloudloom.sources import ply
from pyspark.sql import functions as F

POINT = "idx long, x double, y double, z double, intensity double"


def test_supplied_aggregates_are_taken_and_others_observed(spark, tmp_path):
    root = str(tmp_path / "c")
    one = spark.createDataFrame([(0, -1.0, 2.0, -3.0, 0.25), (1, 4.0, -5.0, 6.0, 0.75)], POINT)
    batches.append(one, root, "one", agg.Box(-1.0, -5.0, -3.0, 4.0, 2.0, 60.0), (0.9, 0.1))  # not quite those of the points: they are believed
    row = batches.summary(spark, root).first()
    assert (row["n"], row["max_z"], row["min_intensity"], row["max_intensity"]) == (2, 60.0, 0.1, 0.9)
    two = spark.createDataFrame([(2, 1.0, 2.0, 3.0, 0.1), (3, 4.0, 5.0, 6.0, math.nan), (4, None, 99.0, 99.0, math.inf), (5, math.nan, 7.0, 0.0, None)], POINT)
    batches.append(two, root, "two", agg.Box(1.0, 0.0, 0.0, math.inf, 1.0, 1.0), (math.nan, 1.0))  # not usable
    got = {r["batch"]: r for r in batches.aggregates(spark, root).collect()}
    assert [got["two"][c] for c in ("n", "min_x", "max_x", "max_y", "min_z", "min_intensity", "max_intensity")] == [4, 1.0, 4.0, 7.0, 0.0, 0.1, 0.1]
    batches.append(one, root, "one")  # again, under its name
    whole = batches.points(spark, root)
    assert whole.count() == 6
    row = batches.summary(spark, root).first()
    assert tuple(row[f"{e}_{a}"] for e in ("min", "max") for a in "xyz") == tuple(agg.bounds(whole).first()) and tuple(row)[-2:] == tuple(agg.intensity_range(whole).first())


def test_a_batch_without_its_row_does_not_count(spark, tmp_path):
    root = str(tmp_path / "c")
    batches.append(spark.createDataFrame([(0, 1.0, 1.0, 1.0)], "idx long, x double, y double, z double"), root, "a")
    batches.append(spark.createDataFrame([], POINT), root, "b")
    spark.createDataFrame([(9, 9.0, 9.0, 9.0)], "idx long, x double, y double, z double").write.parquet(f"{root}/points/batch=b-died")
    assert [r["idx"] for r in batches.points(spark, root).collect()] == [0]
    assert batches.points(spark, root).columns == ["idx", "x", "y", "z", "intensity"]
    row = batches.summary(spark, root).first()
    assert (row["batches"], row["n"], row["max_x"], row["min_intensity"]) == (2, 1, 1.0, None)
    with pytest.raises(ValueError):
        batches.append(spark.range(1), root, "a/b")


def test_a_folder_in_several_units(spark, tmp_path):
    head = "ply\nformat {} 1.0\n{}element vertex {}\n" + "".join(f"property float {a}\n" for a in "xyz") + "end_header\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "a.ply").write_bytes(head.format("binary_little_endian", "comment units: meters\n", 100).encode() + b"".join(struct.pack("<fff", k, 0, 1) for k in range(100)))
    (tmp_path / "in" / "b.ply").write_bytes(head.format("binary_big_endian", "comment by hand\nobj_info unit feet\ncomment units: meters\n", 2).encode() + struct.pack(">ffffff", 1, 2, 3, 4, 5, 6))
    (tmp_path / "c.ply").write_text(head.format("ascii", "", 2) + "1 2 3\n4 5 6\n")
    (tmp_path / "bad.ply").write_text("no header")
    (tmp_path / "other.txt").write_text("x")
    found = {r["path"].rsplit("/", 1)[1]: r for r in ply.unit_factors(ply.headers(spark, str(tmp_path)), explicit=2.0).collect()}
    foot, meter = (spark.range(1).select(units.by_key(F.lit(k))).first()[0] for k in ("foot", "meter"))
    assert {k: (r["unit"], r["factor"], r["vertices"]) for k, r in found.items() if not r["error"]} == {"a.ply": ("meter", meter, 100), "b.ply": ("foot", foot, 2), "c.ply": (None, 2.0, 2)}
    assert "PLY" in found["bad.ply"]["error"] or "end_header" in found["bad.ply"]["error"]
    got = {(r["path"].rsplit("/", 1)[1], r["idx"]): (r["x"], r["y"], r["z"]) for r in ply.read_folder(spark, str(tmp_path), explicit=2.0, range_bytes=64).collect()}
    assert len(got) == 104 and got["a.ply", 99] == (99 * meter, 0.0, meter) and got["b.ply", 1] == (4 * foot, 5 * foot, 6 * foot) and got["c.ply", 0] == (2.0, 4.0, 6.0)


def test_choice_of_a_factor(spark):
    lit = lambda v, kind: F.lit(v).cast(kind)
    choose = lambda s, t, e, m: spark.range(1).select(units.choose(lit(s, "string"), lit(t, "string"), lit(e, "double"), lit(m, "int"))).first()[0]
    meter, foot, millimeter = (choose(k, None, None, None) for k in ("meter", "foot", "millimeter"))
    assert choose("meter", "foot", 5.0, 2) == meter and choose(None, "foot", 5.0, 2) == foot and choose("ell", None, 5.0, 2) == 5.0
    assert choose(None, None, -1.0, 2) == choose(None, None, None, 2) and choose(None, None, None, None) == 1.0 and millimeter < foot < meter


def test_a_cloud_written_as_a_folder(spark, tmp_path):
    rows = [(k, k * 1.5, -k / 3, 7.0, k % 5, None if k % 4 == 0 else k / 8) for k in range(500)]
    df = spark.createDataFrame([*rows, (600, None, 1.0, 1.0, 1, 1.0)], "idx long, x double, y double, z double, rgb long, intensity double").repartition(5)
    folder = str(tmp_path / "out")
    assert ply.write_folder(df, folder) == 500
    found = ply.headers(spark, folder, "*.txt").collect()
    assert len(found) > 1 and sum(r["vertices"] for r in found) == 500 and not any(r["error"] for r in found)
    back = [tuple(r)[2:] for r in ply.read_folder(spark, folder, "*.txt", range_bytes=700).orderBy("path", "idx").collect()]
    assert back == [(x, round(y, 6), z, c, i or 0.0) for _, x, y, z, c, i in rows]  # files and rows in the order of idx
    with pytest.raises(ply.PlyError):
        ply.write_folder(df.filter("false"), str(tmp_path / "none"))
