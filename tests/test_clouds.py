"""Values stated by the specification of the operators, and brute force for those SQL cannot express."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloudloom.functions import color, text, units
from cloudloom.operators import aggregates as agg
from cloudloom.operators import numbering, octree, poisson, sampling, spatial, telemetry, updates
from cloudloom.settings import Settings

NAN, INF = float("nan"), float("inf")
POINT = "idx long, x double, y double, z double"


def cloud(spark, rows):
    return spark.createDataFrame([(i, *map(float, p)) if None not in p else (i, *p) for i, p in enumerate(rows)], POINT)


def test_bounds_and_merge(spark):
    b = agg.box_of(cloud(spark, [(-2, 3, 0.5), (4.5, -1, 10), (0, 2, -5)]))
    assert b == agg.Box(-2.0, -1.0, -5.0, 4.5, 3.0, 10.0)
    parts = spark.createDataFrame([(-1.0, -2.0, -3.0, 1.0, 2.0, 3.0), (-5.0, 0.0, -4.0, 10.0, 5.0, 8.0), (NAN, 0.0, 0.0, 0.0, 0.0, 99.0)], "min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
    assert tuple(agg.merge_bounds(parts).first()) == (-5.0, -2.0, -4.0, 10.0, 5.0, 8.0)


def test_bounds_skip_null_points_and_nan(spark):
    b = agg.bounds(spark.createDataFrame([(0, 1.0, 2.0, 3.0), (1, None, 50.0, 50.0), (2, NAN, 5.0, 6.0)], POINT)).first()
    assert tuple(b) == (1.0, 2.0, 3.0, 1.0, 5.0, 6.0)
    assert agg.box_of(cloud(spark, [])) is None


def test_intensity_range(spark):
    df = spark.createDataFrame([(v,) for v in (1.2, 5.0, 0.8, 7.5, INF, NAN, None)], "intensity double")
    assert tuple(agg.intensity_range(df).first()) == (0.8, 7.5)


def test_units(spark):
    row = spark.range(1).select(units.resolve(F.lit(None).cast("double"), F.lit(2)), units.resolve(F.lit(0.5), F.lit(2)), units.resolve(F.lit(0.0), F.lit(99))).first()
    assert tuple(row) == (1 / 25.4, 0.5, 1.0)
    got = units.scale(cloud(spark, [(1, 2, 3), (4, 5, 6)]), 2.0).orderBy("idx").collect()
    assert [tuple(r)[1:] for r in got] == [(2.0, 4.0, 6.0), (8.0, 10.0, 12.0)]
    assert spark.range(1).select(units.detect(F.lit("units: meters")), units.detect(F.lit("generated by scanner"))).first() == ("meter", None)


@given(st.tuples(*[st.integers(0, 255)] * 3))
@settings(max_examples=5, deadline=None)
def test_pack_and_unpack(spark, rgb):
    v = color.pack(*map(F.lit, rgb))
    assert tuple(spark.range(1).select(*color.unpack(v)).first()) == rgb


def test_pack_wraps_and_null(spark):
    assert spark.range(1).select(color.pack(F.lit(257), F.lit(-1), F.lit(2.9)), color.pack(F.lit(1), F.lit(None), F.lit(1))).first() == (1 << 16 | 255 << 8 | 2, None)


def test_random_color_is_the_sequence(spark):
    state, want = 0x9E3779B1, []
    for _ in range(300):
        state = (state * color.LCG_MUL + color.LCG_ADD) & 0xFFFFFFFF
        want.append(sum(color.half_away(((state >> s) & 255) / 2 + 64) << s for s in (16, 8, 0)))
    got = spark.range(300).select("id", color.random_color(F.col("id"), 0x9E3779B1).alias("c")).orderBy("id").collect()
    assert [r["c"] for r in got] == want


def test_fnv():
    assert color.fnv1a("") == 0x811C9DC5 and color.fnv1a("a") == 0xE40C292C


@pytest.mark.parametrize("n,parts", [(0, 4), (1, 4), (7, 4), (100, 4)])
def test_positions(spark, n, parts):
    ids = random.Random(n).sample(range(1000), n)
    got = numbering.positions(spark.createDataFrame([(i,) for i in ids], "idx long")).collect()
    assert {r["idx"]: r["pos"] for r in got} == {v: k for k, v in enumerate(sorted(ids))}


def test_stride():
    assert [sampling.stride(n, d, m) for n, d, m in ((0, 0.5, 10), (100, 1.0, 10), (100, 0.3, 1000), (100, 0.5, 10), (4_000_000, 0.5, 2_000_000))] == [1, 1, 3, 10, 4]
    assert sampling.index_sizes(80_000) == [50_000, 80_000] and sampling.index_sizes(10) == [10]
    assert sampling.ramp(0, 10_000) == 10_000 and sampling.ramp(0, 200_000) == 50_000
    assert sampling.economy(True, 800_000, 760_000) and not sampling.economy(True, 800_000, 700_000)


def test_chunks(spark):
    df = spark.range(8).withColumnRenamed("id", "idx")
    assert [r["n"] for r in sampling.chunk_ids(df, 3).orderBy("chunk_id").collect()] == [3, 3, 2]


def test_hysteresis_steps(spark):
    from cloudloom.streaming.ingest import next_level

    levels = [lv for lv, _, _ in sampling.LEVELS]
    ratios = [0.0, 0.5, 1.19, 1.2, 1.5, 1.6, 2.0, 2.6, 3.0, 3.6, 4.4, 4.5, 5.1, 9.0]
    rows = [(r, lv) for r in ratios for lv in [*levels, None]]
    got = spark.createDataFrame(rows, "r double, lv double").select("r", "lv", sampling.next_level(F.col("r"), F.col("lv")).alias("next")).collect()
    assert all(g["next"] == next_level(g["r"], g["lv"]) for g in got)


def test_ray_slab(spark):
    lit = lambda p: tuple(F.lit(float(v)) for v in p)
    one = lambda o, d: spark.range(1).select(*spatial.slab(lit(o), lit(d), lit((0, 0, 0)), lit((10, 10, 10)))).first()
    hit = one((5, 5, 5), (0, 1, 1e-10))
    assert (hit[0], hit[1], hit[2]) == (True, -5.0, 5.0)
    assert not one((15, 5, 5), (0, 1, 0))[0]


def test_box_corners(spark):
    lit = lambda p: tuple(F.lit(float(v)) for v in p)
    got = spark.range(1).select(F.array(*(F.array(*c) for c in octree.box_corners(lit((1, 2, 3)), lit((4, 5, 6)))))).first()[0]
    assert {tuple(c) for c in got} == {(x, y, z) for x in (1.0, 4.0) for y in (2.0, 5.0) for z in (3.0, 6.0)} and len(got) == 8


def _brute_leaves(pts, box, most, depth):
    out = {}

    def split(ids, lo, hi, path):
        if len(ids) <= most or len(path) >= depth:
            out.update(dict.fromkeys(ids, path))
            return
        mid = [(a + b) / 2 for a, b in zip(lo, hi, strict=True)]
        groups = {}
        for i in ids:
            groups.setdefault(sum((pts[i][k] >= mid[k]) << k for k in range(3)), []).append(i)
        for o, own in groups.items():
            split(own, [mid[k] if o >> k & 1 else lo[k] for k in range(3)], [hi[k] if o >> k & 1 else mid[k] for k in range(3)], path + str(o))

    split(list(range(len(pts))), [box.min_x, box.min_y, box.min_z], [box.max_x, box.max_y, box.max_z], "")
    return out


def test_octree_is_the_recursive_split(spark):
    rnd = random.Random(3)
    pts = [(rnd.random() ** 3, rnd.random(), rnd.gauss(0, 1)) for _ in range(400)]
    df = cloud(spark, pts)
    got = {r["idx"]: r["leaf"] for r in octree.leaves(df, 12, 5).collect()}
    assert got == _brute_leaves(pts, agg.box_of(df), 12, 5)


def test_frustum_sides():
    planes = octree.frustum((0.0, 0.0, 0.0), (1.0, 0.0, 0.0), fov=90.0, near=1.0, far=10.0)
    assert len(planes) == 6
    inside = lambda p: all(sum(n * (c - o) for n, c, o in zip(nv, p, at, strict=True)) >= 0 for at, nv in planes)
    assert inside((5.0, 0.0, 0.0)) and inside((5.0, 4.0, -4.0))
    assert not inside((0.5, 0.0, 0.0)) and not inside((11.0, 0.0, 0.0)) and not inside((5.0, 6.0, 0.0)) and not inside((5.0, 0.0, -6.0))
    assert octree.frustum((1.0, 1.0, 1.0), (1.0, 1.0, 1.0)) == []


def test_nearest_far_apart_and_k(spark):
    pts = [(0, 0, 0), (1000, 0, 0), (1000.5, 0, 0), (-5000, 3, 3), (0.001, 0, 0)]
    df = cloud(spark, pts)
    got = {(r["q_idx"], r["rank"]): r["idx"] for r in spatial.nearest_join(df, df, k=2).collect()}
    for i, p in enumerate(pts):
        want = sorted((sum((a - b) ** 2 for a, b in zip(p, q, strict=True)), j) for j, q in enumerate(pts) if j != i)
        assert [got[i, 1], got[i, 2]] == [want[0][1], want[1][1]]


def test_poisson_is_the_sequential_sample(spark):
    rnd = random.Random(5)
    pts = [(rnd.random(), rnd.random(), rnd.random()) for _ in range(150)]
    df = cloud(spark, pts)
    b = agg.box_of(df)
    far = [math.dist(p, b.center) for p in pts]
    bounding, taken, out = max(far), [], set()
    for i in sorted(range(len(pts)), key=lambda i: (-far[i], i)):
        if i in out:
            continue
        r = poisson.adaptive_radius(far[i], bounding, 40, 0.05)
        taken.append(i)
        out |= {j for j in range(len(pts)) if math.dist(pts[i], pts[j]) <= r}
        if len(taken) >= 40:
            break
    got = [r["idx"] for r in poisson.poisson(df, 40, 0.05).orderBy("rank").collect()]
    assert got == taken


def test_curvature(spark):
    rnd = np.random.default_rng(1)
    pts = rnd.random((80, 3)) * [1, 1, 0.1]
    got = {r["idx"]: r["curvature"] for r in spatial.curvature(cloud(spark, pts.tolist()), 0.3).collect()}
    for i, p in enumerate(pts):
        near = pts[((pts - p) ** 2).sum(1) <= 0.09]
        want = 0.0
        if len(near) >= 3:
            e = np.linalg.eigvalsh(np.cov(near.T, bias=True))
            want = 1 - min(max(e[0] / e.sum(), 0), 1) if e.sum() > 0 else 0.0
        assert got[i] == pytest.approx(want, abs=1e-7)


def test_merge_last_change_wins(spark):
    base = cloud(spark, [(1, 1, 1), (2, 2, 2)])
    changes = spark.createDataFrame([(0, 1, 5.0), (0, 2, 6.0), (9, 1, 7.0)], "idx long, seq long, z double")
    assert [r["z"] for r in updates.merge(base, changes).orderBy("idx").collect()] == [6.0, 2.0]


def test_unique_names(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, " "), (4, "a"), (5, None)], "k long, n string")
    got = [r["unique_name"] for r in updates.unique_names(df, "n", "k").orderBy("k").collect()]
    assert got == ["a", "a (2)", "Point Cloud", "a (3)", "Point Cloud (2)"]


def test_throttle_counts_from_the_last_emission(spark):
    df = spark.createDataFrame([("v", i, t) for i, t in enumerate((0.0, 0.1, 0.25))], "job string, i long, s double").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r["i"] for r in telemetry.throttle(df, "job", "ts", "i", 0.2).collect()) == [0, 2]


def test_formats(spark):
    vals = [(1234.0, "1.2k"), (0.0, "0"), (-5.0, "0"), (2_500_000.0, "2.5M"), (12.5, "13"), (NAN, "0"), (None, "0")]
    got = spark.createDataFrame(vals, "v double, w string").select(text.count(F.col("v")).alias("g"), "w").collect()
    assert all(r["g"] == r["w"] for r in got)
    sizes = [(512.0, "512 B"), (1536.0, "1.5 KB"), (-1048576.0, "-1 MB"), (3.25 * 1024**3, "3.25 GB"), (None, "0 B")]
    got = spark.createDataFrame(sizes, "v double, w string").select(text.size(F.col("v")).alias("g"), "w").collect()
    assert all(r["g"] == r["w"] for r in got)
    row = spark.range(1).select(text.points(F.lit(2_000_000)), text.memory_limit(F.lit("512mb")), text.memory_limit(F.lit("")), text.stem(F.lit("/a/b.c.ply")), text.leading_float(F.lit("1.5abc")), text.leading_float(F.lit("nan"))).first()
    assert tuple(row) == ("2M", 512 * 1024**2, 0, "b.c", 1.5, 0.0)


def test_settings():
    loose = {"startup_cap": "123", "invalidate_interval_ms": "450", "batch_vertices_limit": "789", "chunk_capacity": "321", "max_points_sampled": "654", "octree_max_points_per_node": "987", "octree_max_depth": "11", "density": "nan", "unknown": 1}
    s = Settings.normalized(loose)
    assert (s.startup_cap, s.invalidate_interval_ms, s.batch_vertices_limit, s.chunk_capacity, s.max_points_sampled, s.octree_max_points_per_node, s.octree_max_depth, s.density) == (123, 450, 789, 321, 654, 987, 11, 1.0)
    assert s.with_preset("fast").density == 0.35 and s.changed(density=0.5).import_preset == "custom"
    assert Settings.from_json(s.to_json()) == s


def test_unique_names_of_a_common_name_in_ranges(spark):
    from cloudloom.operators import updates

    rows = [(i, "a" if i % 9 else None) for i in range(900)]
    out = updates.unique_names(spark.createDataFrame(rows, "id long, name string"), "name", "id")
    assert out.columns == ["id", "name", "unique_name"]
    want, seen = {}, {}
    for i, name in rows:
        name = name or "Point Cloud"
        k = seen[name] = seen.get(name, 0) + 1
        want[i] = name if k == 1 else f"{name} ({k})"
    assert {r["id"]: r["unique_name"] for r in out.collect()} == want
    windows = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number" in line]
    assert windows and all("__part" in line for line in windows)  # a task holds a range of a name, not a name


def test_display_scalars_and_fallbacks(spark):
    from cloudloom.operators import display

    assert display.world_tolerance(10.0, 0.5) == 5.0 and display.world_tolerance(10.0, None, 200.0, 100.0) == 20.0 and display.world_tolerance(10.0) == 10.0
    assert display.first_limit(250_000, 1000, 1.0) == (1000, 0.3)
    p = spark.createDataFrame([(0, 0.0, 0.0, 0.0, None, 1.0), (1, 1.0, 2.0, 3.0, 255, None)], "idx long, x double, y double, z double, rgb long, intensity double")
    rgb = lambda *a: [r["rgb"] for r in display.colorize(p, *a).orderBy("idx").collect()]
    assert rgb("original") == [0xFFFFFF, 255] == rgb(None) and rgb("rgb_xyz") == [0, 0xFFFFFF]
    assert rgb("intensity", "nonsense")[1] == rgb("height", "viridis")[1]  # no value: by height
    assert [r["rgb"] for r in display.colorize(p.drop("rgb"), "original").collect()] == [0xFFFFFF] * 2
    catalog = spark.createDataFrame([("a", True, True, 3), ("b", True, False, 3), ("c", False, True, 3), ("d", True, True, 0)], "name string, visible boolean, pending boolean, points int")
    assert [r["name"] for r in display.candidates(catalog).collect()] == ["a"]
    assert display.view(p, octree.frustum((0.0, 0.0, -9.0), (0.0, 0.0, 0.0)), 10, 3, visible=False).count() == 0
    ends = spark.createDataFrame([(0.5, 2.0), (0.2, None), (None, 3.5), (4.0, 1.0)], "min_intensity double, max_intensity double")
    assert tuple(display.merge_ranges(ends).first()) == (0.2, 4.0)


def test_report_rows_and_csv(spark, tmp_path):
    from cloudloom.operators import reports

    df = spark.createDataFrame([("b", True, 1.5, ["x", "y"], 7)], "scenario string, economy_enabled boolean, duration double, notes array<string>, other int")
    for _ in range(2):
        reports.append(df, "color_bench", str(tmp_path / "m"))
    got = spark.read.option("header", True).csv(str(tmp_path / "m")).collect()
    assert len(got) == 2 and got[0].asDict()["economy_enabled"] == "1" and got[0]["notes"] == "x|y" and [*got[0].asDict()] == reports.COLUMNS["color_bench"]
    assert [len(reports.COLUMNS[k]) for k in ("color_rebuild", "color_bench", "stress", "measurements")] == [16, 10, 8, 9]
    ts = spark.createDataFrame([("0",), ("2020-02-03 04:05:06",), ("never",)], "t string").select(reports.iso(reports.timestamp(F.col("t"))).alias("t")).collect()
    assert ts[0]["t"] == "1970-01-01T00:00:00Z" and ts[1]["t"] == "2020-02-03T04:05:06Z" and ts[2]["t"] > "2024"
