"""The stored cloud: the same rows as the plain frustum query, less read, and manifests of competing builds."""

import math
import random

import pytest

from cloudloom.operators import aggregates as agg
from cloudloom.operators import octree, store

POINT = "idx long, x double, y double, z double"


def plain_path(p, box, depth):
    low, high, out = [box.min_x, box.min_y, box.min_z], [box.max_x, box.max_y, box.max_z], ""
    for _ in range(depth):
        digit = 0
        for i in range(3):
            mid = (low[i] + high[i]) / 2
            if p[i] >= mid or math.isnan(p[i]):
                digit, low[i] = digit | 1 << i, mid
            else:
                high[i] = mid
        out += str(digit)
    return out


@pytest.mark.parametrize(("scale", "off"), [(1.0, 0.0), (1e9, -3.0), (1e-9, 1e3)])
@pytest.mark.parametrize("depth", [0, 9, 14])
def test_paths_agree_with_a_recursive_split(spark, scale, off, depth):
    """Also where cells are hardly wider than the rounding of their ends, outside the box, and without a number."""
    r = random.Random(1)
    pts = [(off + scale * r.uniform(-1, 1), off + scale * r.choice((0, 0.25, 0.5, 1)), off + scale * r.gauss(0, 1)) for _ in range(200)]
    box = agg.Box(*(min(p[i] for p in pts) for i in range(3)), *(max(p[i] for p in pts) for i in range(3)))
    pts += [(math.nan, off, off), (math.inf, off, -math.inf), (off + 99 * scale, off - 99 * scale, off)]
    got = octree.paths(spark.createDataFrame([(k, *p) for k, p in enumerate(pts)], POINT), box, depth).collect()
    assert {r["idx"]: r["path"] for r in got} == {k: plain_path(p, box, depth) for k, p in enumerate(pts)}


def cloud(spark, n=20_000, seed=2):
    r = random.Random(seed)
    rows = [(k, r.random() * 100, r.random() * 100, r.random() * 100) for k in range(n)]
    rows += [(n + k, 50.0, 50.0, 50.0) for k in range(n // 3)]  # one place holds much of the cloud
    return spark.createDataFrame([*rows, (2 * n, None, 1.0, 1.0)], POINT)


def scan_metrics(df):
    """numFiles and rows that the scan of the points gave in the last run of df."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []
    todo = [plan]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        if name == "FileSourceScanExec" and p.relation().location().rootPaths().apply(0).toString().endswith("/points"):
            out.append((p.metrics().get("numFiles").get().value(), p.metrics().get("numOutputRows").get().value()))
        children = p.children()
        todo += [children.apply(k) for k in range(children.size())]
    assert len(out) == 1
    return out[0]


NARROW = octree.frustum((-10.0, 5.0, 5.0), (20.0, 8.0, 8.0), fov=8.0, near=0.1, far=60.0)
WIDE = octree.frustum((-300.0, 50.0, 50.0), (50.0, 50.0, 50.0), fov=60.0, near=0.1, far=1000.0)


def test_same_rows_and_less_read(spark, tmp_path):
    points = cloud(spark)
    index = store.rebuild(points, str(tmp_path / "a"), most=200, depth=9, zone_rows=2000, row_group=16 << 10)
    assert (index.generation, index.sampled, index.total_points) == (1, False, points.count())
    read = {}
    for name, planes in (("narrow", NARROW), ("wide", WIDE), ("none", [])):
        got = store.frustum(spark, index, planes)
        want = octree.frustum_query(points, planes, 200, 9)
        assert set(got.columns) == {*points.columns, "leaf"}
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
        if planes:
            read[name] = scan_metrics(got)
    whole = store.points(spark, index)
    assert whole.count() == points.filter("x is not null").count() == store.nodes(spark, index).filter("leaf").groupBy().sum("n").first()[0]
    assert read["narrow"][0] * 3 < read["wide"][0] and read["narrow"][1] * 3 < read["wide"][1]
    assert {tuple(r) for r in store.nodes(spark, index).select("node", "n", "leaf").collect()} == {tuple(r) for r in octree.nodes(octree.paths(points, agg.box_of(points), 9), 200, 9).select("node", "n", "leaf").collect()}


def test_more_intervals_than_a_scan_takes():
    assert store._merged([(0, 1), (2, 3), (10, 11), (20, 20), (5, 5)], 2) == [(0, 11), (20, 20)]
    assert store._merged([(3, 9), (0, 4)], 5) == [(0, 9)] and store._merged([]) == []


def test_only_a_current_build_is_published(spark, tmp_path):
    root, points = str(tmp_path / "b"), cloud(spark, 600)
    assert store.current(spark, root) is None and store.generation(spark, root) == 0
    slow = store.build(points, root, 50, 4)  # begins on generation 0 ...
    sampled = store.rebuild(points, root, 50, 4, sample=100)
    assert store.publish(spark, root, slow, 0) is None  # ... and ends after another one was published
    assert store.current(spark, root) == sampled and not (tmp_path / "b" / slow.folder.rsplit("/", 1)[1]).exists()
    assert (sampled.generation, sampled.sampled, sampled.sample_size, sampled.total_points) == (1, True, 89, 801)  # every ninth row
    assert store.points(spark, sampled).count() in (88, 89)  # the sample may hold the row that is no point
    full = store.rebuild(points, root, 50, 4)
    assert store.current(spark, root) == full and (full.generation, full.sampled, full.sample_size) == (2, False, 801)
    assert store.frustum(spark, full, WIDE).count() > store.frustum(spark, sampled, WIDE).count() > 0
    (tmp_path / "b" / "manifests" / f"{3:012d}.json").write_text("{")  # a publisher that died
    assert store.current(spark, root) == full
    after = store.rebuild(points, root, 50, 4)
    assert after.generation == 4 and store.current(spark, root) == after


def test_empty_cloud_and_own_columns(spark, tmp_path):
    index = store.rebuild(spark.createDataFrame([], POINT), str(tmp_path / "c"), 10)
    assert index.box is None and store.frustum(spark, index, WIDE).count() == 0
    with pytest.raises(ValueError):
        store.build(spark.createDataFrame([(1, 1.0, 1.0, 1.0, "a")], POINT + ", leaf string"), str(tmp_path / "c"), 10)
    with pytest.raises(ValueError):
        store.build(spark.createDataFrame([], POINT), str(tmp_path / "c"), 10, depth=21)


def test_first_picture(spark, tmp_path):
    index = store.rebuild(cloud(spark, 2000), str(tmp_path / "d"), 100, 5)
    got = store.coarse(spark, index, WIDE, 3)
    assert got.groupBy("leaf").count().agg({"count": "max"}).first()[0] == 3
