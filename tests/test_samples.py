"""Poisson and curvature samples against the sequential loop, and what they move."""

import math
import random

import numpy as np
import pytest

from cloudloom.operators import poisson, spatial

POINT = "idx long, x double, y double, z double"


def cloud(spark, rows):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rows)], POINT)


def moved(spark, run):
    """Rows that run's shuffles write."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    before = max(stages(), default=(-1, 0))
    run()
    return sum(n for k, n in stages().items() if k > before)


def one_by_one(pts, order, radius, target):
    taken, out = [], set()
    for i in order:
        if i not in out:
            taken.append(i)
            r = radius(i)
            out |= {j for j in range(len(pts)) if sum((a - b) * (a - b) for a, b in zip(pts[j], pts[i], strict=True)) <= r * r}
        if len(taken) == target:
            break
    return taken


def poisson_one_by_one(pts, target, least):
    a = np.array(pts)
    c = [(lo + hi) * 0.5 for lo, hi in zip(a.min(0).tolist(), a.max(0).tolist(), strict=True)]
    far = [math.sqrt((p[0] - c[0]) * (p[0] - c[0]) + (p[1] - c[1]) * (p[1] - c[1]) + (p[2] - c[2]) * (p[2] - c[2])) for p in pts]
    return one_by_one(pts, sorted(range(len(pts)), key=lambda i: (-far[i], i)), lambda i: poisson.adaptive_radius(far[i], max(far), target, least), target)


def bent_one_by_one(pts, radius, exclude, target):
    a, bend = np.array(pts), []
    for p in a:
        near = a[((a - p) ** 2).sum(1) <= radius * radius]
        e = np.linalg.eigvalsh(np.cov(near.T, bias=True)) if len(near) >= 3 else np.zeros(3)
        flat = 0.0 if len(np.unique(near, axis=0)) <= 3 else e[0]
        bend.append(round(1 - min(max(flat / e.sum(), 0), 1), 9) if e.sum() > 0 else 0.0)  # copies differ in the last bits here
    return one_by_one(pts, [i for i in sorted(range(len(pts)), key=lambda i: (-bend[i], i)) if bend[i] > 0], lambda i: exclude, target)


@pytest.fixture
def small_steps(monkeypatch):
    """Several blocks, and tiles that settle their rows in rounds."""
    for k, v in {"FIRST": 32, "MOST": 256, "TILE": 2, "WHOLE": 15}.items():
        monkeypatch.setattr(poisson, k, v)


@pytest.fixture
def no_broadcast(spark):
    """Joins as of tables too large to send to every task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def some(n, copies):
    rnd = random.Random(3)
    pts = [(rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.gauss(0, 0.3)) for _ in range(n)]
    return pts + pts[:copies]


def test_poisson_over_blocks_and_tiles(spark, small_steps):
    pts = some(300, 60)
    got = [r["idx"] for r in poisson.poisson(cloud(spark, pts), 120, 0.5).orderBy("rank").collect()]
    assert got == poisson_one_by_one(pts, 120, 0.5)
    assert 20 < len(got) < 120  # runs to the last block


def test_poisson_stops_at_the_target(spark, small_steps):
    pts = some(300, 0)
    assert [r["idx"] for r in poisson.poisson(cloud(spark, pts), 20, 0.05).orderBy("rank").collect()] == poisson_one_by_one(pts, 20, 0.05)


def test_poisson_of_a_chain_takes_few_rounds(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(poisson, "written", lambda df, keep=poisson.written: calls.append(1) or keep(df))
    pts = [(i * 0.6, 0, 0) for i in range(200)]
    got = [r["idx"] for r in poisson.poisson(cloud(spark, pts), 1_000_000, 1.0).orderBy("rank").collect()]
    assert got == poisson_one_by_one(pts, 1_000_000, 1.0) and len(calls) <= 5


def test_poisson_of_no_points(spark):
    assert poisson.poisson(cloud(spark, []), 10, 0.1).collect() == []


def test_poisson_moves_no_pairs(spark):
    rnd = random.Random(4)
    pts = [(rnd.random() * 0.01, rnd.random() * 0.01, 0) for _ in range(1000)]
    assert moved(spark, lambda: poisson.poisson(cloud(spark, pts), 10, 0.05).collect()) < 50 * len(pts)  # there are 999 000 pairs


def test_curvature_sample_is_the_sequential_sample(spark):
    pts = some(150, 40)
    got = [r["idx"] for r in poisson.curvature_sample(cloud(spark, pts), 0.7, 0.5, 1000).orderBy("rank").collect()]
    assert got == bent_one_by_one(pts, 0.7, 0.5, 1000)
    assert 20 < len(got) < 150


def test_curvature_sample_without_exclusion_takes_one_of_copies(spark):
    pts = some(60, 20)
    got = [r["idx"] for r in poisson.curvature_sample(cloud(spark, pts), 1.0, 0.0, 1000).orderBy("rank").collect()]
    assert got == bent_one_by_one(pts, 1.0, 0.0, 1000)


def test_covariance_moves_no_pairs(spark, no_broadcast):
    rnd = random.Random(6)
    pts = [(rnd.random() * 0.01, rnd.random() * 0.01, rnd.random() * 0.01) for _ in range(1000)]
    df = cloud(spark, pts)
    assert moved(spark, lambda: spatial.covariance(df, 0.1).collect()) < 100 * len(pts)  # there are 1 000 000 pairs
    row = spatial.covariance(df, 0.1).filter("idx = 0").first()
    want = np.cov(np.array(pts).T, bias=True)
    assert row["n"] == 1000 and [row["mx"], row["cxx"], row["cxy"], row["czz"]] == pytest.approx([np.mean([p[0] for p in pts]), want[0, 0], want[0, 1], want[2, 2]], rel=1e-9, abs=1e-18)
