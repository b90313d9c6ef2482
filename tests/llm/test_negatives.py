"""Hard negatives against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.llm import negatives

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())])


def plain(rows, every=10):
    ok = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if i is not None and v and c is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, c) in enumerate(ok):
        if i % every:
            continue
        score = [(-max(min(sum(p * q for p, q in zip(v, w, strict=True)), 2**63 - 1), -(2**63)), j, d, b) for b, (j, w, d) in enumerate(ok) if b != a and len(w) == len(v)]
        for s, j, _, b in sorted((x for x in score if x[2] == c), key=lambda x: (x[0], x[1]))[:5]:
            hard = sorted((x[:2] for x in score if x[2] != c and 80 * -s <= 100 * -x[0] <= 100 * -s))[:5]
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n) in enumerate(hard)]
    return sorted(out)


def mined(df, every=10):
    got = negatives.mine(df, F.col("vec_id") % every == 0).collect()
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got)


def cloud(seed, n, dim, spread):
    r = np.random.default_rng(seed)
    x = (r.standard_normal((n, dim)) + 0.7) * np.exp(spread * r.standard_normal((n, 1)))
    label = np.where(r.random(n) < 0.4, 0, r.integers(0, 4, n))  # one label holds much of the rows
    return [(int(k), [float(c) for c in x[k]], int(label[k])) for k in range(n)]


@pytest.mark.parametrize("spread", [0.0, 0.8])
def test_same_as_all_pairs(spark, monkeypatch, spread):
    """Small tiles, blocks, chunks and buckets, so that rounds, skew and pruning all take part."""
    for name, v in (("TILE", 40), ("BLOCK", 9), ("CHUNK", 9), ("BUCKETS", 5)):
        monkeypatch.setattr(negatives, name, v)
    rows = cloud(1, 240, 6, spread)
    rows += [(k + 240, rows[k][1], rows[k + 1][2]) for k in range(40)]  # ties
    assert mined(spark.createDataFrame(rows, ROWS)) == plain(rows)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 0), (1, [1.0, 2.1], 0), (2, [1.0, 2.0], 1), (3, [-1.0, 0.0], 1), (4, [0.0, 0.0], 0), (5, None, 0), (6, [nan, 1.0], 0), (7, [1.0, None], 1), (8, [1.0, inf], 1), (9, [1.0, 1.9], None),
            (None, [1.0, 2.0], 1), (11, [1.0, 2.0, 3.0], 1), (12, [], 1), (10, [-2.0, -2.0], 1), (20, [0.0, 0.0], 2), (21, [0.0, 0.0], 2), (30, [1e30, 1e30], 3), (31, [1e30, 2e30], 3), (32, [1e30, 1e29], 4), (40, [1e9, 7.0], 5), (41, [3e9, 1.0], 5), (42, [2.7e9, 5.0], 6)]
    assert mined(spark.createDataFrame(rows, ROWS)) == plain(rows)
    assert negatives.mine(spark.createDataFrame([], ROWS), F.lit(True)).count() == 0
    assert negatives.mine(spark.createDataFrame(rows, ROWS), F.lit(False)).count() == 0
    clash = spark.createDataFrame([(*r, 1, "x") for r in cloud(2, 60, 3, 0.1)], T.StructType([*ROWS, T.StructField("uid", T.IntegerType()), T.StructField("norm", T.StringType())]))
    assert mined(clash) == plain(cloud(2, 60, 3, 0.1))


def test_rows_that_repeat_an_id(spark):
    rows = cloud(3, 80, 3, 0.3)
    rows += [(0, [0.5, 0.5, 0.4], 1), (0, [0.5, 0.5, 0.4], 1), (17, rows[17][1], rows[17][2])]
    assert mined(spark.createDataFrame(rows, ROWS)) == plain(rows)


def test_bound_passes_over_buckets(monkeypatch):
    """Candidates whose norm cannot reach the kth score are never multiplied."""
    import pandas as pd

    seen = []
    real = negatives._scores
    monkeypatch.setattr(negatives, "_scores", lambda a, b: seen.append(len(b)) or real(a, b))
    monkeypatch.setattr(negatives, "CHUNK", 10)
    tile = pd.DataFrame({"uid": range(100), "id": range(100), "label": "a", "dim": 1, "norm": [1000.0 - 9 * k for k in range(100)], "vec": [np.array([1000.0 - 9 * k]).tobytes() for k in range(100)]})
    anchor = pd.DataFrame({"uid": [500], "id": [500], "label": ["a"], "norm": [2.0], "vec": [np.array([2.0]).tobytes()], "low": [[negatives._LEAST]], "high": [[negatives._MOST]], "kth": [[float("-inf")]]})
    top = negatives._tops(anchor, tile, 5, False)
    assert top["id"].tolist() == [0, 1, 2, 3, 4] and seen == [10]
