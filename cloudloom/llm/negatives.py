"""Hard negatives by a norm-bucketed search for the largest inner products.

Vectors become integers, so that scores are exact. Candidates are sorted by norm and bucketed, largest norms first. A score is never larger
than the product of the norms (Cauchy-Schwarz), so an anchor searches a bucket only if its own norm times the
largest norm there reaches what it still needs: the kth score it has found so far, and for negatives at least the lower limit of a
window. Buckets are searched in rounds, few first, then more; the best rows of a round are written, so that the next one knows every
anchor's kth score, whichever task found it. Inside a task the candidates come in order of norm too, and chunks are passed over by
the same bound as the kth scores rise.

Anchors in blocks meet buckets in tiles, each pair in a task of its own (positives: within a label only), so no task
holds more than one block and one tile, however frequent a label or a norm is; only the best rows of a block leave it. The driver holds the
bounds of the buckets, whose number is a parameter.

Defined cases: rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part; vectors of
unlike length have no score; every row is a row of its own, so rows that repeat an id are other rows than the anchor, and each of them an
anchor if its id is one; scores beyond 64 bits are held at the ends of that range; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, parallelism

#: Rows of a tile of candidates and of a block of anchors, rows that are compared at a time, and buckets by norm; only memory and time depend on them.
TILE, BLOCK, CHUNK, BUCKETS = 2048, 1024, 256, 32
#: Products below this are sums of doubles without rounding.
_EXACT = float(1 << 52)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_OPEN = float("-inf")


def integer_vectors(df: DataFrame, key: Column, label: Column, vec: Column, scale: int = 256) -> DataFrame:
    """uid, id, label, dim, norm, vec (floor(scale * x) as doubles) of the rows that take part."""
    rows = df.select(key.alias("id"), label.cast("string").alias("label"), vec.cast("array<double>").alias("v")).filter("id is not null and label is not null and v is not null and size(v) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(2)
            flat = col.flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(col.value_lengths().to_numpy())
            keep, dims, norms, raw = [], [], [], []
            bad = ~np.isfinite(x)
            x = np.floor(scale * x)
            lo = 0
            for i, hi in enumerate(ends.tolist()):
                if not bad[lo:hi].any():
                    keep.append(i)
                    dims.append(hi - lo)
                    norms.append(float(np.linalg.norm(x[lo:hi])))
                    raw.append(x[lo:hi].tobytes())
                lo = hi
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(dims, pa.int32()), pa.array(norms, pa.float64()), pa.array(raw, pa.binary())], ["id", "label", "dim", "norm", "vec"])

    made = rows.mapInArrow(run, T.StructType([T.StructField("id", rows.schema["id"].dataType), *T._parse_datatype_string("label string, dim int, norm double, vec binary").fields]))
    return made.withColumn("uid", F.monotonically_increasing_id())


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a and of b, exact; held at the ends of 64 bits."""
    peak = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if peak < _EXACT:
        return (a @ b.T).astype(np.int64)
    one, two = ([[int(c) for c in row] for row in x] for x in (a, b))
    return np.array([[min(max(sum(p * q for p, q in zip(r, s, strict=True)), _LEAST), _MOST) for s in two] for r in one], np.int64).reshape(len(a), len(b))


def _reach(norms: np.ndarray, most: float) -> np.ndarray:
    """What scores with a norm of at most `most` cannot exceed."""
    return norms * most * (1 + 1e-9) + 1e-9


def _tops(anchors: pd.DataFrame, tile: pd.DataFrame, k: int, negative: bool) -> pd.DataFrame:
    """The first k rows of a tile for each anchor and window. Windows are pairs of limits; a positive search has one, without limits."""
    tile = tile.sort_values(["norm", "id"], ascending=[False, True])
    ids, uids, labels = tile["id"].to_numpy(), tile["uid"].to_numpy(), tile["label"].to_numpy()
    dim = int(tile["dim"].iloc[0])
    x = np.frombuffer(b"".join(tile["vec"]), np.float64).reshape(-1, dim)
    norm = tile["norm"].to_numpy()
    y = np.frombuffer(b"".join(anchors["vec"]), np.float64).reshape(-1, dim)
    own, mine, size = anchors["uid"].to_numpy(), anchors["label"].to_numpy(), anchors["norm"].to_numpy()
    # one row for each window: its anchor, limits, and the kth score so far
    low, high, kth = (anchors[c].tolist() for c in ("low", "high", "kth"))
    owner = np.repeat(np.arange(len(anchors)), [len(v) for v in kth])
    flat = lambda v, kind: np.array([c for r in v for c in r], kind)
    low, high, kth = flat(low, np.int64), flat(high, np.int64), flat(kth, np.float64)
    window = np.concatenate([np.arange(len(v)) for v in anchors["kth"]])
    need = np.maximum(np.where(low > _LEAST, low.astype(np.float64), _OPEN), kth)
    best: list[list[tuple[int, object, int]]] = [[] for _ in owner]
    for at in range(0, len(tile), CHUNK):
        open_ = np.flatnonzero(_reach(size[owner], norm[at]) >= need)
        if not len(open_):
            break  # norms only fall from here
        who = np.unique(owner[open_])
        part = slice(at, at + CHUNK)
        s = _scores(y[who], x[part])
        other = (labels[part][None, :] != mine[who][:, None]) if negative else (labels[part][None, :] == mine[who][:, None]) & (uids[part][None, :] != own[who][:, None])
        row = np.searchsorted(who, owner[open_])
        for w, r in zip(open_.tolist(), row.tolist(), strict=True):
            fit = np.flatnonzero(other[r] & (s[r] >= low[w]) & (s[r] <= high[w]) & (s[r] >= need[w] - abs(need[w]) * 1e-9))
            if len(fit):
                got = best[w] + [(-int(s[r, j]), ids[at + j], int(uids[at + j])) for j in fit.tolist()]
                best[w] = sorted(got)[:k]
                if len(best[w]) == k:
                    need[w] = max(need[w], float(-best[w][-1][0]))
    rows = [(own[owner[w]], int(window[w]), n, u, -s) for w, b in enumerate(best) for s, n, u in b]
    return pd.DataFrame(rows, columns=["anchor", "window", "id", "uid", "score"])


def _tops_schema(vectors: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("anchor", T.LongType()), T.StructField("window", T.LongType()), vectors.schema["id"], *T._parse_datatype_string("uid long, score long").fields])


def search(anchors: DataFrame, vectors: DataFrame, k: int, negative: bool) -> DataFrame:
    """anchor (its uid), window, id, uid, score: the first k candidates (score, then id) of each anchor's windows.

    anchors: rows of vectors with arrays low and high, the limits of their windows. negative: candidates of other labels, else other
    rows of the same label.
    """
    spark = vectors.sparkSession
    same = ["dim"] if negative else ["dim", "label"]
    probs = [1 - b / BUCKETS for b in range(1, BUCKETS)]
    edges = vectors.agg(F.percentile_approx("norm", F.array(*map(F.lit, probs)), 10_000).alias("e")).first()["e"] or []
    edges = sorted({float(e) for e in edges}, reverse=True)
    bucket = F.lit(0)
    for e in edges:  # at most BUCKETS
        bucket = bucket + (F.col("norm") < e).cast("int")
    placed = vectors.withColumn("bucket", bucket)
    tops = {r["bucket"]: r["m"] for r in placed.groupBy("bucket").agg(F.max("norm").alias("m")).collect()}  # BUCKETS rows at most
    tiles = placed.groupBy(*same, "bucket").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    candidates = placed.join(tiles, [*same, "bucket"]).withColumn("tile", F.pmod(F.xxhash64("uid"), F.col("tiles")).cast("int")).drop("tiles")
    blocks = anchors.groupBy(*same).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    anchors = materialize(anchors.join(blocks, same).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")).drop("blocks"), "anchors")
    unit = [*same, "block", "bucket", "tile"]
    found, at, width = None, 0, 1
    while at < len(edges) + 1:
        step = [b for b in range(at, at + width) if b in tops]
        at, width = at + width, width * 4
        if not step:
            continue
        if found is None:
            now = anchors.withColumn("kth", F.transform("low", lambda _: F.lit(_OPEN)))
        else:
            full = found.groupBy("anchor", "window").agg(F.count("*").alias("n"), F.min("score").alias("last")).filter(F.col("n") >= k)
            reached = full.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", F.col("last").cast("double")))).alias("m"))
            kth = F.transform("low", lambda _, i: F.coalesce(F.element_at("m", i.cast("long")), F.lit(_OPEN)))
            now = anchors.join(reached, anchors["uid"] == reached["anchor"], "left").withColumn("kth", kth).drop("m", "anchor")
        # what the window that needs least still needs
        need = F.array_min(F.transform(F.arrays_zip("low", "kth"), lambda w: F.greatest(F.when(w["low"] > _LEAST, w["low"].cast("double")).otherwise(F.lit(_OPEN)), w["kth"])))
        bounds = F.array(*(F.struct(F.lit(b).alias("bucket"), F.lit(float(tops[b])).alias("most")) for b in step))
        live = F.filter(bounds, lambda b: F.col("norm") * b["most"] * (1 + 1e-9) + 1e-9 >= need)
        met = now.withColumn("b", F.explode(live)).withColumn("bucket", F.col("b.bucket")).drop("b")
        met = met.join(tiles, [*same, "bucket"]).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
        met = met.repartition(parallelism(spark), *unit)
        wanted = met.select(*(F.col(c).alias(c) for c in unit)).distinct()  # aliased: else both sides name the same columns
        sent = candidates.filter(F.col("bucket").isin(step)).join(wanted, [c for c in unit if c != "block"]).select(*unit, *(c for c in ("uid", "id", "label", "dim", "norm", "vec") if c not in same))

        def compare(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
            if not len(one) or not len(two):
                return pd.DataFrame(columns=["anchor", "window", "id", "uid", "score"])
            return _tops(one, two, k, negative)

        got = met.groupBy(*unit).cogroup(sent.groupBy(*unit)).applyInPandas(compare, _tops_schema(vectors))
        if found is not None:
            got = found.unionByName(got)
        order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "uid")
        best = got.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        found = materialize(best.select("anchor", "window", "id", "uid", "score"), "best")
    return found if found is not None else spark.createDataFrame([], _tops_schema(vectors))


def mine(df: DataFrame, queries: Column, key: str = "vec_id", vec: str = "embedding", label: Column | str = "label", positives: int = 5, negatives: int = 5, low: tuple[int, int] = (80, 100), scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows that meet `queries` (a condition on df's columns). Each has its first `positives` other rows of its label; each of
    these has the first `negatives` rows of other labels that score at least low[0] / low[1] of it and not more than it.
    """
    name = lambda c: F.col(f"`{c}`") if isinstance(c, str) else c
    asked = df.withColumn("__asked", F.coalesce(queries, F.lit(False)))
    whole = integer_vectors(asked, F.struct(name(key).alias("id"), F.col("__asked").alias("asked")), name(label), name(vec), scale)
    whole = materialize(whole.filter("id.id is not null").select("uid", F.col("id.asked").alias("asked"), F.col("id.id").alias("id"), "label", "dim", "norm", "vec"), "vectors")
    vectors = whole.drop("asked")
    anchors = whole.filter("asked").drop("asked")
    free = [F.array(F.lit(v).cast("long")).alias(n) for v, n in ((_LEAST, "low"), (_MOST, "high"))]
    near = search(anchors.select("*", *free), vectors, positives, False)
    # windows of negative positives are empty: four fifths of them lie above them
    some = near.filter("score >= 0").select("anchor", F.col("id").alias("positive_id"), "uid", F.col("score").alias("positive_score"))
    order = Window.partitionBy("anchor").orderBy("uid")
    windows = materialize(some.withColumn("window", (F.row_number().over(order) - 1).cast("long")).drop("uid"), "windows")
    # the least integer s with low[1] * s >= low[0] * score
    least = F.expr(f"cast((cast(positive_score as decimal(38,0)) * {low[0]} + {low[1] - 1}) div {low[1]} as long)")
    limits = windows.withColumn("least", least).groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("window", "least", "positive_score"))).alias("w"))
    bound = anchors.join(limits, anchors["uid"] == limits["anchor"]).select(*(anchors[c] for c in anchors.columns), F.col("w.least").alias("low"), F.col("w.positive_score").alias("high"))
    hard = search(bound, vectors, negatives, True)
    rank = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "uid"))
    ranked = hard.select("anchor", "window", rank.alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = anchors.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"))
    return ranked.join(windows, ["anchor", "window"]).join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
