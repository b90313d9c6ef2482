"""Embedding near-duplicates by random projection passes.

Each pass signs a vector by random hyperplanes and compares all vectors of a label that agree in all
signs, tile against tile; pairs whose cosine (double precision) reaches the threshold are links, and
links of all passes are united into components. Two vectors at the threshold agree in one sign with a
fixed probability whatever the others are, so the number of passes follows from the number of signs: a
pair at the threshold is missed with probability `miss` at most, in dense labels too. Dense labels make
larger buckets; the number of signs is chosen by measured bucket sizes. All links of a vector lie in its
component, and there they are counted exactly, tile against tile.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows whose
label is null, link with nothing; vectors of unlike length never link; rows
that repeat an id never link with each other; an empty table has no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, parallelism
from .graph import components

KEY_BITS = 56
TILE = 512
#: Signs of a pass to choose from (never none: small tables go through projection passes like large ones), and what a row of a pass costs in comparisons; only speed depends on them.
BITS, ROW_COST = tuple(range(4, 41, 4)), 2000


def unit_vectors(df: DataFrame, key: str, vec: str, label: str) -> DataFrame:
    """(id, label, dim, unit): the rows that can link, their vectors as doubles of length one."""
    df = df.filter(F.col(label).isNotNull() & F.col(vec).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(label).cast("string").alias("label"), F.col(vec).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, dims, raw = [], [], []
            for i, v in enumerate(batch.column(2).to_pylist()):
                x = np.array([np.nan if c is None else c for c in v], np.float64)
                peak = np.abs(x).max() if len(x) else 0.0
                if np.isfinite(peak) and peak > 0:
                    x = x / peak  # else the square of a huge or tiny component is lost
                    keep.append(i)
                    dims.append(len(x))
                    raw.append((x / np.sqrt(x @ x)).tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], ["id", "label", "dim", "unit"])

    return df.mapInArrow(run, T.StructType([df.schema["id"], T.StructField("label", T.StringType()), T.StructField("dim", T.IntegerType()), T.StructField("unit", T.BinaryType())]))


def n_passes(bits: int, threshold: float, miss: float) -> int:
    """Passes after which a pair at the threshold has agreed in all `bits` signs of one with probability 1 - miss."""
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return max(3, math.ceil(math.log(miss) / math.log(1 - min(agree, 0.95))))


def n_bits(vectors: DataFrame, threshold: float, miss: float) -> int:
    """The signs of a pass for which passes and comparisons cost least, by the bucket sizes of two passes; any number is right."""
    keyed = _keyed(vectors, 2).select("step", "label", "dim", "order", F.explode(F.array(*map(F.lit, BITS))).alias("bits"))
    sizes = keyed.groupBy("bits", "step", "label", "dim", F.expr(f"shiftright(order, {KEY_BITS} - bits)").alias("bucket")).agg(F.count("*").cast("double").alias("n"))
    rows = sizes.groupBy("bits").agg((F.sum("n") / 2).alias("rows"), (F.sum(F.col("n") * F.col("n")) / 4).alias("pairs")).collect()
    cost = {r["bits"]: n_passes(r["bits"], threshold, miss) * (ROW_COST * r["rows"] + r["pairs"]) for r in rows}
    return min(cost, key=lambda b: (cost[b], b), default=BITS[0])


def _planes(step: int, dim: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([step, dim])).standard_normal((dim, KEY_BITS))


def _keyed(vectors: DataFrame, passes: int) -> DataFrame:
    fields = [T.StructField("step", T.IntegerType()), T.StructField("order", T.LongType()), *vectors.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (1 << np.arange(KEY_BITS, dtype=np.int64))[::-1]
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                dims = batch.column(2).to_numpy()
                raw = batch.column(3)
                for step in range(passes):
                    order = np.zeros(batch.num_rows, np.int64)
                    for dim in np.unique(dims):
                        own = np.flatnonzero(dims == dim)
                        x = np.frombuffer(b"".join(raw.take(pa.array(own)).to_pylist()), np.float64).reshape(-1, dim)
                        order[own] = (x @ _planes(step, int(dim)) > 0) @ weights
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, step, np.int32)), pa.array(order), *batch.columns], [f.name for f in fields])

    return vectors.mapInArrow(run, T.StructType(fields))


def _forest(near: np.ndarray, n: int, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A least set of links that joins what the links near[i, j] between rows one[i] and two[j] of n rows join."""
    i, j = np.nonzero(near)
    i, j = one[i], two[j]
    root = np.arange(n)
    while len(i):  # each row takes the least root next to it until all links are within one
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, root[root]):
            root = root[root]
    own = np.flatnonzero(root != np.arange(n))
    return own, root[own]


def candidate_links(vectors: DataFrame, threshold: float = 0.98, miss: float = 1e-4) -> DataFrame:
    """Pairs (a, b) that join the same vectors as all verified pairs that the passes find."""
    spark = vectors.sparkSession
    idt = vectors.schema["id"].dataType
    bits = n_bits(vectors, threshold, miss)
    bucket = ["step", "label", "dim", "bucket"]
    keyed = _keyed(vectors, n_passes(bits, threshold, miss)).withColumn("bucket", F.shiftright("order", KEY_BITS - bits)).drop("order")
    keyed = keyed.repartition(parallelism(spark), *bucket)
    sizes = keyed.groupBy(*bucket).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # a bucket of several tiles is compared tile against tile, in tasks of their own
    split = keyed.join(sizes, bucket).withColumn("tile", F.pmod(F.xxhash64("id", "unit"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    place = [*bucket, "i", "j"]
    split = split.select(*bucket, F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "id", "unit")
    ordered = split.repartition(parallelism(spark), *place).sortWithinPartitions(*place)

    def compare(rows: pd.DataFrame) -> tuple[list, list]:
        x = np.frombuffer(b"".join(rows["unit"]), np.float64).reshape(len(rows), -1)
        tile, ids = rows["tile"].to_numpy(), rows["id"].to_numpy()
        one, two = np.flatnonzero(tile == rows["i"].iloc[0]), np.flatnonzero(tile == rows["j"].iloc[0])
        own, root = _forest(x[one] @ x[two].T >= threshold, len(rows), one, two)
        return ids[own].tolist(), ids[root].tolist()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for rows in chain(batches, [None]):
            if rows is not None:
                held = rows if held is None else pd.concat([held, rows], ignore_index=True)
            if held is None or not len(held):
                continue
            new = np.flatnonzero((held[place] != held[place].shift()).any(axis=1).to_numpy())
            ends = [*new[1:].tolist(), *([len(held)] if rows is None else [])]
            a, b = [], []
            for lo, hi in zip(new.tolist(), ends, strict=False):  # the last group may go on in the next batch
                if hi - lo > 1:
                    own, root = compare(held.iloc[lo:hi])
                    a += own
                    b += root
            held = held.iloc[new[-1] :] if rows is not None else None
            if a:
                yield pd.DataFrame({"a": a, "b": b})

    return ordered.mapInPandas(run, T.StructType([T.StructField("a", idt), T.StructField("b", idt)])).filter("a != b").distinct()


def link_counts(vectors: DataFrame, found: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(id, n): the exact number of links of each vector inside its component (columns node, component)."""
    member = materialize(vectors.join(found, vectors.id == found.node).drop("node"), "members")
    tiles = member.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    split = member.join(tiles, "component").withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = split.select("component", "label", "dim", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "id", "unit")

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        low, high = rows["i"].iloc[0], rows["j"].iloc[0]
        x = np.frombuffer(b"".join(rows["unit"]), np.float64).reshape(len(rows), -1)
        ids, tile_of = rows["id"].to_numpy(), rows["tile"].to_numpy()
        n = np.zeros(len(rows), np.int64)
        one, two = np.flatnonzero(tile_of == low), np.flatnonzero(tile_of == high)
        for at in range(0, len(one), TILE):
            own = one[at : at + TILE]
            near = (x[own] @ x[two].T >= threshold) & (ids[own][:, None] != ids[two][None, :])
            n[own] += near.sum(axis=1)
            if low != high:
                n[two] += near.sum(axis=0)
        return pd.DataFrame({"id": ids, "n": n})

    got = pairs.groupBy("component", "label", "dim", "i", "j").applyInPandas(count, T.StructType([vectors.schema["id"], T.StructField("n", T.LongType())]))
    return got.groupBy("id").agg(F.sum("n").alias("n"))


def near_duplicates(df: DataFrame, key: str = "vec_id", vec: str = "embedding", label: str = "label", threshold: float = 0.98, miss: float = 1e-4) -> DataFrame:
    """key, n_links, component_id and kept (the least id of its component) of every row."""
    vectors = materialize(unit_vectors(df, key, vec, label), "vectors")
    found = materialize(components(candidate_links(vectors, threshold, miss)), "components")
    counts = link_counts(vectors, found, threshold)
    named = found.join(counts, found.node == counts.id, "left").select("node", "component", "n")
    return df.select(key).join(named, F.col(key) == F.col("node"), "left").select(
        key, F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", key).cast("long").alias("component_id"), F.coalesce(F.col(key) == F.coalesce("component", key), F.lit(False)).alias("kept")
    )
