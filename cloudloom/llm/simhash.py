"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint bit is set if it is set in over half the hashes of the text's word shingles. Fingerprints
within `distance` bits link. Correlated bits are grouped into m partitions; partition i gets an own
threshold t_i >= -1 (-1: it is not probed) with sum(t_i) = distance - m + 1, so that every pair within
`distance` agrees within t_i bits in some partition: no pair is lost. m and the thresholds come from
dynamic programming over candidate counts that a bounded sample of fingerprints predicts; a poor
estimate costs time, never a pair. Equal fingerprints are one row before anything is probed.

Defined cases: null text is empty; a text of fewer words than a shingle is one shingle; without words
the fingerprint is zero and links like any other; repeated rows share a component; null ids are
fingerprinted but have no component of their own (component_id is the least id that is not null).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, text_steps
from .graph import components
from .setjoin import BROADCAST_ROWS, near_sets

BITS = 64
#: Fingerprints from which the partitions are planned; only speed depends on it.
SAMPLE = 2000


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """One text's fingerprint, as an unsigned 64-bit integer."""
    toks = text.encode().lower().split()
    if not toks:
        return 0
    joined = b" ".join(toks)
    ends = np.cumsum([len(t) + 1 for t in toks])
    n = max(1, len(toks) - words + 1)
    lo = [0, *ends[: n - 1].tolist()]
    hi = (ends[min(words, len(toks)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(lo, hi, strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        bits = np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """key and fp (the 64 bits as a signed long) of every row."""
    df = df.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, col in text_steps(batches, text):
            fps = np.array([fingerprint(t, words, seed) for t in col.to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fps)], [key, "fp"])

    return df.mapInArrow(run, T.StructType([df.schema[key], T.StructField("fp", T.LongType())]))


def _group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of about equal width; each is seeded with a free bit and takes the free bits that correlate with it most."""
    with np.errstate(all="ignore"):
        corr = np.nan_to_num(np.abs(np.corrcoef(bits.T))) if len(bits) > 1 else np.zeros((BITS, BITS))
    free, parts = set(range(BITS)), []
    for i in range(m):
        width = len(free) // (m - i)
        seed = max(free, key=lambda b: (corr[b, sorted(free)].sum(), -b))
        part = [seed]
        free.discard(seed)
        while len(part) < width:
            nxt = max(free, key=lambda b: (corr[b, part].sum(), -b))
            part.append(nxt)
            free.discard(nxt)
        parts.append(sorted(part))
    return parts


def plan(fps: np.ndarray, total: int, distance: int, most_parts: int = 6) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition: the cheapest split by estimated probes and candidates for `total` fingerprints."""
    bits = ((fps[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(1, min(most_parts, distance + 1) + 1):
        parts = _group_bits(bits, m)
        cost = []  # cost[i][t]: probes and candidates of partition i at threshold t
        for part in parts:
            own = bits[:, part]
            away = own @ (1 - own).T
            away = away + away.T
            pairs = max(1, len(own) * (len(own) - 1))
            row = {-1: 0.0}
            probes = 1.0
            choose = 1.0
            for t in range(distance + 1):
                if t:
                    choose *= (len(part) - t + 1) / t
                    probes += choose
                # a sample shows no rarer event than one pair of its own: below that, take the rate of independent bits
                near = max((int((away <= t).sum()) - len(own)) / pairs, probes / 2.0 ** len(part))
                row[t] = total * probes + total * total * near
            cost.append(row)
        need = distance - m + 1
        # dynamic programming over partitions: least cost by the sum of thresholds so far
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in cost:
            step: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in state.items():
                for t, x in row.items():
                    if s + t not in step or c + x < step[s + t][0]:
                        step[s + t] = (c + x, [*ts, t])
            state = step
        if need in state and (best is None or state[need][0] < best[0]):
            best = (state[need][0], list(zip(parts, state[need][1], strict=True)))
    return best[1]


def _flips(part: list[int], most: int) -> list[int]:
    """Masks (signed longs) that flip 0 to `most` bits of a partition."""
    out = []
    for k in range(most + 1):
        for c in combinations(part, k):
            v = sum(1 << b for b in c)
            out.append(v - (1 << 64) if v >= 1 << 63 else v)
    return out


def _probes(own: Column, i: int, masks: list[int]) -> Column:
    return F.transform(F.array(*map(F.lit, masks)), lambda x: F.struct(F.lit(i).alias("part"), own.bitwiseXOR(x).alias("bits")))


def links(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """All pairs (a < b) of distinct fingerprints (column fp) within `distance` bits."""
    sample = np.array([r["fp"] for r in distinct.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], np.int64).view(np.uint64)
    total = distinct.count()
    if total < 2:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).filter("false")
    probes, index = [], []
    for i, (part, t) in enumerate(plan(sample, total, distance)):
        if t < 0:
            continue
        mask = _flips(part, len(part))[-1] if len(part) == 1 else sum(1 << b for b in part)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        own = F.col("fp").bitwiseAND(F.lit(mask))
        index.append(F.struct(F.lit(i).alias("part"), own.alias("bits")))
        probes.append(_probes(own, i, _flips(part, t)))
    a = distinct.select(F.col("fp").alias("a"), F.explode(F.concat(*probes)).alias("k")).select("a", "k.part", "k.bits")
    b = distinct.select(F.col("fp").alias("b"), F.explode(F.array(*index)).alias("k")).select("b", "k.part", "k.bits")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return a.join(b, ["part", "bits"]).filter((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def _members(distinct: DataFrame, distance: int) -> DataFrame:
    """(fp, low, component) of distinct fingerprints: what links of at most `distance` bits reach."""
    found = components(links(distinct.select("fp"), distance))
    return distinct.join(found, distinct.fp == found.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))


def clusters(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, distance: int = 4) -> DataFrame:
    """key, fp, component_id: the least key that links of at most `distance` bits reach."""
    fps = materialize(fingerprints(df, key, text, words), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min(key).alias("low")), "distinct")
    member = _members(distinct, distance)
    low = member.groupBy("component").agg(F.min("low").alias("component_id"))
    named = member.join(low, "component").select("fp", "component_id")
    return fps.join(named, "fp").select(key, "fp", "component_id")


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, distance: int = 4) -> DataFrame:
    """The rows of df, all columns, that are the first of their group of near-duplicates. Rows that share a key stay or go together; rows with a null key stay.

    Texts link if their shingle sets have at least this similarity, which is verified. Fingerprint links of `distance` bits form the
    groups to begin with. Pairs near the least similarity lie many bits apart, where a search by bits compares nearly all pairs and
    still loses some: those are completed by setjoin, which loses none.
    """

    def guess(sets: DataFrame) -> DataFrame:
        distinct = materialize(sets.groupBy(F.col("mark").alias("fp")).agg(F.min("sid").alias("low")), "distinct")
        member = _members(distinct, distance)
        head = member.groupBy("component").agg(F.min("low").alias("head"))
        return sets.join(member.join(head, "component").select("fp", "head"), sets.mark == F.col("fp")).select("sid", "head")

    found = near_sets(df, key, text, words, similarity, lambda t: fingerprint(t, words), guess)
    # a key goes if none of its rows is the first of its group; few keys go by a broadcast, so that the texts are not shuffled
    gone = materialize(found.groupBy(key).agg(F.max(F.col(key) == F.col("component_id")).alias("first")).filter("not first").select(F.col(key).alias("__gone")), "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return df.join(gone, df[key] == gone["__gone"], "left_anti")
