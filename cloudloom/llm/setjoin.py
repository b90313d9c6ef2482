"""Links between texts whose sets of word shingles are alike (Jaccard similarity), without loss.

Prefix filter: put all shingles in one global order. Of two sets with similarity s or more, each shares at
least ceil(s * n) of its n shingles, so their first n - ceil(s * n) + 1 shingles have one in common. Only
these are joined. Any order is right; common shingles, as a sample shows them, come last, so that the
joined ones are rare. Every candidate is verified by the whole sets.

Texts with equal sets are one set before anything is joined. A first guess of the groups (`guess`) may be given: each set is
verified against the first of its group, and pairs in one component by then need no comparison. A shingle that many sets share would join
them all with each other: rounds first verify every set against two sets drawn from those that share a shingle with it,
and pairs that are in one component by then need no comparison. All other pairs are compared at the end,
so rounds decide the time and never a link.

Words are separated by ASCII space, A-Z count as a-z; a text of fewer words than a shingle is one shingle;
sets without a shingle are alike. Shingles and sets are named by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, NOT_SPACE, bucketed, flat_bytes, materialize, parallelism, sequence_hash, span_hash, text_steps, word_spans
from .graph import components

#: Share of the texts that shows which shingles are common, and how many of those are kept; only speed depends on them.
SHARE, COMMON = 0.05, 1 << 18
#: Sets of (sid, key) rows that are broadcast at most (about 16 MB); more are joined by a shuffle of the texts.
BROADCAST_ROWS = 500_000
#: Rounds before all remaining pairs are compared; only speed depends on it.
ROUNDS = 6


def shingle_sets(col: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, offs = flat_bytes(col)
    raw = LOWER[raw]
    starts, ends, upto = word_spans(raw, offs, NOT_SPACE)
    ids = span_hash(raw, starts, ends)
    out, at = [], 0
    for to in upto.tolist():
        own = ids[at:to]
        out.append(np.unique(sequence_hash(own, min(words, len(own)))) if len(own) else np.empty(0, np.uint64))
        at = to
    return out


def name_of(own: np.ndarray) -> int:
    """The 64-bit name of a set, as a signed integer."""
    h = xxhash.xxh64_intdigest(own.tobytes(), 7)
    return h - (1 << 64) if h >= 1 << 63 else h


def prefix(own: np.ndarray, common: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in the global order: those not in `common` (sorted) by hash, then the common ones by rank."""
    n = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1
    if not len(own) or not len(common):
        return own[:n]
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    late = np.where(common[at] == own, rank[at], -1)
    return own[np.lexsort((own, late))[:n]]


def common_shingles(df: DataFrame, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, their ranks) of the shingles that occur in several texts of a sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, col in text_steps(batches, text):
            g, n = np.unique(np.concatenate(shingle_sets(col, words)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], ["g", "n"])

    counts = df.select(text).sample(SHARE, 1).mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    rows = counts.filter("n > 1").orderBy(F.desc("n"), "g").limit(COMMON).collect()
    g = np.array([r["g"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(g)
    return g[order], (len(g) - np.arange(len(g)))[order]


def _named(df: DataFrame, key: str, text: str, words: int, similarity: float, mark: Callable[[str], int]) -> DataFrame:
    """key, sid, n (shingles), the prefix and the mark of every row."""
    held = df.sparkSession.sparkContext.broadcast(common_shingles(df, text, words))
    df = df.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank = held.value
        for rows, col in text_steps(batches, text):
            sets = shingle_sets(col, words)
            first = [prefix(s, common, rank, similarity).view(np.int64) for s in sets]
            marks = np.array([mark(t) for t in col.to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([name_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array(marks)],
                [key, "sid", "n", "prefix", "mark"],
            )

    return df.mapInArrow(run, T.StructType([df.schema[key], T.StructField("sid", T.LongType()), T.StructField("n", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("mark", T.LongType())]))


def _bags(df: DataFrame, key: str, text: str, words: int, wanted: DataFrame, short: bool) -> DataFrame:
    """sid and the whole set of the wanted sets (sid, low: the least key that has it), from the texts: no other set is shuffled.

    short: two bytes of each shingle, sorted; what two sets share, their short forms share at least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, col in text_steps(batches, text):
            sets = shingle_sets(col, words)
            names = np.array([name_of(s) for s in sets], np.int64)
            own = np.flatnonzero(names == rows.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array([(np.sort(sets[i].astype(np.uint16)) if short else sets[i]).tobytes() for i in own], pa.binary())], ["sid", "bag"])

    texts = df.select(F.col(key).alias("key"), F.col(text).alias(text)).join(wanted, F.col("key").eqNullSafe(F.col("low"))).select("sid", text)
    return texts.mapInArrow(run, "sid long, bag binary").dropDuplicates(["sid"])


def _numbered(x: np.ndarray) -> np.ndarray:
    """Sorted values made distinct: each with its place among its equals."""
    i = np.arange(len(x))
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x.astype(np.int64) << 40 | i - np.maximum.accumulate(np.where(new, i, 0))


def _verified(pairs: DataFrame, bags: Callable[[DataFrame, bool], DataFrame], distinct: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b; a written table) whose whole sets are alike. Short forms, a quarter of the size, rule out pairs that share too little; the others are compared by their sets."""
    return _alike(materialize(_alike(pairs, bags, distinct, similarity, True), "likely"), bags, distinct, similarity, False)


def _alike(pairs: DataFrame, bags: Callable[[DataFrame, bool], DataFrame], distinct: DataFrame, similarity: float, short: bool) -> DataFrame:
    """The pairs that are alike by their sets, or can be by the short forms. Only the sets of these pairs are built, twice over the same exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = (np.frombuffer(z.as_buffer(), np.uint16 if short else np.uint64) for z in (x, y))
                if short:
                    one, two = _numbered(one), _numbered(two)
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(both >= similarity * (len(one) + len(two) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    sids = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    wanted = materialize(distinct.select("sid", "low").join(sids, "sid"), "wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    sets = bags(wanted, short)
    first = pairs.join(sets.select(F.col("sid").alias("a"), F.col("bag").alias("bag_a")), "a")
    whole = first.join(sets.select(F.col("sid").alias("b"), F.col("bag").alias("bag_b")), "b").select("a", "b", "bag_a", "bag_b")
    return whole.mapInArrow(run, "a long, b long")


def near_sets(df: DataFrame, key: str, text: str, words: int, similarity: float, mark: Callable[[str], int], guess: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """key, sid and component_id: the least key that links of at least `similarity` reach.

    mark: a 64-bit mark of a text. guess: (sid, mark) of the sets -> (sid, head), the groups that the marks suggest; it decides the time and never a link.
    """
    named = materialize(_named(df, key, text, words, similarity, mark), "named")
    distinct = materialize(named.groupBy("sid").agg(F.min(key).alias("low"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.min("mark").alias("mark")), "sets")
    # (sid, n) as one value: both sides of the join read one exchange of the same columns
    posts = distinct.select(F.explode("prefix").alias("g"), F.struct("sid", "n").alias("post")).repartition(parallelism(df.sparkSession), "g")
    several = posts.groupBy("g").agg(F.min("post").alias("low"), F.max("post").alias("high")).filter("low != high")
    shared, held = bucketed(posts.join(several, "g").select("g", "post.sid", "post.n"), "shared", "g")
    bags = lambda wanted, short: _bags(df, key, text, words, wanted, short)
    fits = (F.col("n_a") >= similarity * F.col("n_b") - 1e-9) & (F.col("n_b") >= similarity * F.col("n_a") - 1e-9)
    first = guess(distinct.select("sid", "mark")).filter("sid != head").select(F.col("sid").alias("a"), F.col("head").alias("b"))
    links, before = materialize(_verified(materialize(first, "pairs"), bags, distinct, similarity), "links"), None
    found = materialize(components(links), "components")
    for turn in range(ROUNDS + 1):
        known = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
        now = shared.join(known, shared.sid == found.node, "left").select("g", "sid", "n", F.coalesce("component", "sid").alias("component"))
        per = now.groupBy("g", "component").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("sid", F.lit(turn)).alias("h"), "sid", F.col("n").alias("m"))).alias("low"), F.max(F.struct(F.xxhash64("sid", F.lit(turn)).alias("h"), "sid", F.col("n").alias("m"))).alias("high"))
        # shingles whose sets are not yet one component
        open_ = materialize(per.groupBy("g").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"), F.min("low").alias("low"), F.max("high").alias("high")).filter("parts > 1"), "open")
        size = open_.agg(F.sum("n").alias("rows"), (F.sum(F.col("n").cast("double") * F.col("n") - F.col("own")) / 2).alias("pairs")).first()
        if not size["rows"]:
            break
        now = now.join(open_.select("g", "low", "high"), "g")
        # the rest is compared once it is small or a round hardly lessens it
        last = turn == ROUNDS or size["pairs"] <= 4 * size["rows"] or (before is not None and size["pairs"] > 0.9 * before)
        before = size["pairs"]
        if last:
            other = now.select("g", F.col("sid").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("in_b"))
            pairs = now.select("g", F.col("sid").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("in_a")).join(other, "g").filter((F.col("a") < F.col("b")) & (F.col("in_a") != F.col("in_b")) & fits)
        else:
            end = F.explode(F.array("low", "high")).alias("e")
            pairs = now.select(F.col("sid").alias("a"), F.col("n").alias("n_a"), end).select("a", "n_a", F.col("e.sid").alias("b"), F.col("e.m").alias("n_b")).filter((F.col("a") != F.col("b")) & fits)
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        new = materialize(_verified(materialize(pairs.select("a", "b").distinct(), "pairs"), bags, distinct, similarity), "links")
        links = links.unionByName(new)
        found = materialize(components(links), "components")
        if last:
            break
    df.sparkSession.sql(f"DROP TABLE {held}")  # the name; what is returned does not read it
    member = distinct.join(found, distinct.sid == found.node, "left").select("sid", "low", F.coalesce("component", "sid").alias("component"))
    least = member.groupBy("component").agg(F.min("low").alias("component_id"))
    return named.join(member.join(least, "component").select("sid", "component_id"), "sid").select(key, "sid", "component_id")
