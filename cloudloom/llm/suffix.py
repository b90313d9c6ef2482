"""Suffix-array dedup: every byte of a `length`-byte string that also starts elsewhere is removed.

Which suffixes need sorting at all? Each string of `length` bytes has one anchor: the first least hash of
the `gram`-byte strings in it. Equal strings have equal anchors at equal distance, so only suffixes below
the same anchor are compared. Consecutive starts with one anchor form a span. Anchors that occur once are
done; spans that occur twice or more as a whole are removed as a whole; one span of each kind that is
left where an anchor has several kinds of span goes on to the suffix sort.

The sort is deep-shallow: suffixes of a bucket of anchors are ordered by multikey steps of eight bytes to
a depth of SHALLOW bytes; groups that still share a prefix are compared with their first member, and a
blind trie orders those that differ. Only the first `length` bytes matter, so the order ends there.
An anchor with more than HOT kinds of span is split: its strings go out one by one, by their own hash, so
no bucket holds an unbounded group. Anchors and spans are named by 64-bit hashes; below one anchor the
strings of different spans are compared byte by byte.

Defined cases: null text is empty; texts shorter than `length` lose nothing; strings may overlap, also in
one document; rows that repeat key and text are documents of their own and copies of each other; rows
with a null key are treated alike; an empty table has no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import flat_bytes, materialize, mix, parallelism, ragged, text_steps

SHALLOW = 64
HOT = 2000
BUCKET_SPANS = 8000


def _anchored(raw: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first start, further starts, distance of the anchor from the first start, anchor hash, span hash) of each span."""
    n = len(raw) - length + 1
    if n <= 0:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    size = common.STEP_BYTES + 1
    while size <= len(raw):
        size *= 2
    up, down = common._powers(size)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(common._BYTE[raw] * up[: len(raw)], out=sums[1:])
    m = len(raw) - gram + 1
    grams = mix((sums[gram:] - sums[:m]) * down[:m])
    low = np.uint64((1 << 28) - 1)
    wide = length - gram + 1
    blocks = -(-(m + wide) // wide)
    v = np.full(blocks * wide, np.iinfo(np.uint64).max, np.uint64)
    v[:m] = (grams & ~low) | (np.arange(m, dtype=np.uint64) & low)
    v = v.reshape(blocks, wide)
    ahead = np.minimum.accumulate(v, axis=1).reshape(-1)
    behind = np.ascontiguousarray(np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1]).reshape(-1)
    least = np.minimum(behind[:n], ahead[wide - 1 : wide - 1 + n])
    at = (least & low).astype(np.int64)
    at += ((np.arange(n, dtype=np.int64) - at) >> 28 << 28) * (len(raw) > int(low))  # texts beyond 2^28 bytes
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:n]
    valid = np.arange(n) + length <= offs[doc + 1]
    same = np.zeros(n + 1, bool)
    same[1:-1] = valid[1:] & valid[:-1] & (at[1:] == at[:-1]) & (doc[1:] == doc[:-1])
    first, last = np.flatnonzero(valid & ~same[:-1]), np.flatnonzero(valid & ~same[1:])
    end = last + length
    span = mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))
    return doc[first], first - offs[doc[first]], last - first, at[first] - first, grams[at[first]].view(np.int64), span.view(np.int64)


def spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, id, pos, more, off, anchor, span) of each span; docs has key, id and text."""
    schema = T.StructType([docs.schema["key"], T.StructField("id", T.LongType()), *(T.StructField(n, T.LongType()) for n in ("pos", "more", "off", "anchor", "span"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, col in text_steps(batches, size=1 << 20):
            doc, *rest = _anchored(*flat_bytes(col), length, gram)
            if len(doc):
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(doc)), rows.column(1).take(pa.array(doc)), *map(pa.array, rest)], schema.names)

    return docs.mapInArrow(run, schema)


class BlindTrie:
    """Orders byte strings of one length; a node knows only where its strings first differ."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None
        for i in range(len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while isinstance(node, tuple):  # descend blindly
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        t = self.strings[node[0]]
        if s == t:
            node.append(i)
            return
        lo, hi = 0, len(s)
        while hi - lo > 1:  # s[:lo] == t[:lo] and s[:hi] != t[:hi]
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if s[lo:mid] == t[lo:mid] else (lo, mid)
        depth, parent, node = lo, None, self.root
        while isinstance(node, tuple) and node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][s[depth]] = [i]
            return
        new = (depth, {t[depth]: node, s[depth]: [i]})
        if parent is None:
            self.root = new
        else:
            parent[1][s[parent[0]]] = new

    def groups(self) -> Iterator[list[int]]:
        """The numbers of equal strings, in the order of the strings."""
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                yield node


def repeated_starts(flat: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which of the strings flat[start:start+length] occur twice or more within their group."""
    out = np.zeros(len(starts), bool)
    if not len(starts):
        return out
    pad = np.concatenate([flat, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(len(flat), np.uint64)
    for j in range(8):
        word |= pad[j : j + len(flat)] << np.uint64(56 - 8 * j)
    depths = [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else [])
    live = np.argsort(group, kind="stable")
    rank = group[live]

    def narrow(live: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.concatenate([[True], rank[1:] != rank[:-1]])
        alone = new & np.concatenate([new[1:], [True]])
        return live[~alone], (np.cumsum(new) - 1)[~alone]

    live, rank = narrow(live, rank)
    for d in (d for d in depths if d < SHALLOW):
        if not len(live):
            return out
        key = word[starts[live] + d]
        order = np.lexsort((key, rank))
        live, key, rank = live[order], key[order], rank[order]
        new = np.concatenate([[True], (rank[1:] != rank[:-1]) | (key[1:] != key[:-1])])
        live, rank = narrow(live, np.cumsum(new))
    if not len(live):
        return out
    new = np.concatenate([[True], rank[1:] != rank[:-1]])
    head = live[np.flatnonzero(new)[np.cumsum(new) - 1]]
    like = np.ones(len(live), bool)
    for d in (d for d in depths if d + 8 > SHALLOW):
        like &= word[starts[live] + d] == word[starts[head] + d]
    number = np.cumsum(new) - 1
    out[live[like & (np.bincount(number, like)[number] > 1)]] = True
    rest, of = live[~like], number[~like]
    if len(rest):
        for part in np.split(rest, np.flatnonzero(of[1:] != of[:-1]) + 1):
            if len(part) > 1:
                trie = BlindTrie([flat[a : a + length].tobytes() for a in starts[part].tolist()])
                for g in trie.groups():
                    if len(g) > 1:
                        out[part[g]] = True
    return out


def _sorted_bucket(rows: pd.DataFrame, length: int, names: list[str]) -> pd.DataFrame:
    """The removed ranges of the spans of a bucket that occur once."""
    raw = rows["raw"].tolist()
    flat = np.frombuffer(b"".join(raw), np.uint8)
    base = np.cumsum([0, *map(len, raw[:-1])])
    more, off, pos = (rows[c].to_numpy(np.int64) for c in ("more", "off", "pos"))
    starts, own = ragged(base, more + 1), np.repeat(np.arange(len(rows)), more + 1)
    anchor = np.unique(rows["anchor"].to_numpy(), return_inverse=True)[1].astype(np.int64)
    distance = off[own] - (starts - base[own])
    found = repeated_starts(flat, starts, anchor[own] * (length + 1) + distance, length) & rows["alone"].to_numpy(bool)[own]
    at = np.flatnonzero(found)
    if not len(at):
        return pd.DataFrame({n: [] for n in names})
    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(own[at]) > 0)) + 1
    first, last = at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])]
    who, shift = own[first], pos[own[first]] - base[own[first]]
    return pd.DataFrame({"id": rows["id"].to_numpy()[who], "start": starts[first] + shift, "end": starts[last] + shift + length})[names]


def _cut(docs: DataFrame, length: int) -> DataFrame:
    """docs (text, wanted: its spans) -> one row for each span with its bytes; those of hot anchors one string at a time."""
    names = ["id", "pos", "more", "off", "anchor", "alone", "hot", "raw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, col in text_steps(batches):
            out: list[tuple] = []
            for ident, text, wanted in zip(rows.column(0).to_pylist(), col.to_pylist(), rows.column(2).to_pylist(), strict=True):
                raw = text.encode()
                for w in wanted:
                    if w["hot"]:
                        out += [(ident, w["pos"] + j, 0, w["off"] - j, w["anchor"], w["alone"], True, raw[w["pos"] + j : w["pos"] + j + length]) for j in range(w["more"] + 1)]
                    else:
                        out.append((ident, w["pos"], w["more"], w["off"], w["anchor"], w["alone"], False, raw[w["pos"] : w["pos"] + w["more"] + length]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()), strict=True)], names)

    return docs.mapInArrow(run, "id long, pos long, more long, off long, anchor long, alone boolean, hot boolean, raw binary")


def removed_ranges(docs: DataFrame, length: int = 200, gram: int = 32) -> DataFrame:
    """(id, start, end): ranges of bytes to remove; docs has key, id and text and is dealt out by id."""
    own = materialize(spans(docs, length, gram), "spans")
    twice = materialize(own.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("span") != F.max("span")).alias("kinds")).filter("n > 1").drop("n"), "anchors")
    some = materialize(own.join(twice, "anchor"), "repeated")
    kinds = materialize(some.groupBy("anchor", "span", "kinds").agg(F.count("*").alias("n"), F.min(F.struct("id", "pos", "more", "off")).alias("s")), "kinds")
    whole = some.join(kinds.filter("n > 1").select("anchor", "span"), ["anchor", "span"]).select("id", F.col("pos").alias("start"), (F.col("pos") + F.col("more") + length).alias("end"))
    several = kinds.filter("kinds")
    hot = several.groupBy("anchor").agg((F.count("*") > HOT).alias("hot"))
    wanted = several.join(hot, "anchor").groupBy("s.id").agg(F.collect_list(F.struct("s.pos", "s.more", "s.off", "anchor", (F.col("n") == 1).alias("alone"), "hot")).alias("wanted"))
    parts = max(parallelism(docs.sparkSession), several.count() // BUCKET_SPANS + 1)
    cut = _cut(docs.join(wanted, "id").select("id", "text", "wanted"), length)
    bucket = F.pmod(F.when(F.col("hot"), F.xxhash64("raw")).otherwise(F.xxhash64("anchor")), F.lit(parts))
    names = ["id", "start", "end"]
    found = cut.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(lambda rows: _sorted_bucket(rows, length, names), "id long, start long, end long")
    return whole.unionByName(found)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, gram: int = 32) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, spans (removed ranges of bytes) and kept (the other bytes) of each document."""
    named = docs.select(F.col(key).alias("key"), F.xxhash64(F.lit(1), F.col(key), F.col(text)).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    dealt = named.repartition(parallelism(docs.sparkSession), "id")
    gone = removed_ranges(dealt, length, gram).groupBy("id").agg(F.collect_set(F.struct("start", "end")).alias("gone"))
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, col in text_steps(batches):
            sizes, removed, ranges, kept = [], [], [], []
            for t, own in zip(col.to_pylist(), rows.column(2).to_pylist(), strict=True):
                raw = t.encode()
                merged: list[list[int]] = []
                for a, b in sorted((g["start"], g["end"]) for g in own or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                at, parts = 0, []
                for a, b in merged:
                    parts.append(raw[at:a])
                    at = b
                kept.append(b"".join([*parts, raw[at:]]))
                sizes.append(len(raw))
                removed.append(sum(b - a for a, b in merged))
                ranges.append([{"start": a, "end": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(r) for r in ranges], pa.int64()), pa.array(ranges, arrow), pa.array(kept, pa.binary())], schema.names)

    return dealt.join(gone, "id", "left").select("key", "text", "gone").mapInArrow(run, schema)
