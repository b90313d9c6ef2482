"""Benchmark decontamination: short test items inside long documents, by size-partitioned MinHash.

Items are partitioned by their number of distinct word shingles. An item of n shingles is found if a
document holds at least ceil(threshold * n) of them, so it can miss at most n - ceil(threshold * n):
of any n - ceil(threshold * n) + 1 shingles it must hold one. The sketch of an item is that many of its
smallest shingle hashes (its bottom-k MinHash, k set by its size partition), hence a document that hits
no sketch holds no item: nothing is lost. Documents of every length are searched with all their
shingles; each hit is verified by the exact containment of the shingle strings.

Test sets are small against the corpus, but their size is checked: items go to the workers in blocks
of at most `block_shingles` shingles, and a larger test set takes more passes, not more memory.

Words are runs of ASCII letters, digits and non-ASCII characters; A-Z count as a-z. Defined cases: null
texts have no words; an item of fewer words than a shingle is one shingle of all its words; an item
without words is never found; repeated items and documents are reported as often as they come;
columns besides key and text are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, LOWER, flat_bytes, sequence_hash, span_hash, text_steps, word_spans

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def shingles(text: str | None, size: int) -> set[bytes]:
    words = WORDS((text or "").encode().lower())
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def _hashes(col: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts in a row, the text of each, and hash and text of texts shorter than a shingle."""
    raw, offs = flat_bytes(col)
    raw = LOWER[raw]
    starts, ends, upto = word_spans(raw, offs, ALNUM)
    words = span_hash(raw, starts, ends)
    own = np.searchsorted(upto, np.arange(len(words)), "right")
    grams = sequence_hash(words, size)
    whole = own[: len(grams)] == own[size - 1 :][: len(grams)] if len(grams) else np.empty(0, bool)
    counts = np.diff(np.concatenate([[0], upto]))
    short = np.flatnonzero((counts > 0) & (counts < size))
    alone = np.array([sequence_hash(words[upto[i] - counts[i] : upto[i]], int(counts[i]))[0] for i in short], np.uint64)
    return grams[whole], own[: len(grams)][whole], alone, short


def _blocks(items: DataFrame, key: str, text: str, block_shingles: int) -> Iterator[list[tuple]]:
    block, held = [], 0
    for r in items.select(key, text).toLocalIterator():
        n = len((r[1] or "").split())
        if block and held + n > block_shingles:
            yield block
            block, held = [], 0
        block.append((r[0], r[1]))
        held += n
    if block:
        yield block


def _sketches(block: list[tuple], size: int, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[object, set[bytes], int]]]:
    """Sorted sketch hashes, the number of the item of each, and (id, shingles, least number held) of each item."""
    items, keys, owner = [], [], []
    for ident, text in block:
        own = shingles(text, size)
        if not own:
            continue
        need = max(1, math.ceil(threshold * len(own) - 1e-9))
        hashed = np.unique(np.concatenate(_hashes(pa.array([text]), size)[::2]))
        low = hashed[: len(own) - need + 1]
        keys.append(low)
        owner.append(np.full(len(low), len(items)))
        items.append((ident, own, need))
    if not items:
        return np.empty(0, np.uint64), np.empty(0, np.int64), []
    flat, of = np.concatenate(keys), np.concatenate(owner)
    order = np.argsort(flat, kind="stable")
    return flat[order], of[order], items


def contained(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = 5, threshold: float = 0.8, block_shingles: int = 1_000_000) -> DataFrame:
    """(key, item_key, n_shared, n_item, containment) of each item of which a document holds `threshold` of the shingles."""
    spark = docs.sparkSession
    docs = docs.select(key, text)
    schema = T.StructType([docs.schema[key], T.StructField(item_key, items.schema[item_key].dataType), T.StructField("n_shared", T.LongType()), T.StructField("n_item", T.LongType()), T.StructField("containment", T.DoubleType())])
    out = None
    for block in _blocks(items, item_key, item_text, block_shingles):
        held = spark.sparkContext.broadcast(_sketches(block, size, threshold))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            known = held.value[2]
            item_type = pa.array([k[0] for k in known]).type
            for rows, col in text_steps(batches, text):
                if found := _found(col, held.value, size):
                    n_shared, n_item = (np.array([f[i] for f in found], np.int64) for i in (2, 3))
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array([f[0] for f in found])), pa.array([f[1] for f in found], item_type), pa.array(n_shared), pa.array(n_item), pa.array(n_shared / n_item)], schema.names)

        part = docs.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _found(col: pa.Array, sketches: tuple, size: int) -> list[tuple[int, object, int, int]]:
    """(text, item, shared shingles, shingles of the item) of every item that a text holds."""
    keys, owner, known = sketches
    if not len(keys):
        return []
    grams, of, alone, short = _hashes(col, size)
    grams, of = np.concatenate([grams, alone]), np.concatenate([of, short])
    # a table of bits rules most shingles out before the binary search
    maybe = np.zeros(1 << 20, bool)
    maybe[(keys >> np.uint64(44)).astype(np.int64)] = True
    can = np.flatnonzero(maybe[(grams >> np.uint64(44)).astype(np.int64)])
    grams, of = grams[can], of[can]
    hit = keys[np.minimum(np.searchsorted(keys, grams), len(keys) - 1)] == grams
    found: dict[int, set[int]] = {}
    for g, d in {*zip(grams[hit].tolist(), of[hit].tolist(), strict=True)}:
        lo, hi = np.searchsorted(keys, np.uint64(g), "left"), np.searchsorted(keys, np.uint64(g), "right")
        found.setdefault(d, set()).update(owner[lo:hi].tolist())
    out = []
    for d in sorted(found):
        own = shingles(col[d].as_py(), size)
        out += [(d, known[i][0], n, len(known[i][1])) for i in sorted(found[d]) if (n := len(known[i][1] & own)) >= known[i][2]]
    return out


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = 5, threshold: float = 0.8, block_shingles: int = 1_000_000) -> DataFrame:
    """The rows of docs, all columns, that hold no item: one pass over docs for each block of items, nothing is shuffled."""
    for block in _blocks(items, item_key, item_text, block_shingles):
        held = docs.sparkSession.sparkContext.broadcast(_sketches(block, size, threshold))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for rows, col in text_steps(batches, text):
                stay = np.ones(rows.num_rows, bool)
                stay[[f[0] for f in _found(col, held.value, size)]] = False
                yield rows.filter(pa.array(stay))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
