"""Spelling variants: words that differ by one edit, found by a positional q-gram index with a count filter.

One edit spoils at most Q of a word's q-grams and moves those behind it by the difference in length. So two words one edit
apart share at least max(length) - Q + 1 - Q of them, at equal positions or, from the edit on, at positions one apart.
Ordered by rarity, then position, the first two shared grams lie within the first few of each word; a word is sent to
the part of the index that is named by its length (or the next length, which it may reach by an insertion) and such a pair of grams.
Each part is an inverted index of its own: gram and position to postings of words. A word looks up its grams there, the
postings of the shortest lists are merged by a heap, as many as a true neighbour cannot all miss; what comes out is
counted in the other lists, and what reaches the overlap bound is verified letter by letter.

A part that holds many words is cut into tiles, and tiles meet in tasks of their own, so no task holds more than two of them;
only distinct words travel, never their occurrences. The ranks of the grams are a table of at most 65 536 rows, whatever the input.

Defined cases: null text has no words; a null key counts as an empty one; rows that repeat count again; text of any length is
read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, parallelism

Q = 2
#: Words of a part of the index that one tile holds; only memory and time depend on it.
TILE = 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 7, often: int = 2, every: int = 31) -> DataFrame:
    """(word, n): the words of at least `least` letters that occur `often` times or more, each run by its crc32 with one letter left out of every 31st."""
    low = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"), F.explode(F.regexp_extract_all(low, F.lit(rf"[a-zÀ-ÿ]{{{least},}}"), F.lit(0))).alias("run"))
    named = runs.select("run", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")).alias("h"), F.length("run").alias("size"))
    at = (F.col("h") % F.col("size")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("size")))
    made = named.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return made.filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= often)


def _grams(word: str) -> list[int]:
    """Names of the q-grams, position by position; another alphabet may give two grams one name, which costs candidates and loses none."""
    at = word.encode("latin-1") if word.isascii() or max(word) <= "ÿ" else [*map(ord, word)]
    return [(a * 257 + b) & 0xFFFF for a, b in zip(at, at[1:], strict=False)]


def _packed(first: list[int]) -> int:
    """The first Q + 2 grams of a word in one signed 64-bit number."""
    out = 0
    for g in first:
        out = out << 16 | g
    return out - (1 << 64) if out >> 63 else out


def _unpacked(first: int) -> tuple[int, ...]:
    return tuple((first >> s) & 0xFFFF for s in range(16 * (Q + 1), -1, -16))


def _gram_ranks(found: DataFrame) -> np.ndarray:
    """Rank of each gram name, rare ones first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            total += np.bincount([g for w in batch.column(0).to_pylist() for g in _grams(w)], minlength=1 << 16)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], ["gram", "n"])

    rows = found.select("word").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # 65 536 at most
    total = np.zeros(1 << 16, np.int64)
    for r in rows:
        total[r["gram"]] = r["n"]
    rank = np.empty(1 << 16, np.int64)
    rank[np.argsort(total, kind="stable")] = np.arange(1 << 16)
    return rank


def _parts(found: DataFrame, rank: np.ndarray) -> DataFrame:
    """size, pair, own, word, n, first: a word in each part of the index where it may meet a neighbour; not own: it only looks up words one letter longer."""
    ranks = rank.astype(np.uint16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = ranks.tolist()
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                at, size, pair, own, first = [], [], [], [], []
                for i, w in enumerate(batch.column(0).to_pylist()):
                    g = _grams(w)
                    # a neighbour of equal length misses 2 of these grams at most, one that is longer by a letter misses 1
                    rare = [x & 0xFFFF for x in sorted([order[x] << 48 | k << 16 | x for k, x in enumerate(g)])[: Q + 2]]
                    packed = _packed(rare)
                    for mine, n in ((True, Q + 2), (False, Q + 1)):
                        for a, b in {*combinations(rare[:n], 2)}:
                            at.append(i)
                            size.append(len(w) + (not mine))
                            pair.append(a << 16 | b)
                            own.append(mine)
                            first.append(packed)
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(size, pa.int32()), pa.array(pair, pa.int64()), pa.array(own), batch.column(0).take(take), batch.column(1).take(take), pa.array(first, pa.int64())], ["size", "pair", "own", "word", "n", "first"])

    return found.select("word", "n").mapInArrow(run, "size int, pair long, own boolean, word string, n long, first long")


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced letter makes one word the other."""
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return i < len(a) and a[i + 1 :] == b[i + 1 :]
    return len(a) + 1 == len(b) and a[i:] == b[i + 1 :]


def _merged(lists: list[list[int]]) -> Iterator[tuple[int, int]]:
    """(word, number of the lists that hold it) in order: a heap over the heads of ascending lists."""
    if len(lists) == 1:
        yield from ((x, 1) for x in lists[0])
        return
    heap = [(x[0], k, 1) for k, x in enumerate(lists)]
    heapify(heap)
    while heap:
        now, count = heap[0][0], 0
        while heap and heap[0][0] == now:
            _, k, at = heap[0]
            count += 1
            if at < len(lists[k]):
                heapreplace(heap, (lists[k][at], k, at + 1))
            else:
                heappop(heap)
        yield now, count


class _Index:
    """The index of a part: (position, gram) to ascending places in `words`, all of one length."""

    def __init__(self, size: int, pair: int):
        self.size, self.bound = size, size - 2 * Q + 1
        self.pair = (pair >> 16, pair & 0xFFFF)
        self.words, self.counts, self.held, self.first, self.postings = [], [], [], [], {}

    def add(self, row: _Row) -> None:
        for k in row.keys:
            self.postings.setdefault(k, []).append(len(self.words))
        self.words.append(row.word)
        self.counts.append(row.n)
        self.held.append({*row.keys})
        self.first.append(row.first)

    def _here(self, mine: tuple[int, ...], other: tuple[int, ...]) -> bool:
        """Whether two words are compared in this part, of all those that they share: it is named by the first two grams that both begin with."""
        common = [*dict.fromkeys(g for g in mine if g in other)]
        return len(common) < 2 or (common[0], common[1]) == self.pair

    def near(self, row: _Row) -> Iterator[tuple[str, int]]:
        """(word, n) of the words one edit from row's, which has this length or is a letter shorter."""
        shorter = len(row.word) < self.size
        short = len(row.keys) - self.bound + 1  # a neighbour misses fewer grams than these
        get = self.postings.get
        if shorter:  # behind the inserted letter grams stand one place on
            grams = [[(k, x) for k in (key, key + (1 << 16)) if (x := get(k))] for key in row.keys]
            grams = sorted([(sum(len(x) for _, x in g), k, g) for k, g in enumerate(grams) if g])
            missing = len(row.keys) - len(grams)
            heads = [x for _, _, g in grams[: max(short - missing, 0)] for _, x in g]
            rest = {k for _, _, g in grams[max(short - missing, 0) :] for k, _ in g}
        else:
            lists = sorted([(len(x), k, x) for k in row.keys if (x := get(k))])
            missing = len(row.keys) - len(lists)
            heads = [x for _, _, x in lists[: max(short - missing, 0)]]
            rest = {k for _, k, _ in lists[max(short - missing, 0) :]}
        if missing >= short or not heads:
            return
        mine = row.first[: Q + 1] if shorter else row.first
        for place, count in _merged(heads):
            if count + len(rest & self.held[place]) >= self.bound and self._here(mine, self.first[place]) and one_edit(row.word, self.words[place]):
                yield self.words[place], self.counts[place]


class _Row:
    """A word in a part of the index."""

    __slots__ = ("first", "keys", "n", "own", "tile", "word")

    def __init__(self, word: str, n: int, own: bool, tile: int, first: int):
        self.word, self.n, self.own, self.tile, self.first = word, n, own, tile, _unpacked(first)
        self.keys = [p << 16 | g for p, g in enumerate(_grams(word))]


def _within(size: int, pair: int, tiles: tuple[int, int], rows: list[_Row]) -> Iterator[tuple[str, int, str, int]]:
    """Neighbours (a, n, b, n) in two tiles of a part."""
    one, two = tiles
    index = _Index(size, pair)
    for row in rows:
        if row.own and row.tile == one:
            if one == two:
                for b, m in index.near(row):
                    yield row.word, row.n, b, m
            index.add(row)
    for row in rows:
        if row.tile == two and (one != two or not row.own):
            for b, m in index.near(row):
                yield row.word, row.n, b, m
    if one != two:
        index = _Index(size, pair)
        for row in rows:
            if row.own and row.tile == two:
                index.add(row)
        for row in rows:
            if row.tile == one and not row.own:
                for b, m in index.near(row):
                    yield row.word, row.n, b, m


def near_pairs(found: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b), a < b, each once: every two words of (word, n) that lie one edit apart. Words have 5 letters or more."""
    parts = _parts(found, _gram_ranks(found))
    part = ["size", "pair"]
    large = parts.groupBy(*part).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).filter("tiles > 1")
    tiled = parts.join(large, part, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    met = tiled.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    place = [*part, "i", "j"]
    met = met.select(*part, F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"), "tile", "own", "word", "n", "first")
    ordered = met.repartition(parallelism(found.sparkSession), *place).sortWithinPartitions(*place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> None:
            if len(held) > 1:
                rows = [_Row(*r) for r in held]
                for a, n, b, m in _within(now[0], now[1], (now[2], now[3]), rows):
                    for c, v in zip(out, (a, n, b, m) if a < b else (b, m, a, n), strict=True):
                        c.append(v)

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k % 2 else pa.string()) for k, c in enumerate(out)], ["a", "n_a", "b", "n_b"])
            for c in out:
                c.clear()
            return batch

        out: list[list] = [[], [], [], []]
        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)])
            ends = [*(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            rows = [*zip(*(batch.column(k).to_pylist() for k in (6, 7, 5, 4, 8)), strict=True)]
            lo = 0
            for hi in ends:
                at = tuple(keys[:, lo].tolist())
                if at != now:
                    pairs()
                    now, held = at, rows[lo:hi]
                else:
                    held += rows[lo:hi]
                lo = hi
            if out[0]:
                yield made()
        pairs()
        if out[0]:
            yield made()

    return ordered.mapInArrow(run, "a string, n_a long, b string, n_b long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms that begins at word. Chains double in each round; counts grow along them, so they end."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def variants(found: DataFrame, ratio: int = 10) -> DataFrame:
    """word, form (its most frequent neighbour, if `ratio` times as frequent), root (the end of the chain of forms), n, n_near, form_n of (word, n)."""
    found = materialize(found.select("word", "n"), "words")
    pairs = materialize(near_pairs(found), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("form"), F.col("n_b").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("form"), F.col("n_a").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "form")).alias("best"))
    most = -F.col("best.less")
    fits = most >= F.col("n") * ratio
    named = found.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.form")).alias("form"), F.when(fits, most).alias("form_n"))
    named = materialize(named, "forms")
    roots = _roots(named.filter("form is not null"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 7, often: int = 2, ratio: int = 10) -> DataFrame:
    """The spelling variants among the words of docs, one row per word."""
    if least < 2 * Q + 1:
        raise ValueError(f"words of fewer than {2 * Q + 1} letters need not share two grams with a neighbour")
    return variants(words(docs, key, text, least, often), ratio)
