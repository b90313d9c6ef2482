"""Token files: ids of a tokenizer, range coded with an adaptive context-mixing model.

File format: Parquet rows, one for each block: part and block (their order is the order of the ids),
first (ids of the part before the block), keys and counts (its documents and their numbers of ids) and
payload. A payload is a header (magic, ids, lanes, vocabulary, CRC-32 of the ids as little-endian 32-bit
integers, CRC-32 of all other bytes of the payload), the lengths of its lanes and the lanes themselves. A block's ids are dealt to lanes of
equal length that are coded in step, so that numpy handles one id of every lane at a time; all lanes of
a block share one model, which starts afresh with each block: any block can be read alone.

The model mixes three predictions of the next id: order 0, the adaptive frequencies of all ids; order 1,
the id that followed the previous id; order 2, the id that followed the previous two. The last two add
weight to their id by how often predictions of the same confidence came true in this block. The mixed
frequencies drive a carry-less range coder of 64 bits. All arithmetic is in integers.

Defined cases: null text is empty and has the end id alone; documents are written by ascending key (null
first), those that repeat a key by a hash of their text; a document never spans blocks; an empty table
gives files without blocks; a damaged payload raises ValueError; other columns are not read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from . import pretoken
from .common import mix, parallelism, ragged, text_steps
from .pretoken import byte_chars

U = np.uint64
MAGIC = b"CMR1"
_HEAD = struct.Struct("<4sIIIII")
LANES, LANE_IDS = 8192, 256
BLOCK_IDS = LANES * LANE_IDS
_STEP = 32  # weight of one occurrence in the order-0 frequencies
_STATES, _BITS = 16, 4
_MOST = U(64)  # a prediction weighs at most so many times all of order 0
_LOW, _TOP = U(1 << 40), U(1 << 48)
_CONTEXTS = 17  # bits of the order-2 table
_SLOT_BITS = 16  # of the table that finds ids
END_ID = 0
#: Distinct pre-tokens that a worker remembers before it starts afresh.
CACHE_WORDS = 1_000_000
_KEY_BYTES = 64
#: Masks of the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class _Model:
    def __init__(self, vocab: int, lanes: int):
        self.counts = np.ones(vocab, np.int64)
        # a prediction: the id times _STATES, plus its confidence
        self.table1, self.table2 = np.zeros(vocab, np.int64), np.zeros(1 << _CONTEXTS, np.int64)
        self.right, self.wrong = np.zeros((2, _STATES), np.int64), np.full((2, _STATES), 4, np.int64)
        self.before = self.before2 = np.zeros(lanes, np.int64)
        self.fresh: list[np.ndarray] = []
        self.seen, self.due = 0, 0
        self._rebuild()

    def _rebuild(self) -> None:
        if self.fresh:
            self.counts += _STEP * np.bincount(np.concatenate(self.fresh), minlength=len(self.counts))
            self.fresh = []
        self.cum = np.zeros(len(self.counts) + 1, U)
        np.cumsum(self.counts, out=self.cum[1:], dtype=U)
        self.total = self.cum[-1]
        self.slots = None
        self.bonus = np.minimum(self.total * (2 * self.right + 1).astype(U) // (2 * self.wrong + 1).astype(U), self.total * _MOST)
        self.due = self.seen + self.seen // 8 + 1

    def find(self, v: np.ndarray) -> np.ndarray:
        """The ids whose shares of the order-0 frequencies hold the values v: by a table of slots, by bisection where a slot holds several."""
        if self.slots is None:
            self.shift = U(max(0, int(self.total).bit_length() - _SLOT_BITS))
            ends = np.bincount((self.cum[1:-1] - U(1) >> self.shift).astype(np.int64) + 1, minlength=(1 << _SLOT_BITS) + 1)
            self.slots = np.cumsum(ends)
        x = self.slots[(v >> self.shift).astype(np.int64)]
        far = np.flatnonzero(self.cum[x + 1] <= v)
        if len(far):
            x[far] = np.minimum(np.searchsorted(self.cum, v[far], "right") - 1, len(self.counts) - 1)
        return x

    def predict(self) -> tuple[np.ndarray, ...]:
        """The two predicted ids of each lane, and the weights that they add."""
        self.at2 = ((self.before2 * 0x2545F491 + self.before * 0x9E3779B1) >> 7) & ((1 << _CONTEXTS) - 1)
        self.p1, self.p2 = self.table1[self.before], self.table2[self.at2]
        self.s1, self.s2 = self.p1 & (_STATES - 1), self.p2 & (_STATES - 1)
        self.c1, self.c2 = self.p1 >> _BITS, self.p2 >> _BITS
        return self.c1, self.c2, self.bonus[0][self.s1], self.bonus[1][self.s2]

    def update(self, x: np.ndarray) -> None:
        for k, at, table, p, c, s in ((0, self.before, self.table1, self.p1, self.c1, self.s1), (1, self.at2, self.table2, self.p2, self.c2, self.s2)):
            hit = x == c
            both = np.bincount(s + _STATES * hit, minlength=2 * _STATES)
            self.wrong[k] += both[:_STATES]
            self.right[k] += both[_STATES:]
            missed = np.where(s > 0, p - s + (s >> 1), x << _BITS)
            table[at] = np.where(hit, p + (s < _STATES - 1), missed)
        self.before2, self.before = self.before, x
        self.fresh.append(x)
        self.seen += len(x)
        if self.seen >= self.due:
            self._rebuild()


def _shifts(low: np.ndarray, width: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shifts settled words out of the lanes' intervals, in place: the lanes that shift, and their `low` before."""
    settled = (low ^ (low + width)) < _TOP
    go = np.flatnonzero(settled | (width < _LOW))
    settled = settled[go]
    while len(go):
        own = low[go]
        wide = np.where(settled, width[go], (~own + U(1)) & (_LOW - U(1))) << U(16)
        low[go], width[go] = own << U(16), wide
        yield go, own
        own = low[go]
        settled = (own ^ (own + wide)) < _TOP
        more = settled | (wide < _LOW)
        go, settled = go[more], settled[more]


def _shape(n: int) -> tuple[int, int]:
    """Lanes, and ids of each, for a block of n ids."""
    steps = -(-n // max(1, min(LANES, n // LANE_IDS)))
    return -(-n // steps), steps


def encode_block(ids: np.ndarray) -> bytes:
    n = len(ids)
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    if not n:
        return _sealed(0, 0, 0, crc, b"")
    lanes, steps = _shape(n)
    vocab = int(ids.max()) + 1
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = _Model(vocab, lanes)
    low, width = np.zeros(lanes, U), np.full(lanes, U(2**64 - 1))
    out_lane, out_word = [], []
    for x in grid:
        c1, c2, w1, w2 = model.predict()
        begin = model.cum[x]
        share = model.cum[x + 1] - begin
        begin = begin + w1 * (x > c1) + w2 * (x > c2)
        share = share + w1 * (x == c1) + w2 * (x == c2)
        unit = width // (model.total + w1 + w2)
        low = low + unit * begin
        width = unit * share
        for go, own in _shifts(low, width):
            out_lane.append(go)
            out_word.append((own >> U(48)).astype(np.uint16))
        model.update(x)
    last = (low + U((1 << 32) - 1)) >> U(32)
    for shift in (16, 0):
        out_lane.append(np.arange(lanes))
        out_word.append(((last >> U(shift)) & U(0xFFFF)).astype(np.uint16))
    lane, word = np.concatenate(out_lane), np.concatenate(out_word)
    order = np.argsort(lane, kind="stable")
    sizes = np.bincount(lane, minlength=lanes).astype("<u4")
    return _sealed(n, lanes, vocab, crc, sizes.tobytes() + word[order].astype("<u2").tobytes())


def _sealed(n: int, lanes: int, vocab: int, crc: int, body: bytes) -> bytes:
    head = _HEAD.pack(MAGIC, n, lanes, vocab, crc, 0)
    return _HEAD.pack(MAGIC, n, lanes, vocab, crc, zlib.crc32(body, zlib.crc32(head))) + body


def decode_block(payload: bytes) -> np.ndarray:
    """The ids of a block; ValueError if it is damaged."""
    if len(payload) < _HEAD.size:
        raise ValueError("damaged block: no header")
    magic, n, lanes, vocab, crc, seal = _HEAD.unpack_from(payload)
    if magic != MAGIC or seal != zlib.crc32(payload[_HEAD.size :], zlib.crc32(_HEAD.pack(magic, n, lanes, vocab, crc, 0))):
        raise ValueError("damaged block: the checksum differs")
    if n and (lanes, -(-n // max(1, lanes))) != _shape(n):
        raise ValueError("damaged block: bad header")
    if not n:
        return np.empty(0, np.int64)
    sizes = np.frombuffer(payload, "<u4", lanes, _HEAD.size).astype(np.int64)
    body = payload[_HEAD.size + 4 * lanes :]
    if len(body) != 2 * int(sizes.sum()):
        raise ValueError("damaged block: bad length")
    words = np.concatenate([np.frombuffer(body, "<u2"), np.zeros(1, np.uint16)]).astype(U)
    stop = np.cumsum(sizes)
    at, none = stop - sizes, len(words) - 1
    model = _Model(vocab, lanes)
    low, width, code = np.zeros(lanes, U), np.full(lanes, U(2**64 - 1)), np.zeros(lanes, U)
    for _ in range(4):
        code = (code << U(16)) | words[np.where(at < stop, at, none)]
        at = at + 1
    steps = -(-n // lanes)
    grid = np.empty((steps, lanes), np.int64)
    for t in range(steps):
        c1, c2, w1, w2 = model.predict()
        total = model.total + w1 + w2
        unit = width // total
        v = np.minimum((code - low) // unit, total - U(1))
        cum = model.cum
        # the two predicted ids: where their shares begin and how wide they are (w is zero where both are one id)
        both = c1 == c2
        b1, b2 = cum[c1] + w2 * (c1 > c2), cum[c2] + w1 * (c2 > c1)
        s1, s2 = cum[c1 + 1] - cum[c1] + w1 + w2 * both, cum[c2 + 1] - cum[c2] + w2 + w1 * both
        at1, at2 = v - b1 < s1, v - b2 < s2  # unsigned: a value below the beginning wraps
        x, begin, share = np.where(at1, c1, c2), np.where(at1, b1, b2), np.where(at1, s1, s2)
        rest = np.flatnonzero(~(at1 | at2))
        if len(rest):
            after1, after2 = w1[rest] * (v[rest] >= b1[rest]), w2[rest] * (v[rest] >= b2[rest])
            own = model.find(v[rest] - after1 - after2)
            x[rest], begin[rest], share[rest] = own, cum[own] + after1 + after2, cum[own + 1] - cum[own]
        low = low + unit * begin
        width = unit * share
        for go, _ in _shifts(low, width):
            code[go] = (code[go] << U(16)) | words[np.where(at[go] < stop[go], at[go], none)]
            at[go] += 1
        grid[t] = x
        model.update(x)
    ids = grid.T.reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("damaged block: the checksum differs")
    return ids


# --- encoding by the tokenizers library -------------------------------------------------------------


class _Words:
    """Numbers byte strings, vectorised: a table of slots by a 64-bit key, and the bytes of every string to compare with."""

    def __init__(self) -> None:
        self.table, self.bits = np.full(1 << 16, -1, np.int64), 16
        self.n, self.used = 0, 0
        self.key, self.start, self.size = (np.zeros(1 << 15, t) for t in (np.uint64, np.int64, np.int64))
        self.raw = np.zeros(1 << 18, np.uint8)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for unknown ones."""
        slot = (key >> U(64 - self.bits)).astype(np.int64)
        out = self.table[slot]
        open_ = np.flatnonzero((out >= 0) & (self.key[out] != key))
        while len(open_):  # the next slots
            slot[open_] = (slot[open_] + 1) & (len(self.table) - 1)
            got = out[open_] = self.table[slot[open_]]
            open_ = open_[(got >= 0) & (self.key[got] != key[open_])]
        return out

    def _place(self, number: np.ndarray) -> None:
        slot = (self.key[number] >> U(64 - self.bits)).astype(np.int64)
        while len(number):
            free = self.table[slot] < 0
            self.table[slot[free]] = number[free]
            left = self.table[slot] != number
            number, slot = number[left], (slot[left] + 1) & (len(self.table) - 1)

    def add(self, raw: np.ndarray, size: np.ndarray, key: np.ndarray | None) -> np.ndarray:
        """Adds strings (their bytes in a row); those without keys are numbered but not found by `find`."""
        number = np.arange(self.n, self.n + len(size))
        while self.n + len(size) > len(self.size):
            self.key, self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.key, self.start, self.size))
        while self.used + len(raw) + 8 > len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros_like(self.raw)])
        self.raw[self.used : self.used + len(raw)] = raw
        self.size[number], self.start[number] = size, self.used + np.cumsum(size) - size
        self.n, self.used = self.n + len(size), self.used + len(raw)
        if key is not None:
            self.key[number] = key
            self._place(number)
        return number

    def grow(self, more: int) -> None:
        """Makes room for `more` keys."""
        if 2 * (self.n + more) > len(self.table):
            while 2 * (self.n + more) > 1 << self.bits:
                self.bits += 1
            placed = self.table[self.table >= 0]
            self.table = np.full(1 << self.bits, -1, np.int64)
            self._place(placed)


def _eight(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, of bytes with eight more behind them."""
    return np.ndarray((len(raw) - 7,), "<u8", buffer=raw, strides=(1,))


class Encoder:
    """Ids by the tokenizers library. For byte-level BPE a worker has the library encode each distinct pre-token, by its bytes, once."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        chars = byte_chars()
        self.by_word = (
            model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")) and all(c in model["vocab"] for c in chars)
        )
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        if self.by_word:
            self.bare = Tokenizer(self.lib.model)  # the same model; pre-tokens come as the characters that stand for their bytes
            self.points = np.array([ord(c) for c in chars], np.uint32)
            self.piece = np.zeros(max(model["vocab"].values()) + 1, np.int64)
            for token, i in model["vocab"].items():
                self.piece[i] = len(token)
        self._fresh()

    def _fresh(self) -> None:
        self.known, self.odd = _Words(), {}
        self.store, self.used = np.empty(1 << 16, np.int32), 0
        self.at = self.size = np.empty(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        at = 0
        for i, t in enumerate(texts):
            if not self.by_word or any(s in t for s in self.special):
                if at < i:
                    out.append(self._by_word(texts[at:i]))
                ids = np.array(self.lib.encode(t, add_special_tokens=False).ids, np.int64)
                out.append((ids, np.array([len(ids)], np.int64)))
                at = i + 1
        if at < len(texts):
            out.append(self._by_word(texts[at:]))
        return np.concatenate([o[0] for o in out] or [np.empty(0, np.int64)]), np.concatenate([o[1] for o in out] or [np.empty(0, np.int64)])

    def _by_word(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.known.n > CACHE_WORDS:
            self._fresh()
        begin, end, upto = pretoken.spans(texts)
        flat = self._numbers("".join(texts).encode(), begin, end)
        lens = self.size[flat]
        total = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], upto])]
        return self.store[ragged(self.at[flat], lens)].astype(np.int64), np.diff(total)

    def _numbers(self, text: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each pre-token text[begin:end]. A key finds what may be equal, its bytes decide; what has the key
        of another string, or is longer than a key looks at, is numbered by a dictionary."""
        raw = np.frombuffer(text + bytes(8), np.uint8)
        lens, eight = end - begin, _eight(raw)
        deep = [(j, np.flatnonzero(lens > j)) for j in range(8, _KEY_BYTES, 8)]
        first = eight[begin] & _FIRST[np.minimum(lens, 8)]
        more = [eight[begin[i] + j] & _FIRST[np.minimum(lens[i] - j, 8)] for j, i in deep]
        key = mix(first + lens.astype(U) * U(0x9E3779B97F4A7C15))
        for (_, i), x in zip(deep, more, strict=True):
            key[i] = mix(key[i] + x)
        short = lens <= _KEY_BYTES
        flat = self.known.find(key)
        new = np.flatnonzero((flat < 0) & short)
        if len(new):
            once = new[np.unique(key[new], return_index=True)[1]]
            self.known.grow(len(once))
            self._learn(raw[ragged(begin[once], lens[once])], lens[once], key[once])
            flat[new] = self.known.find(key[new])
        start, held = self.known.start[flat], _eight(self.known.raw)
        same = short & (self.known.size[flat] == lens) & (held[start] & _FIRST[np.minimum(lens, 8)] == first)
        for (j, i), x in zip(deep, more, strict=True):
            same[i] &= held[np.minimum(start[i] + j, len(held) - 1)] & _FIRST[np.minimum(lens[i] - j, 8)] == x
        for at in np.flatnonzero(~same).tolist():
            word = text[begin[at] : end[at]]
            if word not in self.odd:
                self.odd[word] = int(self._learn(np.frombuffer(word, np.uint8), np.array([len(word)]), None)[0])
            flat[at] = self.odd[word]
        return flat

    def _learn(self, raw: np.ndarray, size: np.ndarray, key: np.ndarray | None) -> np.ndarray:
        """Has the library encode new pre-tokens (their bytes in a row), and numbers them."""
        shown, ends = self.points[raw].tobytes().decode("utf-32-le"), np.cumsum(size)
        parts = [shown[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
        ids = np.array(self.bare.encode_batch_fast([parts], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int32)
        # an id stands for as many bytes as its token has characters, so the ends of the words divide the ids
        stop = np.searchsorted(np.cumsum(self.piece[ids]), ends, "left") + 1
        lens = np.diff(stop, prepend=0)
        need = self.used + len(ids)
        if need > len(self.store):
            self.store = np.concatenate([self.store[: self.used], np.empty(max(need, 2 * len(self.store)) - self.used, np.int32)])
        self.store[self.used : need] = ids
        number = self.known.add(raw, size, key)
        if number[-1] >= len(self.size):
            self.at, self.size = (np.concatenate([x, np.zeros(max(len(x), int(number[-1]) + 1), np.int64)]) for x in (self.at, self.size))
        self.at[number], self.size[number], self.used = self.used + stop - lens, lens, need
        return number


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def write(docs: DataFrame, out: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all texts, end_id after each, as token files in the folder `out`, by ascending key."""
    docs = docs.select(key, text)
    ordered = docs.repartitionByRange(parallelism(docs.sparkSession), key).sortWithinPartitions(F.col(key), F.xxhash64(text))
    fields = [("part", T.IntegerType()), ("block", T.IntegerType()), ("first", T.LongType()), ("n", T.LongType()), ("keys", T.ArrayType(docs.schema[key].dataType)), ("counts", T.ArrayType(T.LongType())), ("payload", T.BinaryType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, first = TaskContext.get().partitionId(), 0, 0
        own = _encoder(tokenizer)
        keys: list[pa.Array] = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def blocks(all_of_them: bool) -> Iterator[pa.RecordBatch]:
            nonlocal block, first, keys, counts, ids
            k, c, i = pa.concat_arrays(keys), np.concatenate(counts), np.concatenate(ids)
            ends = np.cumsum(c)
            a = base = 0
            while a < len(c) and (all_of_them or ends[-1] - base >= block_ids):
                b = max(a + 1, int(np.searchsorted(ends, base + block_ids, "right")))
                n = int(ends[b - 1] - base)
                yield pa.RecordBatch.from_arrays([
                    pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([n], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), k.slice(a, b - a)), pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), pa.array(c[a:b])),
                    pa.array([encode_block(i[base : base + n])], pa.binary()),
                ], schema.names)
                block, first, a, base = block + 1, first + n, b, base + n
            keys, counts, ids = [k.slice(a)], [c[a:]], [i[base:]]

        held = 0
        for rows, col in text_steps(batches, text, 1 << 20):
            flat, n = own.encode(col.to_pylist())
            keys.append(rows.column(0))
            counts.append(n + 1)
            ids.append(np.insert(flat, np.cumsum(n), end_id))
            held += len(ids[-1])
            if held >= block_ids:
                yield from blocks(False)
                held = sum(map(len, ids))
        if held:
            yield from blocks(True)

    ordered.mapInArrow(run, schema).write.parquet(out)


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a folder with base: the ids of all parts before theirs. One row for each part is summed up on its own."""
    blocks = spark.read.parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return blocks.join(F.broadcast(base), "part")  # as many rows as the writer had partitions


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, ids) of each document; start: the ids of all documents before it."""
    return _read(_blocks(spark, path), key, True)


def digest(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document, from the decoded files."""
    return _read(_blocks(spark, path), key, False)


def _read(blocks: DataFrame, key: str, whole: bool) -> DataFrame:
    key_type = blocks.schema["keys"].dataType.elementType
    more = [T.StructField("ids", T.ArrayType(T.IntegerType()))] if whole else [T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType([T.StructField(key, key_type), T.StructField("start", T.LongType()), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                counts = batch.column(3)[r].values.to_numpy(zero_copy_only=False)
                ids = decode_block(batch.column(4)[r].as_py()).astype("<u4")
                ends = np.cumsum(counts)
                start = pa.array(ends - counts + batch.column(0)[r].as_py() + batch.column(1)[r].as_py())
                if whole:
                    tail = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))]
                else:
                    raw = memoryview(ids.tobytes())
                    tail = [pa.array(counts), pa.array([zlib.crc32(raw[4 * (e - c) : 4 * e]) for c, e in zip(counts.tolist(), ends.tolist(), strict=True)], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(2)[r].values, start, *tail], schema.names)

    return blocks.select("base", "first", "keys", "counts", "payload").mapInArrow(run, schema)
