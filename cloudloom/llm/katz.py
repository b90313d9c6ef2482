"""LM scoring with Katz backoff: a bigram model over the words of the training documents.

P(w | h) = s(h) * d(c(h,w)) * c(h,w) / c(h) where the bigram was seen, else alpha(h) * P(w);
P(w)     = d(c(w)) * c(w) / N where the word was seen, else what the discounts leave (one unknown word).
d are Good-Turing discounts for counts up to 5 (each order from its own counts of counts); alpha(h) makes
P(. | h) sum to one exactly over all words and the unknown one. s(h) is 1 but for histories whose
counts are all too large to be discounted: there one count is set aside for unseen words.

How it runs: documents become chunks of tokens (a written table). Each chunk sends its distinct n-grams,
counted, to buckets by hash; a bucket adds the counts of all chunks and answers each chunk for the
n-grams that it asked for. The answers (a written table, by chunk) hold the counts of both orders; a second
round of the same kind adds up seen and backed-off mass of each history and answers with alpha and s.
A chunk sends an n-gram once however often it comes, so no key grows hot: a bucket holds a hash range of
distinct n-grams, and the number of buckets follows the number of tokens. The driver sees sums only.
N-grams are named by 64-bit hashes.

Defined cases: null text is empty (one end token); a document whose key is null is a training document;
rows that repeat a key are scored and counted as often as they come; without training documents every
token is unknown with probability one; an empty table has no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _MUL, LOWER, NOT_SPACE, flat_bytes, materialize, mix, span_hash, text_steps, word_spans

CHUNK_BYTES = 8 << 20
BUCKET_TOKENS = 2_000_000
GT_MOST = 5
START, END = np.uint64(0x53544152542D2D31), np.uint64(0x454E442D2D2D2D31)
_TYPES = (np.uint8, np.uint16, np.uint32, np.uint64, np.float64)


def _pack(x: np.ndarray) -> bytes:
    """An array in its smallest unsigned type, in byte planes (equal bytes lie together)."""
    kind = 4 if x.dtype == np.float64 else next(i for i, t in enumerate(_TYPES) if not len(x) or int(x.max()) <= np.iinfo(t).max)
    x = np.ascontiguousarray(x.astype(_TYPES[kind]))
    return bytes([kind]) + x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    kind = np.dtype(_TYPES[raw[0]])
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(kind.itemsize, -1)
    x = np.ascontiguousarray(planes.T).view(kind).reshape(-1)
    return x if kind == np.float64 else x.astype(np.int64) if kind.itemsize < 8 else x


def _keys(x: np.ndarray) -> bytes:
    """Sorted hashes of a bucket (their top byte is the same) as differences, in byte planes."""
    low = x & np.uint64((1 << 56) - 1)
    step = np.diff(low, prepend=np.zeros(1, np.uint64))
    return step.view(np.uint8).reshape(-1, 8)[:, :7].T.tobytes()


def _unkeys(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(raw, np.uint8).reshape(7, -1).T
    return np.cumsum(out.view(np.uint64).reshape(-1), dtype=np.uint64)


_PRIME = np.uint64((1 << 31) - 1)
_FIELD = np.random.Generator(np.random.PCG64(20250917)).integers(1, (1 << 31) - 1, 257, dtype=np.uint64)


@lru_cache(maxsize=1)
def _field_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n - 1 of the base and of its inverse modulo _PRIME."""
    base = int(_FIELD[256])
    out = []
    for b in (base, pow(base, -1, int(_PRIME))):
        p = np.ones(n, np.uint64)
        k = 1
        while k < n:
            p[k : 2 * k] = p[: min(k, n - k)] * np.uint64(pow(b, k, int(_PRIME))) % _PRIME
            k *= 2
        out.append(p)
    return out[0], out[1]


def _names(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit names of words. A polynomial modulo 2^64 alone gives some regular words one name (such as a long Thue-Morse word and its complement); one in a prime field tells them apart."""
    if not len(starts):
        return np.empty(0, np.uint64)
    size = 1 << 21
    while size <= len(raw):
        size *= 2
    up, down = _field_powers(size)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_FIELD[raw] * up[: len(raw)] % _PRIME, out=sums[1:])
    field = (sums[ends] - sums[starts]) % _PRIME * down[starts] % _PRIME
    return mix(span_hash(raw, starts, ends) ^ (field * np.uint64(0x9E3779B97F4A7C15)))


def chunks(docs: DataFrame) -> DataFrame:
    """(chunk, keys, held, counts, tokens, vocab): tokens are places in the chunk's own vocabulary of hashes, frequent first."""
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("keys", T.ArrayType(docs.schema["key"].dataType)), *(T.StructField(n, T.BinaryType()) for n in ("held", "counts", "tokens", "vocab"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for rows, col in text_steps(batches, size=CHUNK_BYTES):
            hashes, counts = [], []
            for lo, hi in _smaller(col):
                raw, offs = flat_bytes(col.slice(lo, hi - lo))
                raw = LOWER[raw]
                starts, ends, upto = word_spans(raw, offs, NOT_SPACE)
                hashes.append(np.insert(_names(raw, starts, ends), upto, END))
                counts.append(np.diff(np.concatenate([[0], upto])) + 1)
            vocab, ids = np.unique(np.concatenate(hashes), return_inverse=True)
            order = np.argsort(-np.bincount(ids), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            held = rows.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([
                pa.array([at], pa.int64()), pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(0)),
                *(pa.array([x], pa.binary()) for x in (held.tobytes(), _pack(np.concatenate(counts)), _pack(place[ids]), vocab[order].tobytes())),
            ], schema.names)
            at += 1

    return docs.select("key", "text", "held").mapInArrow(run, schema)


def _smaller(col: pa.Array, size: int = 2 << 20) -> Iterator[tuple[int, int]]:
    offs = flat_bytes(col)[1]
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
        yield at, to
        at = to


class _Chunk:
    """A chunk's tokens, and its distinct words and bigrams in the order of their hashes."""

    def __init__(self, held: bytes, counts: bytes, tokens: bytes, vocab: bytes):
        self.vocab = np.frombuffer(vocab, np.uint64)
        self.words = _unpack(tokens).astype(np.int32)
        self.counts = _unpack(counts)
        self.ends = np.cumsum(self.counts)
        self.held = np.frombuffer(held, np.uint8).astype(bool)
        self.train = np.repeat(~self.held, self.counts)
        self.by_hash = np.argsort(self.vocab)
        self.before = np.concatenate([np.zeros(1, np.int32), self.words[:-1]])
        self.before[np.concatenate([[0], self.ends[:-1]])] = len(self.vocab)  # the start
        self.names = np.concatenate([self.vocab, [START]])

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct names, a place where each occurs, and the number of the bigram at each place."""
        name = mix(self.names[self.before] * _MUL + self.vocab[self.words])
        order = np.argsort(name).astype(np.int32)
        name = name[order]
        new = np.concatenate([[True], name[1:] != name[:-1]])
        number = np.empty(len(order), np.int32)
        number[order] = np.cumsum(new, dtype=np.int32) - 1
        return name[new], order[new], number


def _cuts(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Buckets (the top bits) of sorted keys."""
    if len(keys):
        bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
        at = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(keys)]])
        yield from ((int(bucket[a]), slice(a, b)) for a, b in zip(at, at[1:], strict=False))


_ASK = "kind int, bucket long, chunk long, keys binary, a binary, b binary"
_ANSWER = "kind int, bucket long, chunk long, a binary, stats array<long>"


def _asks(made: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(made, columns=["kind", "bucket", "chunk", "keys", "a", "b"])


def _count(rows: pd.DataFrame) -> pd.DataFrame:
    """Adds up the counts of a bucket and answers each chunk: twice the sum, plus one for the first chunk that asked."""
    rows = rows.sort_values("chunk")
    keys = [_unkeys(k) for k in rows["keys"]]
    counts = np.concatenate([_unpack(a) for a in rows["a"]])
    distinct, first, number = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    total = np.bincount(number, counts, len(distinct)).astype(np.int64)
    answer = total[number] * 2
    answer[first] += 1
    ends = np.cumsum([len(k) for k in keys])
    kind, bucket = rows["kind"].iloc[0], rows["bucket"].iloc[0]
    stats = [int(total.sum()), int((total > 0).sum()), *np.bincount(np.minimum(total, GT_MOST + 2), minlength=GT_MOST + 3)[1 : GT_MOST + 2].tolist()]
    out = [(kind, bucket, chunk, _pack(answer[b - len(k) : b]), None) for chunk, k, b in zip(rows["chunk"], keys, ends, strict=True)]
    return pd.DataFrame([*out, (kind, bucket, -1, b"", stats)], columns=["kind", "bucket", "chunk", "a", "stats"])


def _backoff(rows: pd.DataFrame, model: Model) -> pd.DataFrame:
    """Adds up what is known of a bucket's histories and answers each chunk with alpha and s.

    Of each history: its count, its followers by their number of times after it (1 to 5), its followers by
    their count (1 to 5), and the summed counts of its other followers. All are integers, so the order of
    the sum does not matter; the mass that is seen and the mass that backs off follow from them.
    """
    rows = rows.sort_values("chunk")
    keys = [_unkeys(k) for k in rows["keys"]]
    c = np.concatenate([_unpack(b) for b in rows["b"]])
    sums = np.concatenate([_unpack(a).reshape(2 * GT_MOST + 1, -1) for a in rows["a"]], axis=1)
    distinct, first, number = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    sums = np.stack([np.bincount(number, s, len(distinct)) for s in sums])
    c, r = c[first].astype(np.float64), np.arange(1, GT_MOST + 1)
    seen = np.where(c > 0, 1.0 - ((1 - model.d2[1 : GT_MOST + 1]) * r) @ sums[:GT_MOST] / np.maximum(c, 1), 0.0)
    low = model.rest * ((model.d1[1 : GT_MOST + 1] * r) @ sums[GT_MOST:-1] + sums[-1]) / max(model.tokens, 1)
    free, scale = 1.0 - seen, np.ones(len(distinct))
    full = (c > 0) & (free < 1e-9)
    scale[full] = c[full] / (c[full] + 1.0) / seen[full]
    free[full] = 1.0 / (c[full] + 1.0)
    alpha = np.where(c > 0, free / np.maximum(1.0 - low, 1e-300), 1.0)
    answer = np.column_stack([alpha, scale])[number]
    ends = np.cumsum([len(k) for k in keys])
    return pd.DataFrame([(3, rows["bucket"].iloc[0], chunk, _pack(answer[b - len(k) : b].reshape(-1)), None) for chunk, k, b in zip(rows["chunk"], keys, ends, strict=True)], columns=["kind", "bucket", "chunk", "a", "stats"])


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing discounts of the counts 0 to GT_MOST + 1 (the last: none); n[r - 1]: the n-grams seen r times."""
    d = np.ones(GT_MOST + 2)
    tail = (GT_MOST + 1) * n[GT_MOST] / n[0] if n[0] else 1.0
    for r in range(1, GT_MOST + 1):
        star = (r + 1) * n[r] / n[r - 1] / r if n[r - 1] else 0.0
        value = (star - tail) / (1 - tail) if tail < 1 else 0.0
        d[r] = value if 0 < value < 1 else (r - 0.5) / r  # too few data for Good-Turing: an absolute discount
    return d


class Model:
    """Sums over the corpus: tokens N, words V, discounts of both orders, probability of the unknown word."""

    def __init__(self, stats: dict[int, list[int]]):
        self.tokens, self.vocab, *ones = stats.get(1) or [0] * (GT_MOST + 3)
        self.d1 = discounts(ones)
        self.d2 = discounts((stats.get(2) or [0] * (GT_MOST + 3))[2:])
        taken = sum((1 - self.d1[r]) * r * ones[r - 1] for r in range(1, GT_MOST + 1))
        self.unknown = max(taken, 0.5) / self.tokens if self.tokens else 1.0
        self.rest = (1.0 - self.unknown) / (1.0 - taken / self.tokens) if self.tokens else 1.0  # 1 unless no count is small

    def word(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.rest * self.d1[np.minimum(c, GT_MOST + 1)] * c / max(self.tokens, 1), self.unknown)

    def seen(self, c: np.ndarray, before: np.ndarray) -> np.ndarray:
        return self.d2[np.minimum(c, GT_MOST + 1)] * c / np.maximum(before, 1)


def _open(own: pd.DataFrame, answers: pd.DataFrame) -> tuple:
    """A chunk with its answers: counts of its words (and of the start), its bigrams, their answers; alpha and s if there."""
    r = own.iloc[0]
    chunk = _Chunk(r["held"], r["counts"], r["tokens"], r["vocab"])
    answers = answers.sort_values("bucket")
    got = {k: np.concatenate([_unpack(a) for a in answers["a"][answers["kind"] == k]]) for k in answers["kind"].unique()}
    words = np.zeros(len(chunk.vocab) + 1, np.int64)
    words[chunk.by_hash] = got[1] >> 1
    words[-1] = words[int(np.flatnonzero(chunk.vocab == END)[0])]  # as many starts as ends
    back = None
    if 3 in got:
        back = np.empty((len(words), 2))
        back[np.argsort(chunk.names)] = got[3].reshape(-1, 2)
    return int(r["chunk"]), chunk, words, chunk.bigrams(), got[2], back


def score(docs: DataFrame, held: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of each document; `held` marks those not learnt from."""
    spark = docs.sparkSession
    tokens = materialize(chunks(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(held, F.lit(False)).alias("held"))), "chunks")
    size = tokens.agg(F.sum(F.length("tokens"))).first()[0] or 0
    bits = 8
    while (size >> bits) > BUCKET_TOKENS:
        bits += 1
    rest = ["chunk", "held", "counts", "tokens", "vocab"]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                own, made = _Chunk(r.held, r.counts, r.tokens, r.vocab), []
                words = own.vocab[own.by_hash]
                n = np.bincount(own.words[own.train], minlength=len(own.vocab))[own.by_hash]
                made += [(1, b, r.chunk, _keys(words[s]), _pack(n[s]), None) for b, s in _cuts(words, bits)]
                keys, _, number = own.bigrams()
                n = np.bincount(number[own.train], minlength=len(keys))
                made += [(2, b, r.chunk, _keys(keys[s]), _pack(n[s]), None) for b, s in _cuts(keys, bits)]
                yield _asks(made)

    asked = tokens.select(*rest).mapInPandas(ask, _ASK)
    counted = materialize(asked.groupBy("kind", "bucket").applyInPandas(_count, _ANSWER), "counts")
    sums = counted.filter("chunk = -1").select("kind", F.posexplode("stats")).groupBy("kind", "pos").agg(F.sum("col").alias("n")).collect()
    stats: dict[int, list[int]] = {k: [0] * (GT_MOST + 3) for k in (1, 2)}
    for r in sums:
        stats[r["kind"]][r["pos"]] = int(r["n"])
    model = Model(stats)
    answers = counted.filter("chunk >= 0").select("kind", "bucket", "chunk", "a")

    def histories(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        number, chunk, words, (_, place, _), answer, _ = _open(own, got)
        c = answer >> 1
        mine = np.flatnonzero((answer & 1 == 1) & (c > 0))
        h, w = chunk.before[place[mine]], words[chunk.words[place[mine]]]
        many = w > GT_MOST
        sums = [np.bincount(h[c[mine] == r], minlength=len(words)) for r in range(1, GT_MOST + 1)]
        sums += [np.bincount(h[w == r], minlength=len(words)) for r in range(1, GT_MOST + 1)] + [np.bincount(h[many], w[many], len(words)).astype(np.int64)]
        order = np.argsort(chunk.names)
        keys, sums, n = chunk.names[order], np.stack(sums)[:, order], words[order]
        return _asks([(3, b, number, _keys(keys[s]), _pack(sums[:, s].reshape(-1)), _pack(n[s])) for b, s in _cuts(keys, bits)])

    grouped = tokens.groupBy("chunk")
    backoff = grouped.cogroup(answers.groupBy("chunk")).applyInPandas(histories, _ASK).groupBy("bucket").applyInPandas(lambda rows: _backoff(rows, model), _ANSWER).select("kind", "bucket", "chunk", "a")
    key_type = tokens.schema["keys"].dataType.elementType
    schema = T.StructType([T.StructField(key, key_type), T.StructField("held_out", T.BooleanType()), *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(n, T.DoubleType()) for n in ("base_score", "score"))])

    def final(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        _, chunk, words, (_, _, number), answer, back = _open(own, got)
        c = (answer >> 1)[number]
        h, known = chunk.before, words[chunk.words]
        p = np.where(c > 0, back[h, 1] * model.seen(c, words[h]), back[h, 0] * model.word(known))
        doc = np.repeat(np.arange(len(chunk.counts)), chunk.counts)
        add = lambda x: np.bincount(doc, x, len(chunk.counts))
        base = np.log10((known + 1) / (model.tokens + model.vocab + 1))
        return pd.DataFrame({key: list(own.iloc[0]["keys"]), "held_out": chunk.held, "n_tokens": chunk.counts, "n_known": add(known > 0).astype(np.int64), "train_tokens": model.tokens, "base_score": add(base), "score": add(np.log10(p))})

    return grouped.cogroup(answers.unionByName(backoff).groupBy("chunk")).applyInPandas(final, schema)
