"""BPE encoding and decoding by batched numpy merge rounds.

The distinct pre-tokens of a batch become one flat array of symbols. Each round looks every adjacent
pair up by binary search over the sorted pair keys, takes the lowest rank of each word, merges all its
occurrences from left to right and drops finished words, until no word has a known pair. Long pre-tokens
would search all their symbols once for each rank that they hold: their rounds keep the places of every
rank and search only the pairs next to a merge, so a text of megabytes without a blank takes seconds.

Defined cases: a null text is an empty text; an empty text has no ids, whose digest is that of the
empty string; text of any length is encoded whole; a special token's string in a text becomes its id,
as the tokenizers library does; rows repeat as often as they come; columns besides those asked for
are ignored by `digest` and kept by `encode` and `decode` (a clash of output names raises ValueError).
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ragged, text_steps
from .pretoken import PATTERN, byte_chars

#: Bytes from which a pre-token's rounds keep the places of each rank; only speed depends on it.
LONG = 256
#: Distinct pre-tokens that a worker remembers before it starts afresh.
CACHE_WORDS = 300_000


class _Index(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        at = self[key] = len(self)
        return at


class Codec:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        chars = byte_chars()
        byte_of = {c: b for b, c in enumerate(chars)}
        self.byte_id = np.array([vocab[c] for c in chars], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.special = added
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.words = regex.compile(PATTERN).findall
        n = max([*vocab.values(), *added.values()]) + 1
        pieces = [b""] * n
        for token, i in vocab.items():
            pieces[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token, i in added.items():
            pieces[i] = token.encode()
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_raw = np.frombuffer(b"".join(pieces), np.uint8)
        self._fresh()

    def _fresh(self) -> None:
        self.index, self.csv = _Index(), []
        self.store, self.at, self.size, self.used = np.empty(1 << 16, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), 0

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, len(self.ranks) where there is none."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.ranks))

    def merge_long(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What rounds leave of the symbols (and their words), lowest rank of all words first: words do not touch each other."""
        n, none = len(sym), len(self.ranks)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n + 1, none, np.int64)  # of the pair that begins at a place; the place n stands for no symbol
        rank[: n - 1] = np.where(word[:-1] == word[1:], self.ranks_of(sym[:-1], sym[1:]), none)
        order = np.argsort(rank[:n], kind="stable")
        order = order[: np.searchsorted(rank[order], none)]
        first, starts = np.unique(rank[order], return_index=True)
        begun = dict(zip(first.tolist(), np.split(order, starts[1:]), strict=False))
        later: dict[int, list[int]] = defaultdict(list)
        open_ = first.tolist()
        after, before, live = np.append(after, n), np.append(before, -1), np.ones(n + 1, bool)
        sym, word = np.append(sym, 0), np.append(word, -1)
        while open_:
            low = heapq.heappop(open_)
            left = np.unique(np.concatenate([begun.pop(low, order[:0]), np.array(later.pop(low, ()), np.int64)]))
            left = left[rank[left] == low]
            if not len(left):
                continue
            clash = after[left[:-1]] == left[1:]
            if clash.any():  # a pair of equal symbols overlaps itself: every second one counts
                i = np.arange(len(left))
                head = np.append(True, ~clash)
                left = left[((i - np.maximum.accumulate(np.where(head, i, 0))) & 1) == 0]
            right = after[left]
            sym[left] = self.merged[low]
            live[right], rank[right] = False, none
            after[left] = after[right]
            before[after[left]] = left
            back = before[left]
            near = np.unique(np.concatenate([left, back[back >= 0]]))
            to = after[near]
            now = np.where(word[near] == word[to], self.ranks_of(sym[near], sym[to]), none)
            rank[near] = now
            known = now < none
            for r, at in zip(now[known].tolist(), near[known].tolist(), strict=True):
                if r not in later and r not in begun:
                    heapq.heappush(open_, r)
                later[r].append(at)
        return sym[:n][live[:n]], word[:n][live[:n]]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and the number of ids of each word."""
        lens = np.array([len(w) for w in words], np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int64), lens)
        done_sym, done_word = [], []
        none = len(self.ranks)
        long = np.repeat(lens >= LONG, lens)
        if long.any():
            found = self.merge_long(sym[long], word[long])
            done_sym.append(found[0])
            done_word.append(found[1])
            sym, word = sym[~long], word[~long]
        while len(sym):
            rank = np.full(len(sym), none, np.int64)
            rank[:-1] = np.where(word[:-1] == word[1:], self.ranks_of(sym[:-1], sym[1:]), none)
            new = np.empty(len(sym), bool)
            new[0], new[1:] = True, word[1:] != word[:-1]
            group = np.cumsum(new) - 1
            low = np.minimum.reduceat(rank, np.flatnonzero(new))[group]
            over = low == none
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                live = ~over
                sym, word, rank, low = sym[live], word[live], rank[live], low[live]
                if not len(sym):
                    break
            take = rank == low
            clash = take[1:] & take[:-1]
            if clash.any():  # a pair of equal symbols overlaps itself: every second one counts
                i = np.arange(len(take))
                head = take.copy()
                head[1:] &= ~take[:-1]
                take &= ((i - np.maximum.accumulate(np.where(head, i, 0))) & 1) == 0
            left = np.flatnonzero(take)
            sym[left] = self.merged[rank[left]]
            keep = np.ones(len(sym), bool)
            keep[left + 1] = False
            sym, word = sym[keep], word[keep]
        sym, word = np.concatenate(done_sym or [sym]), np.concatenate(done_word or [word])
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.bincount(word, minlength=len(words)).astype(np.int64)

    def pretokens(self, text: str) -> list[str]:
        if self.split_special is None or not any(s in text for s in self.special):
            return self.words(text)
        out: list[str] = []
        for part in self.split_special.split(text):
            out += [part] if part in self.special else self.words(part)
        return out

    def _learn(self, known: int) -> None:
        new = [w for w in list(self.index)[known:]]
        ids, lens = self.merge([b"" if w in self.special else w.encode() for w in new])
        if self.special:
            for k, w in enumerate(new):
                if w in self.special:
                    ids, lens[k] = np.insert(ids, int(lens[:k].sum()), self.special[w]), 1
        need = self.used + len(ids)
        if need > len(self.store):
            self.store = np.concatenate([self.store[: self.used], np.empty(max(need, 2 * len(self.store)) - self.used, np.int32)])
        self.store[self.used : need] = ids
        at = self.used + np.cumsum(lens) - lens
        self.at, self.size, self.used = np.concatenate([self.at, at]), np.concatenate([self.size, lens]), need
        text = list(map(str, ids.tolist()))
        ends = np.cumsum(lens).tolist()
        self.csv += [",".join(text[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """Ids of all texts in a row, the number of ids of each text, and the numbers of its pre-tokens."""
        if len(self.index) > CACHE_WORDS:
            self._fresh()
        known = len(self.index)
        parts = [list(map(self.index.__getitem__, self.pretokens(t))) for t in texts]
        if len(self.index) > known:
            self._learn(known)
        flat = np.array([i for p in parts for i in p], np.int64)
        lens = self.size[flat]
        ends = np.cumsum([len(p) for p in parts])
        total = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], ends]).astype(np.int64)]
        return self.store[ragged(self.at[flat], lens)], np.diff(total), parts

    def csv_of(self, part: list[int]) -> str:
        return ",".join(map(self.csv.__getitem__, part))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The decoded texts in UTF-8; bytes that are not UTF-8 become replacement characters. Unknown ids are dropped."""
        ids = ids.astype(np.int64)
        ok = (ids >= 0) & (ids < len(self.piece_len))
        ids = np.where(ok, ids, 0)
        lens = np.where(ok, self.piece_len[ids], 0)
        raw = self.piece_raw[ragged(self.piece_at[ids], lens)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)].tolist()
        out = []
        for a, b in zip(ends, ends[1:], strict=False):
            piece = raw[a:b]
            try:
                piece.decode()
            except UnicodeDecodeError:
                piece = piece.decode("utf-8", "replace").encode()
            out.append(piece)
        return out


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _new_columns(df: DataFrame, *names: str) -> None:
    if clash := {*names} & {*df.columns}:
        raise ValueError(f"columns exist already: {sorted(clash)}")


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids (array<int>) of each text."""
    _new_columns(df, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for rows, col in text_steps(batches, text):
            flat, counts, _ = own.encode(col.to_pylist())
            offs = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], [*rows.schema.names, ids])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text that each array of ids stands for (null ids: empty)."""
    _new_columns(df, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                lists = [x or [] for x in rows.column(rows.schema.get_field_index(ids)).to_pylist()]
                flat = np.array([-1 if i is None else i for x in lists for i in x], np.int64)
                out = own.decode(flat, np.array([len(x) for x in lists], np.int64))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([x.decode() for x in out], pa.string())], [*rows.schema.names, text])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(text, T.StringType())]))


def digest(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, then decode from the ids: key, n_tokens, ids_sha256, decoded_sha256 (one pass, nothing is shuffled)."""
    df = df.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for rows, col in text_steps(batches, text):
            flat, counts, parts = own.encode(col.to_pylist())
            ids = [hashlib.sha256(own.csv_of(p).encode()).hexdigest() for p in parts]
            back = [hashlib.sha256(x).hexdigest() for x in own.decode(flat, counts)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.mapInArrow(run, T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))
