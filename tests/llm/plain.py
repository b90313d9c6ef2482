"""Plain, single-process versions of the operators, for comparison on small inputs."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import regex


def suffix_dedup(docs: list[tuple[object, str | None]], length: int = 200) -> list[tuple]:
    """(key, n_bytes, n_removed, n_spans, kept_sha256)."""
    raws = [(k, (t or "").encode()) for k, t in docs]
    seen: Counter = Counter()
    for _, r in raws:
        seen.update(r[i : i + length] for i in range(len(r) - length + 1))
    out = []
    for k, r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((k, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _discounts(n: list[int], most: int = 5) -> list[float]:
    d = [1.0] * (most + 2)
    tail = (most + 1) * n[most] / n[0] if n[0] else 1.0
    for r in range(1, most + 1):
        star = (r + 1) * n[r] / n[r - 1] / r if n[r - 1] else 0.0
        v = (star - tail) / (1 - tail) if tail < 1 else 0.0
        d[r] = v if 0 < v < 1 else (r - 0.5) / r
    return d


class Katz:
    """The bigram model over dictionaries."""

    def __init__(self, texts: list[str | None]):
        self.uni, self.bi = Counter(), Counter()
        for t in texts:
            toks = [*(t or "").encode().lower().split(), None]
            self.uni.update(toks)
            self.bi.update(zip([0, *toks], toks, strict=False))
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        of = lambda c: [sum(1 for x in c.values() if x == r) for r in range(1, 7)]
        ones = of(self.uni)
        self.d1, self.d2 = _discounts(ones), _discounts(of(self.bi))
        taken = sum((1 - self.d1[r]) * r * ones[r - 1] for r in range(1, 6))
        self.unk = max(taken, 0.5) / self.n if self.n else 1.0
        self.rest = (1 - self.unk) / (1 - taken / self.n) if self.n else 1.0
        self.follow = defaultdict(list)
        for (h, w), c in self.bi.items():
            self.follow[h].append((w, c))

    def history(self, h: object) -> int:
        return self.uni[None] if h == 0 else self.uni[h]

    def word(self, w: object) -> float:
        c = self.uni[w]
        return self.rest * self.d1[min(c, 6)] * c / self.n if c else self.unk

    def backoff(self, h: object) -> tuple[float, float]:
        c = self.history(h)
        if not c:
            return 1.0, 1.0
        seen = sum(self.d2[min(k, 6)] * k / c for _, k in self.follow[h])
        low = sum(self.word(w) for w, _ in self.follow[h])
        if 1 - seen < 1e-9:
            return 1 / (c + 1) / (1 - low), c / (c + 1) / seen
        return (1 - seen) / (1 - low), 1.0

    def prob(self, w: object, h: object) -> float:
        alpha, scale = self.backoff(h)
        c = self.bi[h, w]
        return scale * self.d2[min(c, 6)] * c / self.history(h) if c else alpha * self.word(w)

    def score(self, text: str | None) -> tuple[int, int, float, float]:
        toks = [*(text or "").encode().lower().split(), None]
        base = sum(math.log10((self.uni[w] + 1) / (self.n + self.v + 1)) for w in toks)
        return len(toks), sum(self.uni[w] > 0 for w in toks), base, sum(math.log10(self.prob(w, h)) for h, w in zip([0, *toks], toks, strict=False))


def token_rows(docs: list[tuple[int, str | None]], encode, end: int = 0) -> list[tuple]:
    """(key, start, n_tokens, ids_crc32)."""
    out, start = [], 0
    for k, t in sorted(docs, key=lambda d: d[0]):
        ids = [*encode(t or ""), end]
        out.append((k, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


class WordFirst:
    """Word-first backoff over dictionaries."""

    def __init__(self, labelled: list[tuple[str, str]]):
        self.counts = [defaultdict(Counter) for _ in range(6)]  # by size (0: whole words): gram -> language -> n
        for text, lang in labelled:
            for w in self.words(text):
                self.counts[0][w][lang] += 1
                for n in range(1, 6):
                    for g in self.grams(w, n):
                        self.counts[n][g][lang] += 1
        self.langs = sorted({lang for _, lang in labelled})
        self.totals = [{y: sum(c[y] for c in own.values()) for y in self.langs} for own in self.counts]

    @staticmethod
    def words(text: str) -> list[str]:
        return regex.findall(r"\p{L}+", text.lower())

    @staticmethod
    def grams(word: str, n: int) -> list[str]:
        word = f"<{word}>" if n > 1 else word
        return [word[i : i + n] for i in range(len(word) - n + 1)]

    def log(self, n: int, gram: str, lang: str) -> float:
        return math.log((self.counts[n][gram][lang] + 0.05) / (self.totals[n][lang] + 0.05 * (len(self.counts[n]) + 1)))

    def predict(self, text: str) -> tuple[str, float, bool]:
        words, known = self.words(text), False
        if not words:
            return "und", 0.0, False
        total = dict.fromkeys(self.langs, 0.0)
        for w in words:
            size, found = 0, [w] if w in self.counts[0] else []
            for size in [] if found else range(5, 0, -1):
                found = [g for g in self.grams(w, size) if g in self.counts[size]]
                if found:
                    break
            known |= bool(found)
            for y in self.langs if found else ():
                total[y] += sum(self.log(size, g, y) for g in found) / len(found)
        best = max(self.langs, key=lambda y: (total[y], -self.langs.index(y)))
        return best, 1 / sum(math.exp((total[y] - total[best]) * min(len(words), 20) / len(words)) for y in self.langs), known
