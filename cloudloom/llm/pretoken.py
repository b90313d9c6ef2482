"""Pre-tokens of byte-level BPE, found for many texts at once.

The published pattern splits a text into contractions, runs of letters, numbers or other characters (each
with one blank before it) and runs of white space. All but contractions follow from the class of each
character, so the starts of all pre-tokens come from a few array operations over the code points.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

#: Fixed value: the published pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, OTHER, SPACE = range(4)
_BLANK, _QUOTE = 32, 39


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(every)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, text):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a : b + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


def spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets (in the UTF-8 of all texts in a row) where pre-tokens start and end, and per text the number of pre-tokens before its end."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    n = len(points)
    bounds = np.cumsum([0, *map(len, texts)])
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    kind = classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    run = edge[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    after_blank = np.zeros(n, bool)
    after_blank[1:] = (points[:-1] == _BLANK) & ~edge[1:-1]
    start = run & (space | ~after_blank)
    # the last white space before something else stands alone or, if it is a blank, joins it
    start[:-1] |= space[:-1] & run[1:] & ~space[1:] & ~edge[1:-1]
    # contractions: a quote on its own that no blank precedes, and letters after it
    quote = np.flatnonzero((points == _QUOTE) & run & ~after_blank)
    quote = quote[quote + 1 < n]
    quote = quote[run[quote + 1] & ~edge[quote + 1] & (kind[quote + 1] == LETTER)]
    if len(quote):
        first = points[quote + 1]
        far = np.minimum(quote + 2, n - 1)
        second = np.where((quote + 2 < n) & ~edge[far] & ~run[far], points[far], 0)
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            two |= (first == ord(a)) & (second == ord(b))
        for hit, size in ((one, 2), (two & ~one, 3)):
            at = quote[hit]
            start[at + 1] = False
            end = at + size
            inside = end[end < n]
            inside = inside[~edge[inside] & ~run[inside]]
            start[inside] = True
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    byte = np.concatenate([[0], np.cumsum(width)])
    at = np.flatnonzero(start)
    begin = byte[at]
    return begin, np.append(begin[1:], byte[n]), np.searchsorted(at, bounds[1:])
