"""Colour expressions over packed 24-bit integers; all stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = 0xFFFFFF
#: Position and RGB of each gradient's stops.
GRADIENTS = {
    "viridis": [(0.0, (68, 1, 84)), (0.25, (59, 82, 139)), (0.5, (33, 145, 140)), (0.75, (94, 201, 97)), (1.0, (253, 231, 37))],
    "jet": [(0.0, (0, 0, 131)), (0.35, (0, 255, 255)), (0.5, (255, 255, 0)), (0.75, (255, 0, 0)), (1.0, (128, 0, 0))],
    "grayscale": [(0.0, (0, 0, 0)), (1.0, (255, 255, 255))],
    "magma": [(0.0, (0, 0, 4)), (0.25, (78, 18, 123)), (0.5, (187, 55, 84)), (0.75, (249, 142, 8)), (1.0, (251, 252, 191))],
}
#: Labels of gradients; key, label, needs a gradient, needs a single colour of each mode.
GRADIENT_LABELS = {"viridis": "Viridis", "jet": "Jet", "grayscale": "Grayscale", "magma": "Magma"}
MODES = [
    ("original", "Original (PLY)", False, False),
    ("height", "By Height", True, False),
    ("intensity", "By Intensity", True, False),
    ("single", "Single Color", False, True),
    ("random", "Random", False, False),
    ("rgb_xyz", "RGB by XYZ", False, False),
]
#: The linear congruential generator and the FNV-1a hash that seeds it.
LCG_MUL, LCG_ADD = 1664525, 1013904223
FNV_BASE, FNV_PRIME = 0x811C9DC5, 0x01000193
LUT_SIZE = 256


def half_away(v: float) -> int:
    return int(v + 0.5) if v >= 0 else -int(0.5 - v)


def pack(r: Column, g: Column, b: Column) -> Column:
    """Channels modulo 256 in one integer; null if any is null; fractions are cut off."""
    r, g, b = (c.cast("long").bitwiseAND(255) for c in (r, g, b))
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def unpack(v: Column) -> tuple[Column, Column, Column]:
    v = v.cast("long").bitwiseAND(WHITE)
    return F.shiftright(v, 16).bitwiseAND(255), F.shiftright(v, 8).bitwiseAND(255), v.bitwiseAND(255)


def to_hex(v: Column) -> Column:
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex(v.cast("long").bitwiseAND(WHITE))), 6, "0"))


def from_hex(s: Column) -> Column:
    """#rrggbb or rrggbb to packed; anything else is white."""
    t = F.lower(F.trim(s))
    return F.when(t.rlike("^#?[0-9a-f]{6}$"), F.conv(F.regexp_replace(t, "^#", ""), 16, 10).cast("long")).otherwise(F.lit(WHITE))


def mode_of(name: str | None) -> str:
    key = (name or "original").strip().lower()
    return key if key in {m[0] for m in MODES} else "original"


def gradient_of(name: str | None) -> str:
    key = (name or "viridis").strip().lower()
    return key if key in GRADIENTS else "viridis"


def lut(name: str = "viridis") -> list[int]:
    """The 256 packed colours of a gradient, piecewise linear between its stops."""
    stops = GRADIENTS[gradient_of(name)]
    out = []
    for i in range(LUT_SIZE):
        t = i / (LUT_SIZE - 1)
        k = next((j for j, s in enumerate(stops) if t <= s[0]), len(stops) - 1)
        (p0, c0), (p1, c1) = stops[max(k - 1, 0)], stops[k]
        w = (t - p0) / (p1 - p0) if p1 > p0 else 0.0
        r, g, b = (half_away(a + (e - a) * w) for a, e in zip(c0, c1, strict=True))
        out.append(r << 16 | g << 8 | b)
    return out


def gradient(t: Column, name: str = "viridis") -> Column:
    """Packed colour at t (clamped to 0..1; null counts as 0), interpolated between two entries of the table."""
    colors = F.array(*map(F.lit, lut(name)))
    t = F.least(F.greatest(F.coalesce(F.nanvl(t, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * (LUT_SIZE - 1)
    k = F.floor(t).cast("int")
    low, high = F.element_at(colors, k + 1).cast("long"), F.element_at(colors, F.least(k + 2, F.lit(LUT_SIZE))).cast("long")
    w = t - k
    mixed = [F.round(a + (b - a) * w) for a, b in zip(unpack(low), unpack(high), strict=True)]
    return F.when(w < 2.220446049250313e-16, low).otherwise(pack(*mixed))


def normalized(v: Column, low: float | None, high: float | None, missing: float = 0.5) -> Column:
    """v in 0..1 of its range; 0.5 where the range is empty or v is null, `missing` without a range."""
    if low is None or high is None:
        return F.lit(missing)
    if abs(high - low) < 2.220446049250313e-16:
        return F.lit(0.5)
    return F.coalesce(F.least(F.greatest((v - F.lit(low)) / F.lit(high - low), F.lit(0.0)), F.lit(1.0)), F.lit(0.5))


def rgb_xyz(x: Column, y: Column, z: Column) -> Column:
    """Normalised coordinates as channels."""
    return pack(*(F.round(c * 255) for c in (x, y, z)))


def fnv1a(name: str) -> int:
    return reduce(lambda h, b: ((h ^ b) * FNV_PRIME) & 0xFFFFFFFF, name.encode(), FNV_BASE)


def fnv1a_of(name: Column) -> Column:
    """fnv1a of a column: a fold over the bytes; null counts as an empty text."""
    pairs = F.regexp_extract_all(F.hex(F.encode(F.coalesce(name, F.lit("")), "UTF-8")), F.lit(".."), F.lit(0))
    step = lambda h, b: (h.bitwiseXOR(F.conv(b, 16, 10).cast("long")) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.aggregate(pairs, F.lit(FNV_BASE).cast("long"), step)


def jumps(bits: int = 40, modulus: int = 1 << 24) -> list[tuple[int, int]]:
    """(multiplier, addend) of 1, 2, 4, ... steps of the generator."""
    a, c, out = LCG_MUL % modulus, LCG_ADD % modulus, []
    for _ in range(bits):
        out.append((a, c))
        a, c = a * a % modulus, (a * c + c) % modulus
    return out


def _digits(a: int, c: int, base: int = 16, modulus: int = 1 << 24) -> tuple[list[int], list[int]]:
    """Multipliers and addends of 0, 1, ... base - 1 jumps of one length."""
    steps = [(1, 0)]
    while len(steps) < base:
        m, k = steps[-1]
        steps.append((m * a % modulus, (k * a + c) % modulus))
    return [m for m, _ in steps], [k for _, k in steps]


def random_color(idx: Column, seed: int) -> Column:
    """The colour after idx + 1 steps of the generator, by jumps: no row waits for another. Only 24 bits of the state show, and they return after 2^24 steps."""
    state = F.lit(seed % (1 << 24)).cast("long")
    for k, (a, c) in enumerate(jumps(24)[::4]):
        digit = F.shiftright(idx + 1, 4 * k).bitwiseAND(15).cast("int") + 1
        by, plus = (F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), digit) for values in _digits(a, c))
        state = (state * by + plus) % (1 << 24)  # names the state once: the expression stays linear and shallow
    return pack(*(F.round(ch / 2.0 + 64) for ch in unpack(state)))
