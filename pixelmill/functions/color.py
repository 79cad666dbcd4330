"""Colour arithmetic as Column expressions: everything stays in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CHROMA_IN, CHROMA_OUT, DESPILL_BAND, DESPILL_SCALE, NEAR_CHANNEL


def _d(value: float) -> Column:
    return F.lit(float(value))


def luma(r: Column, g: Column, b: Column) -> Column:
    return _d(0.299) * r + _d(0.587) * g + _d(0.114) * b


def ycc(r: Column, g: Column, b: Column) -> Column:
    """struct(y, cb, cr) in double, chroma centred at 128."""
    y = luma(r, g, b)
    return F.struct(y.alias("y"), ((b - y) * _d(0.564) + _d(128)).alias("cb"), ((r - y) * _d(0.713) + _d(128)).alias("cr"))


def u8(value: Column) -> Column:
    """Clamped to 0..255 and rounded half up."""
    return F.floor(F.least(_d(255), F.greatest(_d(0), value)) + _d(0.5)).cast("int")


def rgb(y: Column, cb: Column, cr: Column) -> Column:
    """struct(r, g, b) of a y, cb, cr colour."""
    return F.struct(
        u8(y + _d(1.402) * (cr - 128)).alias("r"), u8(y - _d(0.344136) * (cb - 128) - _d(0.714136) * (cr - 128)).alias("g"), u8(y + _d(1.772) * (cb - 128)).alias("b")
    )


def smoothstep(low: float, high: float, x: Column) -> Column:
    """Hermite step from 0 to 1; 0 where the edges do not rise."""
    if high <= low:
        return _d(0)
    t = F.least(_d(1), F.greatest(_d(0), (x - _d(low)) / _d(high - low)))
    return t * t * (_d(3) - _d(2) * t)


def chroma_distance(colour: Column, key: Column) -> Column:
    return F.hypot(colour["cb"] - key["cb"], colour["cr"] - key["cr"])


def matte_alpha(a: Column, distance: Column) -> Column:
    """Alpha after the soft ramp; truncated, not rounded."""
    return F.floor(a.cast("double") * smoothstep(CHROMA_IN, CHROMA_OUT, distance)).cast("int")


def despilled_chroma(colour: Column, key: Column, distance: Column) -> tuple[Column, Column]:
    """(cb, cr) with the key's tint taken out near the key; where there is none to take is the caller's to tell."""
    kb, kr = key["cb"] - 128, key["cr"] - 128
    length = F.hypot(kb, kr)
    pb, pr = colour["cb"] - 128, colour["cr"] - 128
    along = (pb * kb + pr * kr) / length
    weight = smoothstep(0, 1, (_d(DESPILL_BAND) - distance) / _d(DESPILL_BAND)) * _d(DESPILL_SCALE)
    return _d(128) + (pb - kb / length * along * weight), _d(128) + (pr - kr / length * along * weight)


def spills(colour: Column, key: Column, distance: Column) -> Column:
    """Whether ``despilled_chroma`` applies."""
    kb, kr = key["cb"] - 128, key["cr"] - 128
    return (F.hypot(kb, kr) > 1) & (distance < DESPILL_BAND) & ((colour["cb"] - 128) * kb + (colour["cr"] - 128) * kr > 0)


def is_magenta(r: Column, g: Column, b: Column) -> Column:
    return (r > 150) & (b > 150) & (g < 120)


def rgb_distance(r: Column, g: Column, b: Column, key: tuple[int, int, int]) -> Column:
    return F.sqrt(sum(((c - k).cast("double") * (c - k) for c, k in zip((r, g, b), key, strict=True)), _d(0)))


def key_tinted(r: Column, g: Column, b: Column, key: tuple[int, int, int]) -> Column:
    """Channels high in the key are high, channels low in it are low; middling ones say nothing."""
    tests = [c > 150 if k > 192 else c < 110 for c, k in zip((r, g, b), key, strict=True) if k > 192 or k < 64]
    return reduce(lambda a, t: a & t, tests, F.lit(True))


def near_rgb(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, t: x & t, [F.abs(p - q) <= NEAR_CHANNEL for p, q in zip(a, b, strict=True)])


def weighted_distance(a: list[Column], b: list[Column]) -> Column:
    """2, 4 and 3 times the squared differences of r, g and b (integers)."""
    return sum((w * (p - q) * (p - q) for w, p, q in zip((2, 4, 3), a, b, strict=True)), F.lit(0))


def blend(under: Column, over: Column, alpha: int) -> Column:
    """Integer blend at a fixed alpha."""
    return F.floor((under * (255 - alpha) + over * alpha) / 255).cast("int")


def hist_bin(r: Column, g: Column, b: Column) -> Column:
    """One of 64 bins: two bits a channel."""
    return F.shiftleft(F.shiftright(r, 6), 4) + F.shiftleft(F.shiftright(g, 6), 2) + F.shiftright(b, 6)
