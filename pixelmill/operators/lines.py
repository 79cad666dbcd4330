"""Profiles as arrays, a row an image: what is found on them by position, in small array programs.

A profile is as long as its image is wide. Spark makes and shuffles the profiles; each function here sees one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CUT_LAMBDA, CUT_MIN_SHARE, PEAK_SHARE, RUN_EPS, RUN_MASS, RUN_PEAK, VALLEY_SHARE, WIDE_RATIO

SPAN = T.StructType([T.StructField("x0", T.IntegerType()), T.StructField("x1", T.IntegerType())])


def lines(profile: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keys, pos, mass): each image's places in order and their masses, as arrays."""
    cells = F.array_sort(F.collect_list(F.struct("pos", "mass")))
    return profile.groupBy(*keys).agg(cells.alias("c")).select(*keys, F.col("c.pos").alias("pos"), F.col("c.mass").alias("mass"))


def dense(pos, mass) -> np.ndarray:
    """Masses by place, 0 where a place is missing."""
    pos = np.asarray(pos, dtype=np.int64)
    out = np.zeros(int(pos[-1]) + 1 if len(pos) else 0)
    out[pos] = mass
    return out


def runs_of(mass: np.ndarray, min_width: int, drop_minor: bool = True) -> list[tuple[int, int]]:
    """Stretches above a share of the largest mass, wide and high enough; those of little mass go."""
    top = mass.max(initial=0.0)
    if top <= 0:
        return []
    on = np.concatenate([[False], mass > RUN_EPS * top, [False]])
    edges = np.flatnonzero(on[1:] != on[:-1])
    found = [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= min_width and mass[a:b].max() >= RUN_PEAK * top]
    if not drop_minor:
        return found
    weight = [math.fsum(mass[a:b]) for a, b in found]
    return [run for run, w in zip(found, weight, strict=True) if w >= max(weight) * RUN_MASS]


def _valleys(height: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Of each candidate the lowest mass on the way to the next one to the left that is as high (inf if there is none)."""
    out, stack = np.full(len(height), np.inf), []
    for k, h in enumerate(height.tolist()):
        low = between[k - 1] if k else np.inf
        while stack and stack[-1][0] < h:
            low = min(low, stack.pop()[1])
        if stack:
            out[k] = low
        stack.append((h, low))
    return out


def peaks_of(mass: np.ndarray, x0: int, x1: int) -> list[int]:
    """Prominent local maxima of a run; without one its first candidate, or its middle."""
    part = mass[x0:x1]
    inner = part[1:-1]
    cand = np.flatnonzero((inner >= part[:-2]) & (inner > part[2:]) & (inner >= PEAK_SHARE * part.max())) + 1
    if not len(cand):
        return [(x0 + x1) // 2]
    height = part[cand]
    between = np.array([part[a : b + 1].min() for a, b in zip(cand[:-1], cand[1:], strict=True)])
    shallow = np.zeros(len(cand), dtype=bool)
    for low in (_valleys(height, between), _valleys(height[::-1], between[::-1])[::-1]):
        shallow |= np.isfinite(low) & (low > VALLEY_SHARE * height)
    kept = cand[~shallow] if not shallow.all() else cand[:1]
    return (x0 + kept).tolist()


def counts_of(found: list[tuple[int, int]], peaked: list[list[int]]) -> list[int]:
    """Figures in each run: its peaks, but no more than its width has room for; a wide run of one peak has two."""
    widths = [b - a for a, b in found]
    if len(found) < 2:
        return [len(p) for p in peaked]
    median = sorted(widths)[len(widths) // 2]
    out = []
    for w, p in zip(widths, peaked, strict=True):
        n = min(len(p), max(1, math.floor(w / median + 0.5)))
        out.append(2 if n == 1 and w > median * WIDE_RATIO else n)
    return out


def cuts_of(mass: np.ndarray, x0: int, x1: int, n: int) -> list[int] | None:
    """The cheapest places that part [x0, x1) into n spans, None where there is no room.

    A cut costs the mass there, plus a penalty on uneven widths; of equally cheap ways the leftmost wins.
    """
    ideal = (x1 - x0) / n
    least = max(2, math.floor(ideal * CUT_MIN_SHARE))
    last, cost, chosen = np.array([x0]), np.array([0.0]), []

    def penalty(width: np.ndarray) -> np.ndarray:
        return CUT_LAMBDA * (width - ideal) * (width - ideal)

    for k in range(1, n):
        at = np.arange(x0 + k * least, min(x1 - (n - k) * least, len(mass) - 1) + 1)
        room = np.searchsorted(last, at - least, "right")  # so many of the places before are far enough
        at, room = at[room > 0], room[room > 0]
        if not len(at):
            return None
        best, total = np.zeros(len(at), dtype=np.int64), np.zeros(len(at))
        for i, (here, many) in enumerate(zip(at.tolist(), room.tolist(), strict=True)):
            price = cost[:many] + mass[here] + penalty((here - last[:many]).astype(np.float64))
            best[i] = price.argmin()
            total[i] = price[best[i]]
        chosen.append(best)
        last, cost, before = at, total, last
        chosen[-1] = (before[best], best)
    place = int((cost + penalty((x1 - last).astype(np.float64))).argmin())
    out = [int(last[place])]
    for before, best in reversed(chosen[1:]):
        out.append(int(before[place]))
        place = int(best[place])
    return out[::-1]


def split_of(mass: np.ndarray, parts: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Parts (x0, x1, n) cut into n spans each; evenly where no cut has room."""
    out = []
    for x0, x1, n in parts:
        if n <= 1 or x1 - x0 < n:
            out.append((x0, x1))
            continue
        cuts = cuts_of(mass, x0, x1, n) or [x0 + (x1 - x0) * i // n for i in range(1, n)]
        edges = [x0, *cuts, x1]
        out += list(zip(edges[:-1], edges[1:], strict=True))
    return out


def counted_of(mass: np.ndarray, min_width: int) -> list[tuple[int, int, int]]:
    """Runs with their number of figures."""
    found = runs_of(mass, min_width)
    return [(a, b, n) for (a, b), n in zip(found, counts_of(found, [peaks_of(mass, a, b) for a, b in found]), strict=True)]


def segments_of(mass: np.ndarray, expected: int | None, width: int, min_width: int) -> list[tuple[int, int]]:
    """A strip's figures. If their number is not the expected one, the whole strip is cut into that many, where there is room."""
    counted = counted_of(mass, min_width)
    spans = split_of(mass, counted)
    content = sum(b - a for a, b, _ in counted)
    if counted and expected and len(spans) != expected and content / expected >= 16 and width // expected >= 16:
        return split_of(mass, [(0, width, expected)])
    return spans


def extent_of(mass: np.ndarray, share: float) -> int:
    """The length of the shortest stretch that holds the share of the mass, 0 where there is none."""
    upto = np.cumsum(mass)
    if not len(upto) or upto[-1] <= 0:
        return 0
    below = upto - mass
    end = np.searchsorted(upto, below + upto[-1] * share)
    # sums are compared as differences, so a neighbour may be the first that holds the share
    for step in (-1, 0, 1):
        at = np.clip(end + step, 0, len(upto) - 1)
        holds = (upto[at] - below >= upto[-1] * share) & (at >= np.arange(len(upto)))
        lengths = np.where(holds, at - np.arange(len(upto)) + 1, len(upto) + 1)
        best = lengths if step == -1 else np.minimum(best, lengths)
    return int(best.min())


def on_lines(function: Callable, kind: T.DataType) -> Callable[..., Column]:
    """A column function from ``function(mass, *others)``: of each row's places and masses, and other columns."""

    @F.arrow_udf(kind)
    def run(pos: pa.Array, mass: pa.Array, *others: pa.Array) -> pa.Array:
        rows = zip(pos.to_pylist(), mass.to_pylist(), *(o.to_pylist() for o in others), strict=True)
        out = [None if p is None else function(dense(p, m), *rest) for p, m, *rest in rows]
        return pa.array(out, arrow_type(kind))

    return run


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in kind.fields])
    return {T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.DoubleType: pa.float64()}[type(kind)]
