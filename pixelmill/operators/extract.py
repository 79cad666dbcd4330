"""From a strip to cells, over packed rasters: grid rows, segments, owned contents, shared scale, placement, resampling.

A row carries its image through all steps, so that nothing is shuffled: a small array program finds the figures of one
image, column expressions place them by what their image's figures have in common, and a kernel writes the cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import ALPHA_T, BODY_SHARE
from ..sources.images import rasters_of, resampled
from . import kernels, layout, lines

_FIGURE = T.StructType(
    [T.StructField(c, T.IntegerType()) for c in ("min_x", "min_y", "max_x", "max_y")] + [T.StructField("cx", T.DoubleType())] + [T.StructField(c, T.IntegerType()) for c in ("body_w", "body_h")] + [T.StructField("crop", T.BinaryType())]
)


def _smooth(mass: np.ndarray, win: int) -> np.ndarray:
    """Centred means over 2 * (win // 2) + 1 places, shorter at the ends."""
    upto, at, half = np.concatenate([[0.0], np.cumsum(mass)]), np.arange(len(mass)), win // 2
    lo, hi = np.maximum(at - half, 0), np.minimum(at + half + 1, len(mass))
    return (upto[hi] - upto[lo]) / (hi - lo)


def _rows(alpha: np.ndarray, expected: int) -> list[tuple[int, int, int]]:
    """(first line, end, figures) of the rows of an image's grid; one row if its content does not fall into them."""
    height, n = len(alpha), max(1, expected)
    rows, cols = (1, n) if n <= 3 else (2, (n + 1) // 2)
    if rows > 1:
        found = lines.runs_of(_smooth(alpha.sum(axis=1, dtype=np.float64), max(3, height // 220)), max(4, height // 100))
        if len(found) == rows:
            cuts = [0, *((a[1] + b[0]) // 2 for a, b in zip(found[:-1], found[1:], strict=True)), height]
            return [(cuts[k], cuts[k + 1], cols if k < rows - 1 else max(1, expected - cols * (rows - 1))) for k in range(rows)]
    return [(0, height, expected)]


def _owned(opaque: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Of each pixel the span that owns its component, -1 for none.

    A component belongs to the span that holds most of its pixels, the first of equals. If a span then owns nothing,
    spans are plain columns instead.
    """
    column = np.full(opaque.shape[1], -1)
    for k, (a, b) in enumerate(spans):
        column[a:b] = k
    labels = kernels._labels(opaque)
    y, x = np.nonzero(opaque)
    held = np.zeros((labels.max(initial=-1) + 1, len(spans)), dtype=np.int64)
    inside = column[x] >= 0
    np.add.at(held, (labels[y, x][inside], column[x][inside]), 1)
    owner = np.where(held.any(axis=1), held.argmax(axis=1), -1) if len(spans) else np.full(len(held), -1)
    of = np.full(opaque.shape, -1)
    of[y, x] = owner[labels[y, x]] if len(np.unique(owner[owner >= 0])) == len(spans) else column[x]
    return of


def figures_of(image: np.ndarray, expected: int, grids: bool = True) -> list[dict]:
    """The figures of one strip (rows x columns x RGBA), by rows of its grid; places are those in the figure's row."""
    out, width = [], image.shape[1]
    for y0, y1, n in _rows(image[..., 3], expected) if grids else [(0, len(image), expected)]:
        part = image[y0:y1]
        alpha = part[..., 3].astype(np.float64)
        spans = lines.segments_of(_smooth(alpha.sum(axis=0), max(3, width // 220)), n, width, max(4, width // 100))
        of = _owned(part[..., 3] > ALPHA_T, spans)
        for k in range(len(spans)):
            own = of == k
            if not own.any():
                continue
            mass = np.where(own, alpha, 0)
            by_x, by_y = mass.sum(axis=0), mass.sum(axis=1)
            (x0, x1), (t, b) = (np.flatnonzero(m)[[0, -1]] for m in (by_x, by_y))
            crop = np.where(own[t : b + 1, x0 : x1 + 1, None], part[t : b + 1, x0 : x1 + 1], 0).astype(np.uint8)
            cx = float((np.arange(width) * by_x).sum() / by_x.sum())
            out.append({"min_x": int(x0), "min_y": int(t), "max_x": int(x1), "max_y": int(b), "cx": cx, "body_w": lines.extent_of(by_x, BODY_SHARE), "body_h": lines.extent_of(by_y, BODY_SHARE), "crop": crop.tobytes()})
    return out


def _arrow(kind: T.DataType) -> pa.DataType:
    return pa.binary() if isinstance(kind, T.BinaryType) else lines.arrow_type(kind)


def _found(grids: bool):
    kind = pa.list_(pa.struct([(f.name, _arrow(f.dataType)) for f in _FIGURE.fields]))

    @F.arrow_udf(T.ArrayType(_FIGURE))
    def run(w: pa.Array, h: pa.Array, pix: pa.Array, expected: pa.Array) -> pa.Array:
        rows = zip(w.to_pylist(), h.to_pylist(), pix.to_pylist(), expected.to_pylist(), strict=True)
        return pa.array([figures_of(np.frombuffer(p, np.uint8).reshape(b, a, 4), n, grids) for a, b, p, n in rows], kind)

    return run.asNondeterministic()  # else Catalyst runs it a second time below, to filter what the generator gets


def strip_figures(rasters: DataFrame, grids: bool = True) -> DataFrame:
    """``rasters`` (image_id, w, h, pix, expected) with ``figures``, an array: boxes, centres, bodies and crops of what stands in each strip."""
    return rasters.withColumn("figures", _found(grids)("w", "h", "pix", F.col("expected").cast("int")))


def placed(rasters: DataFrame, cell_w: int, cell_h: int, margin: int, grids: bool = True) -> DataFrame:
    """(image_id, seg, found, scale, sw, sh, left, top, w, h, crop): each figure's place in its cell; nothing is shuffled."""
    most = lambda field: F.array_max(F.transform("figures", lambda f: f[field]))
    rows = strip_figures(rasters, grids).select("image_id", "figures", F.size("figures").cast("bigint").alias("found"), most("body_w").alias("body_w"), most("body_h").alias("body_h"), most("max_y").alias("base"))
    rows = rows.select("image_id", "found", "body_w", "body_h", "base", F.posexplode("figures").alias("seg", "f"))
    ready = rows.select(
        "image_id", "seg", "found", "body_w", "body_h", "base", F.col("f.min_x").alias("min_x"), (F.col("f.max_x") - F.col("f.min_x") + 1).alias("w"), (F.col("f.max_y") - F.col("f.min_y") + 1).alias("h"),
        F.col("f.cx").alias("cx"), F.col("f.max_y").alias("bottom"), F.col("f.crop").alias("crop"),
    )
    return layout.fitted(ready, cell_w, cell_h, margin).select("image_id", "seg", "found", F.round("scale", 6).alias("scale"), "sw", "sh", "left", "top", "w", "h", "crop")


def _cell(cell_w: int, cell_h: int):
    @F.arrow_udf(T.BinaryType())
    def run(crop: pa.Array, w: pa.Array, h: pa.Array, sw: pa.Array, sh: pa.Array, left: pa.Array, top: pa.Array) -> pa.Array:
        out = []
        for pix, a, b, c, d, x, y in zip(*(v.to_pylist() for v in (crop, w, h, sw, sh, left, top)), strict=True):
            image = np.frombuffer(pix, np.uint8).reshape(b, a, 4)
            if (c, d) != (a, b):
                image = resampled(image, c, d, cubic=True)
            cell = np.zeros((cell_h, cell_w, 4), dtype=np.uint8)
            part = image[: cell_h - y, : cell_w - x]
            cell[y : y + part.shape[0], x : x + part.shape[1]] = np.where(part[..., 3:] > 0, part, 0)
            out.append(cell.tobytes())
        return pa.array(out, pa.binary())

    return run


def cells(rasters: DataFrame, cell_w: int, cell_h: int, margin: int, grids: bool = True) -> DataFrame:
    """(image_id, frame, found, scale, w, h, pix): a strip's figures as frames of one size, in one scale and on one ground."""
    rows = placed(rasters, cell_w, cell_h, margin, grids)
    pix = _cell(cell_w, cell_h)("crop", "w", "h", "sw", "sh", "left", "top")
    return rows.select("image_id", F.col("seg").alias("frame"), "found", "scale", F.lit(cell_w).alias("w"), F.lit(cell_h).alias("h"), pix.alias("pix"))


def _packed(pixels: DataFrame, expected: DataFrame, width: int, height: int) -> DataFrame:
    rows = rasters_of(pixels.withColumns({"one": F.lit(0), "w": F.lit(width), "h": F.lit(height)}), frame="one")
    return rows.join(expected.select("image_id", "expected"), "image_id")


def figures(pixels: DataFrame, expected: DataFrame, width: int, height: int, grids: bool = True) -> DataFrame:
    """(image_id, seg, min_x, min_y, max_x, max_y, cx, body_w, body_h) of each figure of a table of pixels; ``expected``: image_id, expected."""
    rows = strip_figures(_packed(pixels, expected, width, height), grids).select("image_id", F.posexplode("figures").alias("seg", "f"))
    return rows.select("image_id", "seg", *(f"f.{c}" for c in _FIGURE.names if c != "crop"))


def extracted(pixels: DataFrame, expected: DataFrame, width: int, height: int, cell: int, margin: int, grids: bool = True) -> DataFrame:
    """(image_id, seg, found, scale, sw, sh, left, top): where each figure of a table of pixels goes in its cell, and how many the strip has."""
    return placed(_packed(pixels, expected, width, height), cell, cell, margin, grids).drop("w", "h", "crop")
