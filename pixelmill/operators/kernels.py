"""Kernels over whole rasters, for what has no cheap relational form: flood fill and components.

A kernel sees one image at a time. Where each image's pixels come together in a task already (``clustered``: they
were made there from a row an image, or read from a raster), they are taken as they come and nothing is
shuffled; else Spark groups them by image. Both work on runs of pixels in rows, not on single pixels.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import per_group


def _joined(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component: roots hook onto smaller ones, then paths are halved."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]


def _run_labels(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, end, component) of the mask's runs by rows; components are 4-connected and named by their first run."""
    height, width = mask.shape
    framed = np.zeros((height, width + 2), dtype=np.int8)
    framed[:, 1:-1] = mask
    step = np.diff(framed, axis=1)
    row, first = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    # runs of a row begin in order, so those of the row above that overlap a run are neighbours in the list
    key, span = row * (width + 1), width + 1
    lo = np.searchsorted(key + end, key - span + first, "right")
    hi = np.searchsorted(key + first, key - span + end, "left")
    many = np.maximum(hi - lo, 0)
    below = np.repeat(np.arange(len(row)), many)
    above = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return row, first, end, _joined(len(row), below, above)


def _painted(shape: tuple[int, int], row: np.ndarray, first: np.ndarray, end: np.ndarray, value: np.ndarray, empty: int) -> np.ndarray:
    """A raster with each run's value."""
    out = np.full(shape, empty, dtype=np.int64)
    size = end - first
    x = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(row, size), x] = np.repeat(value, size)
    return out


def _labels(mask: np.ndarray) -> np.ndarray:
    """4-connected components, numbered from 0 in the order of their first pixel by rows; -1 outside."""
    row, first, end, component = _run_labels(mask)
    return _painted(mask.shape, row, first, end, np.unique(component, return_inverse=True)[1] if len(row) else component, -1)


def _outside(mask: np.ndarray) -> np.ndarray:
    """What of a mask is connected to the border through itself; nothing in images under 3 pixels wide or high."""
    height, width = mask.shape
    if min(height, width) < 3:
        return np.zeros_like(mask)
    row, first, end, component = _run_labels(mask)
    edge = (row == 0) | (row == height - 1) | (first == 0) | (end == width)
    hit = np.isin(component, component[edge])
    return _painted(mask.shape, row, first, end, hit, 0) > 0


def _raster(table: pa.Table, flag: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, y = table.column("x").to_numpy(), table.column("y").to_numpy()
    mask = np.zeros((int(y.max()) + 1, int(x.max()) + 1), dtype=bool)
    mask[y, x] = table.column(flag).to_numpy(zero_copy_only=False)
    return x, y, mask


def _per_image(pixels: DataFrame, run: Callable[[pa.Table], pa.Table], added: list[T.StructField], clustered: bool) -> DataFrame:
    return per_group(pixels, "image_id", run, T.StructType([*pixels.schema.fields, *added]), clustered)


def with_flood(pixels: DataFrame, flags: dict[str, str], clustered: bool = False) -> DataFrame:
    """``pixels`` with a boolean column for each flag: whether the pixel is connected to the border through pixels with the flag."""

    def run(table: pa.Table) -> pa.Table:
        for out, flag in flags.items():
            x, y, mask = _raster(table, flag)
            table = table.append_column(out, pa.array(_outside(mask)[y, x]))
        return table

    return _per_image(pixels, run, [T.StructField(name, T.BooleanType()) for name in flags], clustered)


def flooded(pixels: DataFrame, flag: str = "is_key", clustered: bool = False) -> DataFrame:
    """(image_id, x, y): pixels with the flag that are connected to the border through such pixels."""
    return with_flood(pixels.select("image_id", "x", "y", flag), {"hit": flag}, clustered).where("hit").select("image_id", "x", "y")


def _mask(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a table's rows, and a raster that holds them."""
    x, y = table.column("x").to_numpy(), table.column("y").to_numpy()
    mask = np.zeros((int(y.max()) + 1, int(x.max()) + 1), dtype=bool)
    mask[y, x] = True
    return x, y, mask


def components(pixels: DataFrame, flag: str = "is_opaque", clustered: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """(image_id, x, y, also, label) of the pixels with the flag; labels count from 0 in scan order. Only those pixels reach the kernel."""

    def run(table: pa.Table) -> pa.Table:
        x, y, mask = _mask(table)
        return table.append_column("label", pa.array(_labels(mask)[y, x].astype(np.int32)))

    return _per_image(pixels.where(flag).select("image_id", "x", "y", *also), run, [T.StructField("label", T.IntegerType())], clustered)


def component_boxes(pixels: DataFrame, flag: str = "is_opaque", clustered: bool = False) -> DataFrame:
    """(image_id, label, n, min_x, max_x, min_y, max_y) of ``components``: a row a component comes out of the kernel, no pixels."""

    def run(table: pa.Table) -> pa.Table:
        row, first, end, component = _run_labels(_mask(table)[2])
        order = np.argsort(component, kind="stable")
        row, first, end = row[order], first[order], end[order]
        at = np.unique(component[order], return_index=True)[1]
        found = {"n": np.add.reduceat(end - first, at), "min_x": np.minimum.reduceat(first, at), "max_x": np.maximum.reduceat(end, at) - 1, "min_y": row[at], "max_y": np.maximum.reduceat(row, at)}
        image = table.column("image_id")[0].as_py()
        columns = {"image_id": pa.array([image] * len(at), table.schema.field("image_id").type), "label": pa.array(np.arange(len(at), dtype=np.int32))}
        return pa.table(columns | {c: pa.array(v.astype(np.int64 if c == "n" else np.int32)) for c, v in found.items()})

    rows = pixels.where(flag).select("image_id", "x", "y")
    return per_group(rows, "image_id", run, f"image_id {dict(pixels.dtypes)['image_id']}, label int, n bigint, min_x int, max_x int, min_y int, max_y int", clustered)
