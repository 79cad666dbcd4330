"""Components and floods of images that are larger than a task's memory: tiles are labelled apart and joined along their borders.

Tiles are rows (image_id, tx, ty, x0, y0, w, h, mask): the place of a tile among tiles, its first pixel in the image, and a byte a pixel. Labelling keeps
runs on borders alone; labels of neighbouring tiles that meet there are edges, and their components are those of the image.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import per_group
from ..session import settled
from . import graph, kernels

_LABEL = "struct<label:int,first_y:bigint,first_x:bigint,n:bigint,min_x:bigint,min_y:bigint,max_x:bigint,max_y:bigint,edge:boolean>"
_MEET = "struct<side:int,at:bigint,first:bigint,last:bigint,label:int>"


def cut(pixels: DataFrame, flag: str, size: int, clustered: bool = False) -> DataFrame:
    """Tiles of ``size`` by ``size`` of a table of pixels (image_id, x, y, flag); a group is a tile. Places without a pixel are empty.

    ``clustered`` as in ``kernels``: whole images come together in a task that has room for one, a group is an image and nothing is shuffled.
    """
    kind = dict(pixels.dtypes)["image_id"]

    def run(table: pa.Table) -> pa.Table:
        x, y = (table.column(c).to_numpy() for c in "xy")
        on = table.column(flag).to_numpy(zero_copy_only=False)
        across = int(x.max()) // size + 1
        tile = (y // size).astype(np.int64) * across + x // size
        order = np.argsort(tile, kind="stable")
        first = np.flatnonzero(np.diff(tile[order], prepend=-1))
        rows = []
        for own in np.split(order, first[1:]):
            ty, tx = divmod(int(tile[own[0]]), across)
            px, py = x[own] - tx * size, y[own] - ty * size
            mask = np.zeros((int(py.max()) + 1, int(px.max()) + 1), dtype=np.uint8)
            mask[py, px] = on[own]
            rows.append((tx, ty, tx * size, ty * size, mask.shape[1], mask.shape[0], mask.tobytes()))
        image = table.column("image_id").slice(0, 1).take(pa.array([0] * len(rows)))
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.table([image, *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["image_id", "tx", "ty", "x0", "y0", "w", "h", "mask"])

    schema = f"image_id {kind}, tx int, ty int, x0 bigint, y0 bigint, w int, h int, mask binary"
    rows = pixels.select("image_id", "x", "y", flag)
    if clustered:
        return per_group(rows, "image_id", run, schema, clustered=True)
    at = [F.floor(F.col(c) / size).alias(f"t{c}") for c in "xy"]
    return rows.select("*", *at).groupBy("image_id", "tx", "ty").applyInArrow(run, schema)


def _border(line: np.ndarray, side: int, at: int, start: int) -> list[dict]:
    """Stretches of one label along a border line: which side, where the line is, from where to where."""
    cuts = np.flatnonzero(np.diff(line, prepend=line[0] - 1))
    ends = np.append(cuts[1:], len(line))
    return [{"side": side, "at": at, "first": start + int(a), "last": start + int(b) - 1, "label": int(line[a])} for a, b in zip(cuts, ends, strict=True) if line[a] >= 0]


#: Tiles whose labels leave a task together.
TOGETHER = 256


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole, place = pa.int64(), pa.int32()
    label = pa.struct([("label", place), *((c, whole) for c in ("first_y", "first_x", "n", "min_x", "min_y", "max_x", "max_y")), ("edge", pa.bool_())])
    meet = pa.struct([("side", place), ("at", whole), ("first", whole), ("last", whole), ("label", place)])
    for batch in batches:
        for start in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(start, TOGETHER)
            labels, meets = [], []
            for x0, y0, w, h, mask in zip(*(part.column(c).to_pylist() for c in ("x0", "y0", "w", "h", "mask")), strict=True):
                found, met = _tile(np.frombuffer(mask, np.uint8).reshape(h, w) > 0, x0, y0)
                labels.append(found)
                meets.append(met)
            yield pa.record_batch([*(part.column(c) for c in ("image_id", "tx", "ty")), pa.array(labels, pa.list_(label)), pa.array(meets, pa.list_(meet))], names=["image_id", "tx", "ty", "labels", "meets"])


def _tile(mask: np.ndarray, x0: int, y0: int) -> tuple[list[dict], list[dict]]:
    """A tile's labels, and the stretches of labels along its borders."""
    h, w = mask.shape
    if not mask.any():
        return [], []
    labels = kernels._labels(mask)
    y, x = np.nonzero(labels >= 0)
    own = labels[y, x]
    n = np.bincount(own)
    first = np.full(len(n), len(own))
    np.minimum.at(first, own, np.arange(len(own)))
    ends = [f(np.full(len(n), fill), own, v) for f, fill in ((_least, 1 << 62), (_most, -1)) for v in (x, y)]
    columns = (np.arange(len(n)), y[first] + y0, x[first] + x0, n, ends[0] + x0, ends[1] + y0, ends[2] + x0, ends[3] + y0)
    names = ("label", "first_y", "first_x", "n", "min_x", "min_y", "max_x", "max_y")
    found = [{**dict(zip(names, row, strict=True)), "edge": False} for row in zip(*(c.tolist() for c in columns), strict=True)]
    return found, _border(labels[0], 0, y0, x0) + _border(labels[-1], 1, y0 + h, x0) + _border(labels[:, 0], 2, x0, y0) + _border(labels[:, -1], 3, x0 + w, y0)


def _least(out: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    np.minimum.at(out, at, values)
    return out


def _most(out: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    np.maximum.at(out, at, values)
    return out


def _node(label: str) -> Column:
    return F.struct("image_id", "ty", "tx", F.col(label).alias("label"))


def labelled(tiles: DataFrame) -> DataFrame:
    """(image_id, ty, tx, label, component, first_y, first_x, n, min_x, min_y, max_x, max_y): the labels of each tile, numbered in scan order,
    and the component of the image that each belongs to, as struct(image_id, ty, tx, label) of its smallest one."""
    rows = settled(tiles.mapInArrow(_labelled, f"image_id {dict(tiles.dtypes)['image_id']}, tx int, ty int, labels array<{_LABEL}>, meets array<{_MEET}>"))
    nodes = rows.select("image_id", "tx", "ty", F.explode("labels").alias("l")).select("image_id", "tx", "ty", "l.*", F.struct("image_id", "ty", "tx", F.col("l.label").alias("label")).alias("node"))
    meets = rows.select("image_id", "tx", "ty", F.explode("meets").alias("m")).select("image_id", "m.side", "m.at", "m.first", "m.last", F.struct("image_id", "ty", "tx", F.col("m.label").alias("label")).alias("node"), "tx", "ty")
    # a tile's lower border lies on the upper one of the tile below, its right one on the left one of the tile beside it
    edges = None
    for here, there, along, across in ((1, 0, "tx", "ty"), (3, 2, "ty", "tx")):
        a = meets.where(F.col("side") == here).select("image_id", along, (F.col(across) + 1).alias(across), "at", F.col("first").alias("a0"), F.col("last").alias("a1"), F.col("node").alias("u"))
        b = meets.where(F.col("side") == there).select("image_id", along, across, "at", F.col("first").alias("b0"), F.col("last").alias("b1"), F.col("node").alias("v"))
        part = a.join(b, ["image_id", along, across, "at"]).where("a0 <= b1 AND b0 <= a1").select("u", "v")
        edges = part if edges is None else edges.unionByName(part)
    found = graph.components(edges)
    return nodes.join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node", "edge")


def components(tiles: DataFrame) -> DataFrame:
    """(image_id, first_y, first_x, n, min_x, min_y, max_x, max_y) of each component: its first pixel by rows, pixels and box."""
    rows = labelled(tiles)
    ends = [f(c).alias(c) for f, names in ((F.min, ("min_x", "min_y")), (F.max, ("max_x", "max_y"))) for c in names]
    found = rows.groupBy("image_id", "component").agg(F.min(F.struct("first_y", "first_x")).alias("f"), F.sum("n").alias("n"), *ends)
    return found.select("image_id", "f.*", "n", "min_x", "min_y", "max_x", "max_y")


def _reaching(tiles: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rows of ``labelled`` whose component reaches the border of its image: tiles are labelled once."""
    rows = labelled(tiles)
    reach = rows.groupBy("image_id", "component").agg(F.min("min_x").alias("l"), F.min("min_y").alias("t"), F.max("max_x").alias("r"), F.max("max_y").alias("b"))
    hit = reach.join(sizes.where("width >= 3 AND height >= 3"), "image_id").where("l = 0 OR t = 0 OR r = width - 1 OR b = height - 1").select("image_id", "component")
    return rows.join(hit, ["image_id", "component"], "left_semi")


def outside(tiles: DataFrame, sizes: DataFrame) -> DataFrame:
    """(image_id, ty, tx, label) of the labels whose component reaches the border of its image; ``sizes`` has image_id, width, height.

    Images under 3 pixels wide or high have none.
    """
    return _reaching(tiles, sizes).select("image_id", "ty", "tx", "label")


def flooded(tiles: DataFrame, sizes: DataFrame) -> DataFrame:
    """(image_id, n): how many pixels of an image are in ``outside``; images that have none are left out."""
    return _reaching(tiles, sizes).groupBy("image_id").agg(F.sum("n").alias("n"))
