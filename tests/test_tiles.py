"""Images in tiles against kernels on whole ones, components of edge tables, and large palettes."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.operators import graph, kernels, palette, tiles

TILE = "image_id bigint, tx int, ty int, x0 bigint, y0 bigint, w int, h int, mask binary"


def cut(spark, masks, size):
    rows = []
    for i, mask in enumerate(masks):
        for ty in range(-(-mask.shape[0] // size)):
            for tx in range(-(-mask.shape[1] // size)):
                part = mask[ty * size : (ty + 1) * size, tx * size : (tx + 1) * size]
                rows.append((i, tx, ty, tx * size, ty * size, part.shape[1], part.shape[0], bytearray(part.astype(np.uint8).tobytes())))
    return spark.createDataFrame(rows, TILE)


def whole(masks):
    out = []
    for i, mask in enumerate(masks):
        labels = kernels._labels(mask)
        for k in range(labels.max(initial=-1) + 1):
            y, x = np.nonzero(labels == k)
            out.append((i, int(y[0]), int(x[0]), len(y), int(x.min()), int(y.min()), int(x.max()), int(y.max())))
    return sorted(out)


def spiral(n):
    mask = np.zeros((n, n), dtype=bool)
    a, b = 0, n - 1
    while a <= b:
        mask[a, max(0, a - 2) : b + 1] = mask[a : b + 1, b] = mask[b, a : b + 1] = mask[a + 2 : b + 1, a] = True
        a, b = a + 2, b - 2
    return mask


@pytest.mark.parametrize("size", [1, 7, 16])
def test_tiles_equal_the_whole_image(spark, size):
    rng = np.random.default_rng(size)
    masks = [rng.random((23, 31)) < p for p in (0.3, 0.6, 0.9)] + [np.zeros((5, 5), bool), np.ones((17, 3), bool), spiral(24)]
    masks = masks if size > 1 else [m[:6, :6] for m in masks]
    assert sorted(map(tuple, tiles.components(cut(spark, masks, size)).collect())) == whole(masks)


def test_floods_in_tiles(spark):
    rng = np.random.default_rng(5)
    masks = [rng.random((26, 40)) < 0.6, np.pad(np.ones((6, 6), bool), 4), np.ones((2, 30), bool)]
    made = cut(spark, masks, 8)
    sizes = spark.createDataFrame([(i, m.shape[1], m.shape[0]) for i, m in enumerate(masks)], "image_id bigint, width int, height int")
    hit = tiles.outside(made, sizes).join(tiles.labelled(made).drop("component"), ["image_id", "ty", "tx", "label"]).groupBy("image_id").agg(F.sum("n").alias("n"))
    assert {r.image_id: r.n for r in hit.collect()} == {i: int(kernels._outside(m).sum()) for i, m in enumerate(masks) if kernels._outside(m).any()}


def test_a_large_image_is_a_small_one_magnified(spark):
    """4,000 by 4,000 pixels in tiles of 500: each pixel of a small image a hundred times wide and high."""
    rng = np.random.default_rng(9)
    small = rng.random((40, 40)) < 0.55
    big = small.repeat(100, axis=0).repeat(100, axis=1)
    got = sorted(map(tuple, tiles.components(cut(spark, [big], 500)).collect()))
    want = sorted((i, y * 100, x * 100, n * 10_000, a * 100, b * 100, c * 100 + 99, d * 100 + 99) for i, y, x, n, a, b, c, d in whole([small]))
    assert got == want


def test_tiles_of_a_pixel_table(spark):
    mask = np.zeros((30, 30), dtype=bool)
    mask[3:25, 10:12] = mask[14, 2:29] = True
    rows = [(7, x, y, bool(mask[y, x])) for y in range(30) for x in range(30) if mask[y, x] or (x + y) % 3]
    made = tiles.cut(spark.createDataFrame(rows, "image_id bigint, x int, y int, on boolean"), "on", 11)
    assert [tuple(r)[1:] for r in tiles.components(made).collect()] == [whole([mask])[0][1:]]


def test_components_of_edges(spark):
    rng = random.Random(2)
    names = list(range(3000))
    rng.shuffle(names)
    edges = list(zip(names[:1500], names[1:1501]))  # a chain of 1,501 nodes in no order
    edges += [(names[2000], n) for n in names[2001:2400]] + [(n, names[2000]) for n in names[2100:2200]] + [(names[2500], names[2500]), (names[2600], names[2601])]
    found = {r.id: r.component for r in graph.components(spark.createDataFrame([*edges, (None, 1)], "u bigint, v bigint")).collect()}
    want = {n: min(names[:1501]) for n in names[:1501]} | {n: min(names[2000:2400]) for n in names[2000:2400]} | {names[2500]: names[2500]} | {n: min(names[2600:2602]) for n in names[2600:2602]}
    assert found == want
    assert graph.components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_a_palette_of_ten_million_colours():
    packed = np.random.default_rng(1).choice(1 << 24, 10_000_000, replace=False)
    colours = np.stack([packed >> 16, packed >> 8 & 255, packed & 255], axis=1)
    began = time.time()
    found = palette._cut(colours, np.ones(len(colours), dtype=np.int64), 32)
    assert 16 <= len(found) <= 32 and time.time() - began < 120


def test_tiles_are_cut_where_images_are(spark):
    """Tiles of images that come together, without a shuffle, are those that are grouped."""
    rng = np.random.default_rng(3)
    rows = [(i, x, y, bool(rng.random() < 0.6)) for i, (w, h) in enumerate(((31, 23), (7, 7), (50, 3))) for y in range(h) for x in range(w) if rng.random() < 0.9]
    pixels = spark.createDataFrame(rows, "image_id bigint, x int, y int, on boolean").coalesce(1)
    here, grouped = tiles.cut(pixels, "on", 7, clustered=True), tiles.cut(pixels, "on", 7)
    assert sorted(here.collect()) == sorted(grouped.collect())
    assert "Exchange" not in here._jdf.queryExecution().executedPlan().toString()


def test_a_flood_labels_its_tiles_once(spark, monkeypatch):
    masks = [np.pad(np.ones((6, 6), bool), 4), np.ones((9, 30), bool), np.ones((2, 30), bool)]
    sizes = spark.createDataFrame([(i, m.shape[1], m.shape[0]) for i, m in enumerate(masks)], "image_id bigint, width int, height int")
    calls, labelled = [], tiles.labelled
    monkeypatch.setattr(tiles, "labelled", lambda t: calls.append(t) or labelled(t))
    assert [tuple(r) for r in tiles.flooded(cut(spark, masks, 8), sizes).collect()] == [(1, 270)] and len(calls) == 1
