"""Extraction and post-processing over packed rasters: from a strip to the pixels of cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from strip_helpers import canvas, fill, table

from pixelmill.operators import extract, palette
from pixelmill.sources import images

GREEN, BLUE, RED = (40, 180, 60), (30, 60, 200), (200, 40, 40)


def rasters(spark, strips, expected):
    rows = [(i, s.shape[1], s.shape[0], bytearray(s.astype(np.uint8).tobytes()), n) for i, (s, n) in enumerate(zip(strips, expected, strict=True))]
    return spark.createDataFrame(rows, "image_id bigint, w int, h int, pix binary, expected int")


def cells_of(rows):
    return {(r.image_id, r.frame): np.frombuffer(r.pix, np.uint8).reshape(r.h, r.w, 4) for r in rows.collect()}


def test_cells_hold_the_figures_pixels(spark):
    strip = canvas(300, 80, alpha=0)
    for k, (colour, top) in enumerate(((GREEN, 20), (BLUE, 10), (RED, 30))):
        fill(strip, 20 + 100 * k, top, 70 + 100 * k, 70, colour)
    found = cells_of(extract.cells(rasters(spark, [strip], [3]), 96, 96, 4))
    assert sorted(found) == [(0, 0), (0, 1), (0, 2)]
    for k, (colour, top) in enumerate(((GREEN, 20), (BLUE, 10), (RED, 30))):
        cell = found[0, k]
        y, x = np.nonzero(cell[..., 3])
        assert (y.min(), y.max(), x.min(), x.max()) == (92 - (70 - top), 91, 24, 73) and (cell[y, x, :3] == colour).all()


def test_a_higher_figure_keeps_its_height_over_the_common_ground(spark):
    strip = canvas(200, 80, alpha=0)
    fill(strip, 20, 40, 60, 70, GREEN)
    fill(strip, 120, 10, 160, 40, GREEN)  # in the air
    found = cells_of(extract.cells(rasters(spark, [strip], [2]), 80, 80, 4))
    assert np.nonzero(found[0, 0][..., 3])[0].max() == 75 and np.nonzero(found[0, 1][..., 3])[0].max() == 45


def test_a_neighbours_sword_stays_with_its_owner(spark):
    strip = canvas(240, 80, alpha=0)
    fill(strip, 20, 20, 80, 70, GREEN)
    fill(strip, 80, 40, 132, 44, GREEN)  # reaches over the next figure's columns
    fill(strip, 140, 50, 200, 70, BLUE)
    found = cells_of(extract.cells(rasters(spark, [strip], [2]), 160, 96, 4))
    colours = {k: {tuple(c) for c in v[v[..., 3] > 0][:, :3]} for k, v in found.items()}
    assert colours[0, 0] == {GREEN} and colours[0, 1] == {BLUE}


def test_larger_figures_are_scaled_and_not_clipped(spark):
    strip = canvas(400, 200, alpha=0)
    fill(strip, 20, 20, 120, 190, GREEN)
    fill(strip, 250, 90, 330, 190, GREEN)
    rows = extract.cells(rasters(spark, [strip], [2]), 64, 64, 4)
    found, scale = cells_of(rows), {r.frame: r.scale for r in rows.collect()}
    assert scale[0] == round(56 / 170, 6) and scale[0] < scale[1] < 0.42  # the body's scale, but a box that is larger than its cell is fitted
    for cell in found.values():
        assert (cell[..., 3][[0, -1]] == 0).all() and (cell[..., 3][:, [0, -1]] == 0).all()
        solid = cell[cell[..., 3] == 255]
        assert len(solid) and (np.abs(solid[:, :3].astype(int) - GREEN) <= 1).all()


def test_grids_and_touching_figures(spark):
    grid = canvas(300, 200, alpha=0)
    for k in range(5):
        x, y = 20 + 100 * (k % 3), 20 + 100 * (k // 3)
        fill(grid, x, y, x + 60, y + 60, (40 * k, 90, 30))
    touching = canvas(192, 60, alpha=0)
    fill(touching, 0, 10, 192, 50, GREEN)
    empty = canvas(64, 64, alpha=0)
    found = cells_of(extract.cells(rasters(spark, [grid, touching, empty], [5, 3, 2]), 72, 72, 4))
    assert sorted(found) == [(0, k) for k in range(5)] + [(1, k) for k in range(3)]
    assert [int(found[0, k][..., 0].max()) for k in range(5)] == [40 * k for k in range(5)]


def test_rasters_equal_pixels(spark):
    rng = np.random.default_rng(4)
    strips = []
    for _ in range(6):
        strip = canvas(160, 64, alpha=0)
        for k in range(3):
            a, b = sorted(rng.integers(0, 52, 2))
            fill(strip, 52 * k + a, 8, 52 * k + b + 2, int(rng.integers(20, 64)), GREEN, int(rng.integers(20, 256)))
        strips.append(strip)
    want = spark.createDataFrame([(i, 3) for i in range(6)], "image_id bigint, expected int")
    one = extract.extracted(table(spark, strips), want, 160, 64, 48, 4)
    two = extract.placed(rasters(spark, strips, [3] * 6), 48, 48, 4).select(one.columns)
    assert one.exceptAll(two).count() == 0 == two.exceptAll(one).count() and one.count() > 6


def test_rows_that_do_not_lie_together_are_an_error(spark):
    rows = table(spark, [canvas(4, 4), canvas(4, 4)]).orderBy("y", "x", "image_id").coalesce(1)
    with pytest.raises(Exception, match="do not lie together"):
        images.rasters_of(rows, clustered=True).count()
    assert images.rasters_of(rows).count() == 2


def test_scale_of_a_blown_up_raster():
    rng = np.random.default_rng(1)
    small = rng.integers(0, 255, (16, 16, 4)).astype(np.uint8)
    small[..., 3] = 255
    for k in (2, 3, 4):
        assert palette.scale_of(small.repeat(k, axis=0).repeat(k, axis=1)) == k
    board = ((np.add.outer(np.arange(64), np.arange(64)) % 2) * 255).astype(np.uint8)
    assert palette.scale_of(small) == 1 and palette.scale_of(np.dstack([board, board, board, np.full_like(board, 255)])) == 1


def test_snapped_blocks():
    image = np.zeros((5, 5, 4), dtype=np.uint8)
    image[:2, :2] = [[(9, 9, 9, 255), (9, 9, 9, 255)], [(1, 1, 1, 255), (1, 1, 1, 0)]]
    image[0, 2] = (5, 5, 5, 255)  # a quarter of its block
    image[4, 4] = (7, 7, 7, 255)  # all of the corner's block
    out = palette.snapped(image, 2)
    assert (out[:2, :2] == (9, 9, 9, 255)).all() and not out[:2, 2:4].any() and tuple(out[4, 4]) == (7, 7, 7, 255)
    ties = np.array([[(8, 0, 0, 255), (2, 0, 0, 255)], [(8, 0, 0, 255), (2, 0, 0, 255)]], dtype=np.uint8)
    assert (palette.snapped(ties, 2)[..., 0] == 2).all() and palette.snapped(image, 1) is image


def test_a_set_shares_its_median_grid(spark):
    rng = np.random.default_rng(8)
    frames = [np.kron(rng.integers(0, 2, (40 // k, 40 // k)), np.ones((k, k), int)) for k in (4, 4, 2)]
    rows = [(1, i, 40, 40, bytearray(np.where(f[..., None] > 0, (*GREEN, 255), (*BLUE, 255)).astype(np.uint8).tobytes())) for i, f in enumerate(frames)]
    made = spark.createDataFrame(rows, "image_id bigint, frame int, w int, h int, pix binary")
    top = spark.createDataFrame([(1, 0, *GREEN), (1, 1, *BLUE)], "image_id bigint, ord int, r int, g int, b int")
    out = palette.post_processed_rasters(made, top)
    assert {r.scale for r in out.collect()} == {4} and out.where(F.length("pix") == 6400).count() == 3
