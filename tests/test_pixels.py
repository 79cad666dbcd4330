"""Properties of the pixel operators on small synthetic rasters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.operators import frames as fr
from pixelmill.operators import extract, kernels, layout, lines, matte, palette, profile

from strip_helpers import canvas, fill, table

GREEN, BLUE = (40, 200, 60), (40, 60, 200)


def test_matte_keeps_a_green_square_and_clears_magenta(spark):
    image = fill(canvas(64, 64), 20, 20, 44, 44, GREEN)
    found = {(r.x, r.y): r for r in matte.matted(table(spark, [image])).collect()}
    assert found[32, 32].a >= 200 and found[0, 0].a <= 10 and (found[0, 0].r, found[0, 0].g, found[0, 0].b) == (0, 0, 0)


def test_fringe_loses_its_tint(spark):
    image = fill(fill(canvas(60, 40), 20, 10, 40, 30, GREEN), 18, 10, 20, 30, (180, 120, 190))
    rim = matte.matted(table(spark, [image])).where("x in (18, 19) and y between 10 and 29").collect()
    assert all(r.a <= 10 or (r.r + r.b) // 2 - r.g <= 80 for r in rim)


def test_background_key(spark):
    images = [fill(canvas(80, 40), 30, 10, 50, 30, GREEN), fill(canvas(80, 40, (10, 200, 20)), 30, 10, 50, 30, BLUE)]
    found = {r.image_id: (r.r, r.g, r.b) for r in matte.background_key(table(spark, images), 80, 40).collect()}
    assert found == {0: (255, 0, 255), 1: (10, 200, 20)}


def _runs(spark, image, win=3):
    rows = matte.matted(table(spark, [image]))
    return profile.smoothed(profile.projected(rows), win)


def test_clean_gutters_give_three_runs(spark):
    image = canvas(600, 40)
    for x in (20, 220, 420):
        fill(image, x, 8, x + 60, 32, GREEN)
    rows = profile.runs(_runs(spark, image), 6).orderBy("x0").collect()
    assert len(rows) == 3 and all(abs(r.x0 - x) <= 1 for r, x in zip(rows, (20, 220, 420), strict=True))


def test_distant_residue_is_dropped(spark):
    image = fill(fill(fill(canvas(600, 40), 50, 5, 110, 35, GREEN), 250, 5, 310, 35, GREEN), 560, 10, 570, 14, GREEN)
    assert profile.runs(_runs(spark, image), 6).count() == 2
    assert profile.runs(_runs(spark, image), 6, drop_minor=False).count() in (2, 3)


def test_touching_bridge_is_cut_between_the_torsos(spark):
    image = fill(fill(fill(canvas(400, 60), 40, 5, 110, 55, GREEN), 110, 28, 250, 32, GREEN), 250, 5, 330, 55, GREEN)
    prof = _runs(spark, image)
    parts = spark.createDataFrame([(0, 40, 330, 2)], "image_id bigint, x0 int, x1 int, n int")
    (cut,) = profile.cuts(prof, parts).first().cuts
    assert 111 <= cut <= 249
    peaks = profile.peaks(prof, 4).collect()
    assert len(peaks) == 2


def test_grid_rows_are_found_and_a_single_row_is_not_split(spark):
    grid, row = canvas(300, 200), canvas(300, 200)
    for k in range(6):
        x, y = 20 + 100 * (k % 3), 20 + 100 * (k // 3)
        fill(grid, x, y, x + 60, y + 60, GREEN)
    fill(row, 20, 40, 280, 160, GREEN)
    want = spark.createDataFrame([(0, 2), (1, 2)], "image_id bigint, rows int")
    found = profile.bands(matte.matted(table(spark, [grid, row])), want, 200).orderBy("band").collect()
    assert [(r.image_id, r.y0, r.y1) for r in found] == [(0, 0, 100), (0, 100, 200)]


def test_a_strip_without_gaps_is_cut_into_what_was_asked_for(spark):
    image = fill(fill(canvas(400, 100), 40, 20, 141, 80, GREEN), 120, 20, 221, 80, GREEN)
    prof = profile.smoothed(profile.projected(matte.matted(table(spark, [image]))), 3)
    found = profile.segments(prof, spark.createDataFrame([(0, 2)], "image_id bigint, expected int"), 400, 4).orderBy("seg").collect()
    assert len(found) == 2 and found[0].x1 == found[1].x0 and (found[0].x0, found[1].x1) == (0, 400)


def test_background_removal_keeps_a_figure_on_any_ground(spark):
    images = [fill(canvas(60, 40), 20, 10, 40, 30, GREEN), fill(canvas(60, 40, (20, 30, 200)), 20, 10, 40, 30, (220, 180, 40))]
    out = {(r.image_id, r.x, r.y): r.a for r in matte.without_background(table(spark, images), 60, 40).collect()}
    assert all(out[i, 30, 20] > 200 and out[i, 2, 2] == 0 for i in (0, 1))


def test_draw_rects_stand_on_the_bottom_centre(spark):
    rows = spark.createDataFrame([(10.0, 20.0, None, None, None), (10.0, 20.0, 2.0, 3.0, -1.0)], "w double, h double, scale double, dx double, dy double")
    a, b = layout.draw_rects(rows, 64, 2).collect()
    assert (a.draw_x, a.draw_y, a.draw_w, a.draw_h, a.plain) == (29, 46, 10, 20, True) and (b.draw_x, b.draw_y, b.draw_w, b.draw_h, b.plain) == (29.5, 35, 15, 30, False)


def test_extent_is_the_shortest_stretch(spark):
    mass = [1.0, 1.0, 10.0, 10.0, 10.0, 1.0, 1.0]
    assert lines.extent_of(np.array(mass), 0.8) == 3 and lines.extent_of(np.zeros(4), 0.8) == 0 and lines.extent_of(np.zeros(0), 0.8) == 0
    rng = np.random.default_rng(2)
    for _ in range(200):
        m = rng.integers(0, 6, rng.integers(1, 30)).astype(float)
        want = min((j - i + 1 for i in range(len(m)) for j in range(i, len(m)) if m.sum() and m[i : j + 1].sum() >= 0.8 * m.sum()), default=0)
        assert lines.extent_of(m, 0.8) == want
    image = fill(canvas(40, 30, alpha=0), 5, 6, 25, 16, GREEN)
    row = profile.extents(table(spark, [image])).first()
    assert (row.body_w, row.body_h) == (16, 8)


def brute_cuts(mass, x0, x1, n):
    """The cheapest cuts by trying all."""
    import itertools

    ideal = (x1 - x0) / n
    least = max(2, int(ideal * 0.45))
    best = None
    for cuts in itertools.combinations(range(x0 + least, x1), n - 1):
        edges = [x0, *cuts, x1]
        widths = [b - a for a, b in zip(edges[:-1], edges[1:])]
        if min(widths) < least:
            continue
        cost = sum(mass[c] for c in cuts) + sum(0.0015 * (w - ideal) ** 2 for w in widths)
        if best is None or cost < best[0] - 1e-9:
            best = (cost, list(cuts))
    return best[1] if best else None


def test_cuts_are_the_cheapest_for_any_number(spark):
    rng = np.random.default_rng(4)
    for n in (2, 3, 4):
        for _ in range(10):
            mass = rng.integers(0, 9, 26).astype(float)
            assert lines.cuts_of(mass, 2, 25, n) == brute_cuts(mass, 2, 25, n)
    assert lines.cuts_of(np.zeros(10), 0, 10, 6) is None
    # fifteen figures that touch, in a strip of 4,096 columns
    mass = np.full(4096, 50.0)
    gaps = [273 * k for k in range(1, 15)]
    mass[gaps] = 1.0
    assert lines.cuts_of(mass, 0, 4095, 15) == gaps
    rows = spark.createDataFrame([(0, i, float(m)) for i, m in enumerate(mass)], "image_id bigint, pos int, mass double")
    found = profile.segments(rows, spark.createDataFrame([(0, 15)], "image_id bigint, expected int"), 4096, 40).orderBy("seg").collect()
    assert len(found) == 15 and all(abs(r.x1 - r.x0 - 273) <= 2 for r in found)


def test_peaks_of_a_wide_profile_equal_the_plain_rule():
    rng = np.random.default_rng(5)
    for width in (40, 300, 4096):
        mass = np.convolve(rng.random(width), np.ones(5) / 5, "same") * 100
        cand = [i for i in range(1, width - 1) if mass[i] >= mass[i - 1] and mass[i] > mass[i + 1] and mass[i] >= 0.45 * mass.max()]
        if width > 300:
            cand = cand[:60]
            mass = mass[: cand[-1] + 3]
            cand = [i for i in range(1, len(mass) - 1) if mass[i] >= mass[i - 1] and mass[i] > mass[i + 1] and mass[i] >= 0.45 * mass.max()]
        kept = [c for c in cand if not any(o != c and mass[o] >= mass[c] and mass[min(c, o) : max(c, o) + 1].min() > 0.62 * mass[c] for o in cand)]
        assert lines.peaks_of(mass, 0, len(mass)) == (kept or cand[:1] or [len(mass) // 2])


def test_frames_of_other_sizes_or_with_gaps_are_not_compared(spark):
    same = [fill(canvas(40, 40, (0, 0, 0), 0), 8, 8, 24, 30, c) for c in (BLUE, GREEN)]
    small = fill(canvas(30, 40, (0, 0, 0), 0), 8, 8, 24, 30, BLUE)
    rows = table(spark, [same[0], small, same[1]], frames=True)
    assert fr.scores(rows).first().motion == 0 and fr.scores(rows).first().identity == 0
    gap = table(spark, [same[0], same[0], same[1]], frames=True).where("frame <> 1")
    assert fr.scores(gap).first().motion == 0
    both = table(spark, [same[0], same[1], small, small], frames=True)
    want = fr.scores(table(spark, same, frames=True)).first().identity
    assert abs(fr.scores(both).first().identity - (want + 1) / 2) < 1e-9


def test_kernels_over_clustered_pixels_equal_grouped_ones(spark):
    rng = np.random.default_rng(6)
    images = [canvas(33, 21, GREEN, 0) for _ in range(4)]
    for image in images:
        image[..., 3] = np.where(rng.random((21, 33)) < 0.6, 255, 0)
    rows = table(spark, images).withColumn("is_opaque", F.col("a") > 10).coalesce(1)
    a, b = (kernels.components(rows, clustered=c, also=("a",)) for c in (False, True))
    assert a.count() == b.count() == a.intersect(b).count()
    a, b = (kernels.flooded(rows, "is_opaque", clustered=c) for c in (False, True))
    assert 0 < a.count() == b.count() == a.intersect(b).count()


def test_a_spiral_is_one_component():
    n = 201
    mask, x, y, dx, dy = np.zeros((n, n), bool), 0, 0, 1, 0
    for _ in range(n * n):
        mask[y, x] = True
        ahead = (x + 2 * dx, y + 2 * dy)
        if not (0 <= x + dx < n and 0 <= y + dy < n) or (0 <= ahead[0] < n and 0 <= ahead[1] < n and mask[ahead[1], ahead[0]]):
            dx, dy = -dy, dx
            if mask[y + dy, x + dx] or (0 <= y + 2 * dy < n and 0 <= x + 2 * dx < n and mask[y + 2 * dy, x + 2 * dx]):
                break
        x, y = x + dx, y + dy
    label = kernels._labels(mask)
    assert mask.sum() > n * 50 and set(np.unique(label)) == {-1, 0} and (kernels._outside(mask) == mask).all()


def test_contents_fall_back_to_columns_when_a_span_owns_nothing(spark):
    bar = fill(canvas(60, 20, alpha=0), 5, 5, 55, 15, GREEN)
    labelled = kernels.components(table(spark, [bar]).withColumn("is_opaque", F.col("a") > 10), also=("a",))
    spans = spark.createDataFrame([(0, 0, 0, 30), (0, 1, 30, 60)], "image_id bigint, seg int, x0 int, x1 int")
    found = profile.measured(profile.owned_pixels(labelled, spans)).orderBy("seg").collect()
    assert [(r.min_x, r.max_x, r.min_y, r.max_y) for r in found] == [(5, 29, 5, 14), (30, 54, 5, 14)]


def test_grids_are_extracted_row_by_row(spark):
    grid = canvas(300, 200, alpha=0)
    for k in range(5):
        x, y = 20 + 100 * (k % 3), 20 + 100 * (k // 3)
        fill(grid, x, y, x + 60, y + 60, GREEN)
    want = spark.createDataFrame([(0, 5)], "image_id bigint, expected int")
    rows = extract.figures(table(spark, [grid]), want, 300, 200).orderBy("seg").collect()
    assert [(r.seg, r.min_x, r.min_y) for r in rows] == [(0, 20, 20), (1, 120, 20), (2, 220, 20), (3, 20, 20), (4, 120, 20)]
    placed = extract.extracted(table(spark, [grid]), want, 300, 200, 64, 4).collect()
    assert len(placed) == 5 and {r.found for r in placed} == {5} and all(r.left >= 0 and r.left + r.sw <= 64 and r.top + r.sh == 60 for r in placed)


def test_states_that_play_once_are_tagged(spark):
    import json

    sets = _set(spark, [(4, 4, 20, 30)] * 2).unionByName(_set(spark, [(4, 4, 20, 30)] * 3).withColumn("image_id", F.lit(1).cast("bigint")))
    states = spark.createDataFrame([(0, 7, 0, 8), (1, 7, 1, 12)], "image_id bigint, sheet bigint, row int, fps int")
    cells = layout.atlas(sets, states, 32, 32).withColumn("loop", F.col("image_id") == 0)
    meta = json.loads(layout.sheet_json(cells, 32, 32).first().json)["meta"]
    assert [t.get("repeat") for t in meta["frameTags"]] == [None, "1"] and meta["size"] == {"w": 96, "h": 64} and meta["format"] == "RGBA8888"


def test_panels_crops_and_gaps(spark):
    image = fill(fill(canvas(40, 10, alpha=0), 2, 2, 8, 8, GREEN), 16, 2, 20, 8, GREEN)
    rows = table(spark, [image])
    assert [(r.x0, r.x1) for r in profile.gap_runs(profile.opaque_columns(rows), 6).orderBy("x0").collect()] == [(2, 8), (16, 20)]
    assert [(r.x0, r.x1) for r in profile.gap_runs(profile.opaque_columns(rows), 9).orderBy("x0").collect()] == [(2, 20)]
    crop = layout.cropped(rows, 2, 2, 6, 6)
    assert crop.count() == 36 and crop.agg(F.max("x"), F.max("y"), F.min("a")).first() == (5, 5, 255)
    panels = rows.withColumn("sheet", F.lit(0)).withColumn("panel", F.lit(0)).unionByName(crop.withColumn("sheet", F.lit(0)).withColumn("panel", F.lit(1)))
    wide, high = (layout.stacked(panels, 4, vertical).where("panel = 1").agg(F.min("x"), F.min("y")).first() for vertical in (False, True))
    assert tuple(wide) == (44, 0) and tuple(high) == (0, 14)


def test_composing_over_a_ground(spark):
    under = table(spark, [canvas(4, 4, (10, 20, 30))])
    top = canvas(4, 4, (200, 100, 0), 0)
    top[1, 1, 3], top[2, 2, 3] = 255, 128
    found = {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in layout.over(under, table(spark, [top])).collect()}
    assert found[0, 0] == (10, 20, 30, 255) and found[1, 1] == (200, 100, 0, 255) and found[2, 2] == (105, 60, 15, 255)
    clear = table(spark, [canvas(2, 1, (9, 9, 9), 0)])
    assert {r.a for r in layout.over(clear, clear).collect()} == {0}


def test_snapping_to_the_grid_that_a_set_shows(spark):
    rng = np.random.default_rng(8)
    frames = []
    for _ in range(2):
        blocks = rng.integers(0, 2, (10, 10))
        image = canvas(40, 40, GREEN)
        image[np.kron(blocks, np.ones((4, 4), int)) > 0, :3] = BLUE
        image[3, 5, :3] = GREEN if (image[3, 5, :3] == BLUE).all() else BLUE  # one pixel off the grid
        frames.append(image)
    rows = table(spark, frames, frames=True)
    sizes = spark.createDataFrame([(0, 40, 40)], "image_id bigint, w int, h int")
    out = palette.post_processed(rows, palette.shared_palette(rows, 8), sizes)
    assert out.count() == 3200 and out.groupBy("frame", F.expr("x div 4"), F.expr("y div 4")).agg(F.countDistinct("r", "g", "b").alias("n")).where("n > 1").count() == 0


def test_components_in_scan_order_and_flood(spark):
    image = canvas(40, 24, alpha=0)
    for x0, y0, x1, y1 in ((2, 3, 6, 8), (6, 7, 10, 12), (20, 2, 24, 4), (30, 10, 38, 20)):
        fill(image, x0, y0, x1, y1, GREEN)
    rows = table(spark, [image]).withColumn("is_opaque", F.col("a") > 10)
    found = {(r.x, r.y): r.label for r in kernels.components(rows).collect()}
    assert found[20, 2] == 0 and found[2, 3] == 1 and found[9, 11] == 1 and found[31, 15] == 2 and len(set(found.values())) == 3
    ring = fill(fill(canvas(12, 12, (0, 0, 0)), 2, 2, 10, 10, (9, 9, 9)), 4, 4, 8, 8, (0, 0, 0))
    outside = kernels.flooded(table(spark, [ring]).withColumn("is_key", F.col("r") == 0)).collect()
    assert len(outside) == 144 - 64 and (5, 5) not in {(r.x, r.y) for r in outside}


def test_components_of_noise_match_a_plain_search(spark):
    rng = np.random.default_rng(3)
    image = canvas(30, 20, GREEN, 0)
    image[..., 3] = np.where(rng.random((20, 30)) < 0.55, 255, 0)
    found = {(r.x, r.y): r.label for r in kernels.components(table(spark, [image]).withColumn("is_opaque", F.col("a") > 10)).collect()}
    label, want = 0, {}
    for y in range(20):
        for x in range(30):
            if image[y, x, 3] and (x, y) not in want:
                stack = [(x, y)]
                while stack:
                    p = stack.pop()
                    if p in want or not (0 <= p[0] < 30 and 0 <= p[1] < 20) or not image[p[1], p[0], 3]:
                        continue
                    want[p] = label
                    stack += [(p[0] + dx, p[1] + dy) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))]
                label += 1
    assert found == want


def test_cleanup(spark):
    image = fill(canvas(20, 20, GREEN, 0), 4, 4, 12, 12, GREEN)
    image[8, 8, 3], image[16, 16, 3] = 0, 255
    found = {(r.x, r.y): r.a for r in matte.cleaned(table(spark, [image]), 20, 20).collect()}
    assert found[8, 8] == 255 and found[16, 16] == 0 and found[4, 4] == 255


def _set(spark, boxes, colours=None, size=32):
    images = []
    for i, (x0, y0, x1, y1) in enumerate(boxes):
        images.append(fill(canvas(size, size, (0, 0, 0), 0), x0, y0, x1, y1, (colours or [BLUE] * len(boxes))[i]))
    return table(spark, images, frames=True)


def test_scores(spark):
    still = fr.scores(_set(spark, [(8, 8, 24, 28)] * 3)).first()
    assert still.identity >= 0.99 and still.motion == 0 and still.contact >= 0.95
    moving = fr.scores(_set(spark, [(2, 8, 12, 28), (10, 8, 20, 28), (18, 8, 28, 28)])).first()
    assert moving.motion >= 0.05
    jumping = fr.scores(_set(spark, [(8, 12, 24, 31), (8, 1, 24, 20), (8, 12, 24, 31)])).first()
    assert jumping.contact <= 0.5
    assert fr.scores(_set(spark, [(8, 8, 24, 28)])).first().overall == 0


def test_inspection_names_the_rules(spark):
    clean = fr.inspected(_set(spark, [(30, 30, 98, 98)] * 3, size=128)).collect()
    assert all(r.errors == [] and r.warnings == [] for r in clean)
    bad = fr.inspected(_set(spark, [(30, 30, 98, 98), (0, 30, 90, 98), (60, 60, 65, 65), (30, 30, 98, 98)], [BLUE, BLUE, BLUE, (250, 30, 250)], size=128)).orderBy("frame").collect()
    assert "edge" in bad[1].warnings and "empty" in bad[2].errors and "too_small" in bad[2].warnings and {"residue", "drift"} <= set(bad[3].errors)


def test_similarity_is_a_share(spark):
    rows = fr.palette_similarity(_set(spark, [(8, 8, 24, 28)] * 3, [BLUE, BLUE, GREEN])).orderBy("frame").collect()
    assert rows[0].similarity == pytest.approx(0.5) and rows[2].similarity == 0
    hist = fr.histograms(_set(spark, [(8, 8, 24, 28)] * 2)).groupBy("frame").agg(F.sum("share").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in hist)


def test_mirror_twice_is_the_frame(spark):
    rows = _set(spark, [(3, 8, 9, 20)])
    twice = layout.mirrored(layout.mirrored(rows))
    assert rows.exceptAll(twice).count() == 0 and rows.exceptAll(layout.mirrored(rows)).count() > 0


def _blocks(scale, size=64):
    image = canvas(size, size)
    y, x = np.divmod(np.arange(size * size), size)
    pick = (7 * (y // scale) + 3 * (x // scale)) % 3
    image[..., :3] = np.array([(200, 40, 40), (40, 200, 40), (40, 40, 200)])[pick].reshape(size, size, 3)
    return image


@pytest.mark.parametrize("scale", [4, 8])
def test_pixel_scale(spark, scale):
    assert palette.pixel_scale(table(spark, [_blocks(scale)]), 64, 64).first().scale == scale


def test_native_image_has_scale_one(spark):
    assert palette.pixel_scale(table(spark, [_blocks(1)]), 64, 64).first().scale == 1


def test_pixelized_blocks_are_uniform(spark):
    image = _blocks(8)
    image[:, 7, :3] = (120, 120, 40)
    out = palette.pixelized(table(spark, [image]).withColumn("frame", F.lit(0)), 8, 64, 64)
    assert out.groupBy((F.col("x") / 8).cast("int"), (F.col("y") / 8).cast("int")).agg(F.countDistinct("r", "g", "b").alias("n")).agg(F.max("n")).first()[0] == 1


def test_near_colours_share_a_palette_entry_and_alpha_is_cut(spark):
    a, b = canvas(16, 16, (200, 50, 50)), canvas(16, 16, (204, 54, 54))
    both = np.concatenate([a, b], axis=1)
    both[0, :4, 3] = (30, 127, 128, 255)
    rows = table(spark, [both])
    out = palette.applied(rows, palette.shared_palette(rows, 16))
    assert out.where("a = 255").select("r", "g", "b").distinct().count() == 1
    alpha = {r.x: r.a for r in out.where("y = 0 and x < 4").collect()}
    assert alpha == {0: 0, 1: 0, 2: 255, 3: 255}


def test_sheet_tags_and_durations(spark):
    import json

    idle, attack = _set(spark, [(4, 4, 20, 30)] * 2), _set(spark, [(4, 4, 20, 30)] * 3).withColumn("image_id", F.lit(1).cast("bigint"))
    states = spark.createDataFrame([(0, 7, 0, 8), (1, 7, 1, 12)], "image_id bigint, sheet bigint, row int, fps int")
    cells = layout.atlas(idle.unionByName(attack), states, 32, 32)
    sheet = json.loads(layout.sheet_json(cells, 32, 32).first().json)
    assert [f["duration"] for f in sheet["frames"]] == [125, 125, 83, 83, 83]
    assert [(t["from"], t["to"]) for t in sheet["meta"]["frameTags"]] == [(0, 1), (2, 4)]


def test_layers_meet_by_place(spark):
    under, upper = table(spark, [fill(canvas(3, 2, (10, 20, 30)), 0, 0, 1, 1, GREEN)]), table(spark, [canvas(4, 2, (200, 0, 0), 128)]).where("x > 0")
    found = {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in layout.over(under, upper).collect()}
    assert len(found) == 8 and found[0, 0] == (*GREEN, 255)
    assert found[3, 1] == (200, 0, 0, 128)  # nothing lies under it
    assert found[1, 0] == tuple(int((c * 128 + d * 127) / 255 + 0.5) for c, d in zip((200, 0, 0), (10, 20, 30))) + (255,)
    plan = layout.over(under, upper)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("thickness", [1, 2])
def test_outlines_are_the_empty_neighbours_of_opaque_pixels(spark, thickness):
    images = [fill(canvas(9, 7, (0, 0, 0), 0), 0, 2, 2, 3, GREEN), fill(canvas(9, 7, (0, 0, 0), 0), 4, 3, 5, 4, BLUE), canvas(9, 7), canvas(9, 7, (0, 0, 0), 0)]
    want = set()
    for i, image in enumerate(images):
        solid = {(x, y) for y, x in zip(*np.nonzero(image[..., 3]))}
        near = {(x + dx, y + dy) for x, y in solid for dx in range(-thickness, thickness + 1) for dy in range(-thickness, thickness + 1)}
        want |= {(i, int(x), int(y)) for x, y in near - solid if 0 <= x < 9 and 0 <= y < 7}
    ring = layout.outline(table(spark, images, frames=True), thickness)
    assert {(r.frame, r.x, r.y) for r in ring.collect()} == want
    assert layout.outline(table(spark, images, frames=True), thickness)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
