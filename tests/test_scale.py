"""Plans at size: pixels are never broadcast, and a task's share of strips is bounded."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pixelmill.operators import frames as fr, kernels, layout, palette, profile
from pixelmill.sources import folders, images, strips as source
from pixelmill.streaming import live


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """300 suppliers in one file."""
    folder = tmp_path_factory.mktemp("many")
    spark.range(300).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


def joins(df) -> list[str]:
    """The broadcast joins of a plan, as they stand before AQE."""
    return re.findall(r"Broadcast\w*Join[^\n]*Build[^\n]*", df._jdf.queryExecution().sparkPlan().toString())


@pytest.mark.parametrize("name", ["gap_run_boxes", "remove_background", "stacked_panels", "strip_concat", "base_rules", "base_similarity", "tight_crop", "body_extent_ratio", "shared_box_placement"])
def test_only_a_strips_places_are_broadcast(spark, many, name):
    found = joins(entry.queries()[name](spark, many))
    assert found and all(f.startswith("BroadcastNestedLoopJoin BuildRight, Cross") for f in found), found


def test_pixels_are_made_by_many_tasks(spark, many):
    made = source.pixels(spark, many)
    per_task = [n for n in made.select("image_id").rdd.mapPartitions(lambda rows: [len({r.image_id for r in rows})]).collect() if n]
    assert sum(per_task) == 300 and len(per_task) >= 3 and max(per_task) < 2 * source.STRIPS
    assert made.count() == 300 * source.WIDTH * source.HEIGHT


@pytest.mark.parametrize(("name", "passes"), [("extract_contents", 2), ("label_owner_rangejoin", 1)])
def test_components_are_labelled_once(spark, many, name, passes):
    """One pass over pixels for the labels, and one for the profile where spans come from it."""
    plan = entry.queries()[name](spark, many)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Range (0, 3072") == passes


def test_owned_boxes_are_the_contents_of_owners(spark):
    rows = [(1, x, y, 10 * x + y + 1, label) for label, xs in ((0, (0, 1, 2)), (1, (4, 5)), (2, (8, 9))) for x in xs for y in (0, label + 1)] + [(2, 3, 3, 7, 0)]
    labelled = spark.createDataFrame(rows, "image_id bigint, x int, y int, a int, label int")
    spans = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 1, 6), (3, 0, 0, 9)], "image_id bigint, seg int, x0 int, x1 int")
    owner = profile.owners(labelled, spans)
    assert {(r.image_id, r.label): r.owner for r in owner.collect()} == {(1, 0): 1, (1, 1): 1, (1, 2): -1, (2, 0): -1}
    expected = profile.contents(labelled, owner)
    assert sorted(profile.owned_boxes(labelled, spans).collect()) == sorted(expected.collect())


def test_many_folders_are_few_partitions(spark, tmp_path):
    expected = set()
    for i in range(100):
        for below in ("", "a", "a/b", ".hidden"):
            folder = tmp_path / f"set-{i:03}" / below
            folder.mkdir(parents=True, exist_ok=True)
            (folder / "one.png").write_bytes(b"%d" % i)
            if below != ".hidden":
                expected.add((f"set-{i:03}/{below}".rstrip("/"), "one.png", b"%d" % i))
    (tmp_path / ".stage").mkdir()
    (tmp_path / ".stage" / "no.png").write_bytes(b"no")
    (tmp_path / "top.png").write_bytes(b"top")
    for shares in (1, 3):
        found = folders.files(spark, f"file://{tmp_path}", shares=shares)
        rows = found.collect()
        assert {(r.folder, r.name, bytes(r.content)) for r in rows} == expected | {("", "top.png", b"top")} and len(rows) == 301
        assert found.rdd.getNumPartitions() == 5 * shares


def test_attempts_that_never_close_are_an_aggregation(spark, tmp_path):
    """A Python call a key is kept for streams whose keys are timed out."""
    read = spark.readStream.schema("state bigint, attempt int, expected int, found int, n_errors int, made_at timestamp").parquet(str(tmp_path))
    plans = [live.best_so_far(read, late=late)._jdf.queryExecution().logical().toString() for late in (None, "1 hour")]
    assert ["WithState" in p for p in plans] == [False, True]


@pytest.mark.parametrize(("name", "kernels"), [("extract_frames", 1), ("extract_cells", 3), ("sample_scan", 3)])
def test_figures_are_found_once(spark, many, name, kernels):
    """A pass over a strip's figures, one over its cells and one over their sums; no row a pixel comes out of a cell."""
    plan = entry.queries()[name](spark, many)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ArrowEvalPython") == kernels and plan.count("MapInArrow") == 1


def test_sums_of_rasters_are_those_of_their_pixels(spark):
    rows = [(i, w, h, bytearray((j * 37 + i * 11) % 256 for j in range(w * h * 4))) for i, (w, h) in enumerate(((5, 3), (1, 9), (40, 30)))] + [(3, 2, 2, bytearray(16))]
    made = spark.createDataFrame(rows, "image_id bigint, w int, h int, pix binary")
    on = F.col("a") > 10
    sums = images.pixels_of(made).groupBy("image_id").agg(
        F.count_if(F.col("a") > 0), F.count_if(on), F.sum(F.when(on, F.col("x")).otherwise(0)), F.sum((F.col("x") + 1) * (F.col("y") + 1) * F.col("a")), *(F.sum(c) for c in "rgba")
    )
    assert sorted(map(tuple, images.sums_of(made, "image_id").collect())) == sorted(map(tuple, sums.collect()))


def test_frames_sums_are_balance_and_spread(spark):
    rows = [(i, f, x, y, 255 if f < 2 and (x * 7 + y * 3 + i) % (f + 2) else 0, 9) for i in range(3) for f in range(2 + i % 2) for x in range(9) for y in range(4)]
    made = spark.createDataFrame(rows, "image_id bigint, frame int, x int, y int, a int, w int")
    both = fr.balance(made).select("image_id", "ratio").join(fr.centroid_spread(made), "image_id")
    assert sorted(fr.steadiness(fr.opaque_sums(made)).collect()) == sorted(both.collect())


def test_files_are_made_where_their_pixels_are(spark, many):
    plan = entry.queries()["file_round_trip"](spark, many)._jdf.queryExecution().logical().toString()
    assert "FlatMapGroupsInArrow" not in plan


def test_component_boxes_are_those_of_components(spark):
    rng = np.random.default_rng(29)
    rows = [(i, x, y, bool(rng.random() < 0.55) if i < 4 else i == 5) for i in range(6) for y in range(17) for x in range(23)]
    made = spark.createDataFrame(rows, "image_id bigint, x int, y int, is_opaque boolean").unionByName(spark.createDataFrame([(9, 0, 0, None)], "image_id bigint, x int, y int, is_opaque boolean")).coalesce(1)
    ends = [f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))]
    expected = sorted(map(tuple, kernels.components(made).groupBy("image_id", "label").agg(F.count("*").alias("n"), *ends).collect()))
    assert len(expected) > 20
    for clustered in (False, True):
        assert sorted(map(tuple, kernels.component_boxes(made, clustered=clustered).collect())) == expected


def test_components_send_no_pixels_back(spark, many):
    """What comes out of the kernel is a row a component, so nothing is summed behind it."""
    plan = entry.queries()["components"](spark, many)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Aggregate" not in plan


def noisy(spark, seed: int, most: int = 4):
    """Sets of frames of several sizes as pixels in one partition; set 3 shows nothing."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(4):
        for f in range(1 + i % most):
            w, h = (33 + f, 36) if i % 2 else (7, 5 + f)
            level = rng.integers(0, 4, (h, w, 4)) * 64 + rng.integers(0, 3, (h, w, 4))
            rows += [(i, f, x, y, *(int(v) for v in level[y, x, :3]), 0 if i == 3 else int(level[y, x, 3]), w, h) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id bigint, frame int, x int, y int, r int, g int, b int, a int, w int, h int").coalesce(1)


def test_a_sets_common_palette_is_the_gif_palette(spark):
    frames = noisy(spark, 24)
    top = palette.gif_palette(frames, 6).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("rank", "r", "g", "b"))).alias("c"))
    expected = {r.image_id: [[c.r, c.g, c.b] for c in r.c] for r in top.collect()}
    for clustered in (False, True):
        found = {r.image_id: r.colours for r in palette.common_palette(images.sets_of(frames, clustered=clustered), 6).collect()}
        assert found == expected | {3: None}


def test_sets_are_post_processed_as_their_rasters(spark):
    frames = noisy(spark, 25)
    sets = palette.common_palette(images.sets_of(frames, clustered=True), 6)
    top = palette.gif_palette(frames, 6).withColumnRenamed("rank", "ord")
    own = palette.post_processed_rasters(images.rasters_of(frames, frame="frame"), top)
    assert sorted(map(tuple, palette.post_processed_sets(sets).collect())) == sorted(map(tuple, own.collect()))
    assert own.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # not joined into one task for being small


def test_post_process_is_one_scan(spark, many):
    plan = entry.queries()["post_process"](spark, many)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Range (0, 3072") == 1 and plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1 and "Window" not in plan


def test_onion_skins_fold_frames_in_order(spark):
    frames = noisy(spark, 26)
    expected = {}
    for r in sorted(frames.collect(), key=lambda r: (r.image_id, r.frame)):
        under = expected.setdefault((r.image_id, r.x, r.y), (0, 0, 0))
        if r.a > 10:
            expected[r.image_id, r.x, r.y] = tuple((u * 165 + v * 90) // 255 for u, v in zip(under, (r.r, r.g, r.b), strict=True))
    for clustered in (False, True):
        found = {(r.image_id, r.x, r.y): (r.r, r.g, r.b) for r in fr.onion_skin(frames, clustered=clustered).collect()}
        assert {k: v for k, v in found.items() if any(v)} == {k: v for k, v in expected.items() if any(v)} and set(expected) <= set(found)


def test_onion_skins_are_blended_in_a_row_a_set(spark, many):
    """No list of structs a place: places are blended as a raster where they are made."""
    plan = entry.queries()["onion_skin"](spark, many)._jdf.queryExecution().sparkPlan().toString()
    assert "collect_list" not in plan and plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1


def test_outlines_and_silhouettes_are_one_scan(spark, many):
    """Frames are not dealt again, nor joined with themselves."""
    plan = entry.queries()["silhouette_outline"](spark, many)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Range (0, 3072") == 1 and plan.count("Exchange") == 1 and "SortMergeJoin" not in plan


def test_rings_are_the_empty_places_beside_content(spark):
    on = {(2, 2), (3, 2), (7, 5)}
    rows = [(1, 0, x, y, 255 if (x, y) in on else None if x == 4 else 0, i) for i, (x, y) in enumerate((x, y) for y in range(8) for x in range(9))]
    made = spark.createDataFrame(rows, "image_id bigint, frame int, x int, y int, a int, n int").coalesce(1)
    expected = {(x, y) for x in range(9) for y in range(8) if (x, y) not in on and any(abs(x - u) <= 1 and abs(y - v) <= 1 for u, v in on)}
    for dealt in (False, True):
        found = layout.ringed(made, 1, dealt)
        assert found.columns == [*made.columns, "ring"] and {(r.x, r.y) for r in found.where("ring").collect()} == expected
        assert {(r.x, r.y) for r in layout.outline(made, 1, dealt).collect()} == expected


def test_extents_take_one_pass(spark, many):
    plan = entry.queries()["body_extent"](spark, many)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Range (0, 3072") == 1 and plan.count("Join") == plan.count("BroadcastNestedLoopJoin") == 1


def test_extents_of_images_without_mass_are_zero(spark):
    rows = [(1, x, y, 200 if 3 <= x < 7 and 2 <= y < 5 else 0) for y in range(9) for x in range(12)] + [(2, x, 0, None if x else 0) for x in range(3)] + [(3, 40, 60, 9), (4, 5, 5, -7)]
    made = spark.createDataFrame(rows, "image_id bigint, x int, y int, a int")
    assert sorted(map(tuple, profile.extents(made, share=1.0).collect())) == [(1, 4, 3), (2, 0, 0), (3, 1, 1), (4, 0, 0)]
