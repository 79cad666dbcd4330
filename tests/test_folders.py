"""Folders of files and bundles of sprites as data sources: filters, shares, all or nothing."""

import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.operators import export
from pixelmill.session import importable
from pixelmill.sources import folders, images


@pytest.fixture
def sources(spark):
    return importable(spark)


def tree(root, names):
    for name in names:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(name.encode())


def names(df):
    return sorted(f"{r.folder}/{r['name']}" for r in df.collect())


def test_files_of_folders(sources, tmp_path):
    tree(tmp_path, ["b.png", "A.PNG", "c.txt", "x/d.gif", "x/y/e.jpeg", "x/y/.f.png", ".hidden/g.png", "z/h.webp"])
    uri = tmp_path.as_uri()
    assert names(folders.files(sources, uri)) == ["/A.PNG", "/b.png", "x/d.gif", "x/y/e.jpeg", "z/h.webp"]
    assert names(folders.files(sources, uri, shares=3)) == names(folders.files(sources, uri))
    row = folders.files(sources, uri).where("name = 'd.gif'").first()
    assert bytes(row.content) == b"x/d.gif" and row.length == 7 and row.error is None
    small = folders.files(sources, uri, most_bytes=6).where("folder like 'x%'").collect()
    assert {(r["name"], r.content is None, r.error) for r in small} == {("d.gif", True, "too large"), ("e.jpeg", True, "too large")}
    assert folders.files(sources, (tmp_path / "none").as_uri()).count() == 0


def test_conditions_are_checked_before_files_are_opened(sources, tmp_path):
    tree(tmp_path, [f"{f}/frame-{i:02d}.png" for f in "ab" for i in range(3)] + ["a/other.png"])
    os.utime(tmp_path / "a/frame-00.png", (1_000_000_000, 1_000_000_000))
    uri = tmp_path.as_uri()
    listed = folders.files(sources, uri, content=False)
    assert listed.columns == ["folder", "name", "path", "length", "modified"]
    assert names(folders.files(sources, uri, False, folder="a", prefix="frame-", before="2005-01-01")) == ["a/frame-00.png"]
    assert names(folders.files(sources, uri, False, suffix="1.png", since="2005-01-01T00:00:00+02:00")) == ["a/frame-01.png", "b/frame-01.png"]
    # conditions on the table itself stay with Spark, and a table can be asked twice
    assert names(listed.where(F.col("folder").isin("b", "q"))) == [f"b/frame-0{i}.png" for i in range(3)] and listed.count() == 7
    assert {r.folder: r.n for r in folders.frame_counts(listed).collect()} == {"a": 3, "b": 3}


def test_the_newest_come_first_and_a_listing_ends(sources, tmp_path):
    tree(tmp_path, ["c.png", "a.png", "b.png"])
    for k, name in enumerate(["b.png", "c.png", "a.png"]):
        os.utime(tmp_path / name, (time.time() - k, time.time() - k))
    found = folders.files(sources, tmp_path.as_uri(), content=False)
    assert [r["name"] for r in folders.listing(found, newest_first=True).collect()] == ["b.png", "c.png", "a.png"]
    assert [r["name"] for r in folders.listing(found, most=2).collect()] == ["a.png", "b.png"]


ROWS = "bundle string, name string, content binary"


def bundles(spark, rows):
    return spark.createDataFrame([(b, n, bytearray(c)) for b, n, c in rows], ROWS)


def whole(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file())


def test_bundles_and_their_manifests(sources, tmp_path):
    out = tmp_path / "out"
    folders.write_bundles(bundles(sources, [("a", "s.png", b"1"), ("a", "f/i/0.png", b""), ("b", "s.png", b"22")]), out.as_uri())
    assert whole(out) == ["a/f/i/0.png", "a/manifest.json", "a/s.png", "b/manifest.json", "b/s.png"]
    assert json.loads((out / "b/manifest.json").read_text())["files"][0]["bytes"] == 2
    assert folders.manifests(sources, out.as_uri()).count() == 3
    folders.write_bundles(bundles(sources, [("a", "new.png", b"3")]), out.as_uri())
    assert whole(out) == ["a/manifest.json", "a/new.png", "b/manifest.json", "b/s.png"]
    folders.write_bundles(bundles(sources, [("c", "s.png", b"3")]), out.as_uri(), overwrite=True)
    assert whole(out) == ["c/manifest.json", "c/s.png"]
    folders.write_bundles(bundles(sources, []), out.as_uri())
    assert whole(out) == ["c/manifest.json", "c/s.png"]


def test_a_lost_task_leaves_no_half_bundle(sources, tmp_path):
    out = tmp_path / "out"
    folders.write_bundles(bundles(sources, [("a", "s.png", b"old")]), out.as_uri())
    rows = bundles(sources, [(b, f"{i}.png", b"x") for b in "abcdefgh" for i in range(3)])
    broken = rows.withColumn("content", F.when((F.col("bundle") == "h") & (F.col("name") == "2.png"), F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        folders.write_bundles(broken, out.as_uri())
    assert whole(out) == ["a/manifest.json", "a/s.png"] and (out / "a/s.png").read_bytes() == b"old"
    assert sorted(os.listdir(out)) == ["a"]


@pytest.mark.parametrize(("rows", "why"), [([("a", "x", b""), ("a", "x", b"")], "two files"), ([("a", "../x", b"")], "no name"), ([("a", "", b"")], "no name"), ([("a", "manifest.json", b"")], "two files"), ([("..", "x", b"")], "no name")])
def test_names_that_are_refused(sources, tmp_path, rows, why):
    with pytest.raises(Exception, match=why):
        folders.write_bundles(bundles(sources, [("ok", "x", b"1"), *rows]), tmp_path.as_uri())
    assert whole(tmp_path) == []


def test_a_failing_commit_puts_back_what_was_there(sources, tmp_path, monkeypatch):
    folders.write_bundles(bundles(sources, [("a", "x", b"old"), ("b", "x", b"old")]), tmp_path.as_uri())
    writer = folders.BundlesWriter({"path": tmp_path.as_uri()}, False)
    import pyarrow as pa

    staged = writer.write(iter([pa.record_batch([pa.array(["a", "b", "c"]), pa.array(["x"] * 3), pa.array([b"new"] * 3)], names=["bundle", "name", "content"])]))
    staged.bundles.append("gone")  # a bundle that cannot be moved
    with pytest.raises(OSError):
        writer.commit([staged])
    writer.abort([staged])
    assert whole(tmp_path) == ["a/manifest.json", "a/x", "b/manifest.json", "b/x"] and (tmp_path / "a/x").read_bytes() == b"old"
    with pytest.raises(ValueError, match="two tasks"):
        writer.commit([folders.Staged("f", ["a"]), folders.Staged("g", ["a"])])


def test_a_project_holds_every_kind_of_file(sources, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, f, x, y, *(int(v) for v in rng.integers(0, 256, 3)), 255, 8, 6) for i in (1, 2) for f in range(2) for x in range(8) for y in range(6)]
    frames = sources.createDataFrame(rows, "image_id bigint, frame int, x int, y int, r int, g int, b int, a int, w int, h int")
    states = sources.createDataFrame([(1, 7, 0, 10, True), (2, 7, 1, 0, False)], "image_id bigint, sheet bigint, row int, fps int, loop boolean")
    top = sources.createDataFrame([(i, 1, 9, 9, 9) for i in (1, 2)], "image_id bigint, rank int, r int, g int, b int")
    folders.write_bundles(export.project(frames, states, top, 8, 6), tmp_path.as_uri())
    assert whole(tmp_path) == ["7/7-manifest.json", "7/7-sprite-sheet.json", "7/7-sprite-sheet.png", "7/apng/1.png", "7/apng/2.png", *(f"7/frames/{i}/frame-0{k}.png" for i in (1, 2) for k in (0, 1)), "7/gif/1.gif", "7/gif/2.gif", "7/manifest.json"]
    described = json.loads((tmp_path / "7/7-manifest.json").read_text())
    assert described["sheet"]["width"] == 16 and described["animations"]["2"] | {"rects": 0, "trims": 0} == {"row": 1, "frames": 2, "fps": 8, "loop": False, "durationMs": 125, "pivot": {"x": 4, "y": 6}, "rects": 0, "trims": 0}
    sheet = images.decode_png((tmp_path / "7/7-sprite-sheet.png").read_bytes())
    assert sheet.shape == (12, 16, 4) and all(tuple(sheet[r[3] + 6 * (r[0] - 1), r[2] + 8 * r[1], :3]) == r[4:7] for r in rows)
