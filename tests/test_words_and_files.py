"""Request words, settings, sessions, files and reports on small inputs."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill import session
from pixelmill.functions import catalog, text
from pixelmill.operators import corpus
from pixelmill.sources import images, settings


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'int' if isinstance(values[n], int) else 'string'}" for n in names))
    return row.select(column).first()[0]


def test_words_of_requests(spark):
    assert one(spark, text.view_word(F.col("p")), p=" ISO ") == "high-angle" and one(spark, text.view_word(F.col("p")), p=None) == "side-view"
    assert one(spark, text.with_view(F.col("t"), F.col("p")), t="{view} and {view}", p="flat") == "side-view and side-view"
    assert one(spark, text.without_phrases(F.col("t"), text.TURNED), t="runs facing right, facing left") == "runs,"
    assert one(spark, text.canvas_words(F.col("a")), a="4:3") == "Render on a wide 4:3 landscape canvas." and "square" in one(spark, text.canvas_words(F.col("a")), a=None)
    assert [one(spark, text.spare_cells(F.col("n")), n=n) for n in (0, 1, 3, 4, 5, 7, 8)] == [0, 0, 0, 0, 1, 1, 0]
    assert [one(spark, text.first_output(F.col("v")), v=v) for v in ('"a\\"b"', '["x", "y"]', "[]", "{}", "", None, "nonsense")] == ['a"b', "x", "", "", "", "", ""]
    styles = {"pixel": "true pixels", "soft": "soft paint"}
    assert [one(spark, text.style_of(F.col("k"), F.col("c"), styles), k=k, c=c) for k, c in (("soft", None), ("soft", "  "), ("none", ""), (None, " own "))] == ["soft paint", "soft paint", "true pixels", "own"]
    assert [one(spark, catalog.shows_back(F.col("d")), d=d) for d in ("north", "south", None)] == [True, False, False]
    assert one(spark, catalog.service(F.col("s")), s="what").label == "Gemini" and one(spark, catalog.service(F.col("s")), s="fal").label == "fal.ai"


def test_settings_by_precedence(spark):
    rows = spark.createDataFrame([(2, "a", "two"), (1, "a", " "), (3, "a", "three"), (1, "b", "one"), (1, "c", None)], "source int, key string, value string")
    assert {r.key: r.value for r in settings.merged(rows).collect()} == {"a": "two", "b": "one"}


def test_sessions_come_back(spark):
    rows = spark.createDataFrame([(1, "x\n\"y\"", None, [1, 2]), (2, None, 0.5, []), (None, "", 1.0, None)], "id int, name string, v double, n array<int>")
    path = session.shared_path(spark, "test")
    settings.save_session(rows, path)
    back = settings.load_session(spark, path, "id int, name string, v double, n array<int>")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, rows.collect()))


def test_frames_are_counted_and_strips_listed(spark, tmp_path):
    for name in ("a/frame-0.png", "a/frame-1.PNG", "a/other.png", "b/frame-0.png", "b/frame-0.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert {r.folder: r.n for r in images.frame_counts(spark, str(tmp_path)).collect()} == {"a": 2, "b": 1}
    (tmp_path / "strips.json").write_text('[{"name": "walk", "frames": 6,\n "path": "w.png"}, {"name": "idle"}]')
    assert [(r.name, r.frames, r.path) for r in images.strip_entries(spark, str(tmp_path / "strips.json")).collect()] == [("walk", 6, "w.png"), ("idle", None, None)]


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_every_png_filter_is_undone(kind):
    rng = np.random.default_rng(kind)
    image = rng.integers(0, 256, (7, 9, 4)).astype(np.int64)
    lines, above = [], np.zeros(36, dtype=np.int64)
    for row in image.reshape(7, 36):
        left, corner = np.concatenate([[0] * 4, row[:-4]]), np.concatenate([[0] * 4, above[:-4]])
        p = left + above - corner
        a, b, c = abs(p - left), abs(p - above), abs(p - corner)
        guess = [0 * row, left, above, (left + above) >> 1, np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))][kind]
        lines.append(bytes([kind]) + ((row - guess) & 255).astype(np.uint8).tobytes())
        above = row
    head = struct.pack(">IIBBBBB", 9, 7, 8, 6, 0, 0, 0)
    content = images._SIGNATURE + images._chunk(b"IHDR", head) + images._chunk(b"IDAT", zlib.compress(b"".join(lines))) + images._chunk(b"IEND", b"")
    assert (images.decode_png(content) == image).all()


def test_selection_names_what_is_missing(spark):
    rows = spark.createDataFrame([("Idle",), ("walk",), (None,)], "name string")
    kept, missing = corpus.named_selection(rows, "name", ["IDLE ", "run", ""])
    assert [r.name for r in kept.collect()] == ["Idle"] and [r.asked for r in missing.collect()] == ["run"]


def test_accuracy_has_a_target(spark):
    rows = spark.createDataFrame([(2, 2), (2, 2), (3, 3), (3, 1)], "expected int, found int")
    found = {r.expected: (r.strips, r.exact, r.accuracy, r.passed) for r in corpus.accuracy(rows, 0.7).collect()}
    assert found == {2: (2, 2, 1.0, True), 3: (2, 1, 0.5, False), None: (4, 3, 0.75, True)}


def test_cards_escape_names(spark):
    best = spark.createDataFrame([("<a&b>", "ok", 4, 4, 0)], "state string, status string, found int, expected int, n_errors int")
    assert corpus.gallery(best).first().html == '<figure class="ok"><figcaption>&lt;a&amp;b&gt;: 4/4, 0 errors</figcaption></figure>'
