"""Text helpers, catalog, settings, images, reports, and the registered queries against DuckDB."""

import io
import os
import struct

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pixelmill.functions import catalog, text
from pixelmill.operators import corpus
from pixelmill.plans import registry
from pixelmill.sources import images
from pixelmill.sources.settings import pairs_of, read_env
from pixelmill.streaming.live import running_report

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _one(value):
    if value is None or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, (float, np.floating)):
        return round(float(value), 6)
    return value.item() if hasattr(value, "item") else value


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(_one(v) for v in row) for row in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_duckdb(spark, duck, name):
    ours, theirs = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _rows(ours) == _rows(theirs)


def _eval(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_sizes_of_aspects(spark):
    assert _eval(spark, ["1:1", "16:9", "21:9", "x", None], text.strip_size) == ["1024x1024", "1792x1008", "1792x768", "1024x1024", "1024x1024"]
    assert _eval(spark, ["", "7:1", "1:1"], text.fitted_size) == ["2048x2048", "4096x1280", "4096x4096"]
    assert _eval(spark, ["32:9", "16:9", "4:3", "?"], text.snapped_aspect) == ["21:9", "16:9", "4:3", "?"]


def test_names(spark):
    assert _eval(spark, ["  a b/c  ", "--", "", "기사 1"], text.sanitized) == ["a-b-c", "character", "character", "기사-1"]
    assert _eval(spark, ["a b", ""], text.sanitized_strip) == ["a-b", "strip"]
    assert _eval(spark, [" Attack-South-East ", "attack-south", "idle", "north"], catalog.base_state) == ["attack", "attack", "idle", "north"]
    assert _eval(spark, ["123456789", "12345678"], text.masked) == ["1234····6789", ""]


def test_catalog(spark):
    rows = catalog.preset_rows()
    assert len(rows) == 100 == len({r[1] for r in rows}) and all(1 <= r[3] <= 10 and 1 <= r[4] <= 30 for r in rows)
    keys = {d[0] for d in catalog.DIRECTIONS}
    assert len(keys) == 8 and sum(d[2] is not None for d in catalog.DIRECTIONS) == 3 and all(d[2] in keys for d in catalog.DIRECTIONS if d[2])
    found = catalog.with_preset(spark.createDataFrame([("  IDLE ",), ("attack-south-east",), ("nope",)], "state string")).collect()
    assert [r.preset for r in found] == ["idle", "attack", None]


def test_settings(spark, tmp_path):
    lines = ["# note", "", 'export K="v"', "L='w'", "none", "E=", "A=b=c"]
    found = pairs_of(spark.createDataFrame([(v,) for v in lines], "line string")).collect()
    assert {r.key: r.value for r in found} == {"K": "v", "L": "w", "A": "b=c"}
    for i, value in enumerate(("one", "two")):
        (tmp_path / f"{i}.env").write_text(f"X={value}\n")
    assert read_env(spark, [str(tmp_path / "0.env"), str(tmp_path / "1.env")]).first().value == "two"


def test_attempts(spark):
    rows = [("a", 1, 4, 3, 0), ("a", 2, 4, 4, 1), ("a", 3, 4, 4, 0), ("b", 1, 4, 3, 0), ("b", 2, 4, 3, 0), ("b", 3, 4, 2, 0)]
    found = {r.state: (r.attempt, r.status) for r in corpus.best_attempts(spark.createDataFrame(rows, "state string, attempt int, expected int, found int, n_errors int")).collect()}
    assert found == {"a": (3, "ok"), "b": (1, "frames")}


def test_codecs(spark, tmp_path):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (9, 13, 4)).astype(np.uint8)
    assert (images.decode_png(images.encode_png(image)) == image).all()
    apng = images.encode_apng([image, image], 8, True)
    assert b"acTL" in apng and apng.count(b"fcTL") == 2 and (images.decode_png(apng) == image).all()
    gif = images.encode_gif([image], np.array([[0, 0, 0], [255, 255, 255]]), 8, True)
    assert gif[:6] == b"GIF89a" and struct.unpack("<HH", gif[6:10]) == (13, 9) and gif[-1:] == b"\x3b"
    rows = spark.createDataFrame([(1, 13, 9, bytearray(image.tobytes()))], "image_id bigint, w int, h int, pix binary")
    back = images.rasters_of(images.pixels_of(rows)).first()
    assert (back.w, back.h, bytes(back.pix)) == (13, 9, image.tobytes())
    files = images.png_bytes(rows).select(F.lit("a.png").alias("name"), "content")
    assert images.write_files(files, f"file://{tmp_path}/out").count() == 1
    listed = images.listing(spark, f"{tmp_path}/out").collect()
    assert [r.name for r in listed] == ["a.png"]
    decoded = images.decoded(images.contents(spark, f"{tmp_path}/out")).first()
    assert decoded.error is None and bytes(decoded.pix) == image.tobytes()
    broken = images.decoded(spark.createDataFrame([("x", bytearray(b"no"))], "path string, content binary")).first()
    assert broken.error and broken.pix is None


def test_gif_decodes_to_its_codes():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 7, 5000)
    data, bits = images._lzw(codes, 8), 8
    stream, at = io.BytesIO(), 0
    while data[at]:
        stream.write(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    value, place, size, table, last, out = int.from_bytes(stream.getvalue(), "little"), 0, bits + 1, {}, None, []
    while True:
        code = value >> place & ((1 << size) - 1)
        place += size
        if code == 257:
            break
        if code == 256:
            table, size, last = {i: [i] for i in range(256)} | {256: [], 257: []}, bits + 1, None
            continue
        entry = table[code] if code in table else last + [last[0]]
        out += entry
        if last is not None and len(table) < 4096:
            table[len(table)] = last + [entry[0]]
            if len(table) == 1 << size and size < 12:
                size += 1
        last = entry
    assert out == codes.tolist()


def test_thumbnails(spark):
    image = np.zeros((300, 600, 4), np.uint8)
    rows = spark.createDataFrame([(1, 600, 300, bytearray(image.tobytes()))], "image_id bigint, w int, h int, pix binary")
    found = images.thumbnails(rows).first()
    assert (found.w, found.h) == (200, 100)


def test_data_urls(spark):
    rows = spark.createDataFrame([(bytearray(range(200)),)], "content binary").select(images.data_url(F.col("content"), F.lit("image/png")).alias("u"))
    back = rows.select(images.data_url_bytes(F.col("u")).alias("b"), images.data_url_bytes(F.lit("http://x")).alias("n")).first()
    assert bytes(back.b) == bytes(range(200)) and back.n is None


def test_running_report_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "c", "ok", 1.0), ("2024-01-01 00:05:00", "c", "bad", 0.5), ("2024-01-01 00:15:00", "c", "ok", 1.0)], "t string, category string, status string, score double")
    rows = rows.selectExpr("cast(t as timestamp) as made_at", "category", "status", "score")
    rows.write.parquet(str(tmp_path / "in"))
    stream = running_report(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("totals").start()
    query.processAllAvailable()
    query.stop()
    found = spark.sql("select * from totals").orderBy("start").collect()
    assert [(r.total, r.passed) for r in found] == [(2, 1), (1, 1)] == [(r.total, r.passed) for r in running_report(rows).orderBy("start").collect()]


def test_registry_has_no_orphan_texts():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_presets_are_found_by_name_label_and_category(spark):
    from pixelmill.functions import catalog

    rows = spark.createDataFrame([(" FALLING ",), ("low hp",), ("heavy att",), ("combat idle",), ("basics",), ("nothing",), ("",), (None,)], "q string")
    found = {r.q: r.n for r in rows.select("q", catalog.found_presets(F.col("q")).alias("n")).collect()}
    names = [row[1] for row in catalog.preset_rows()]
    assert found[" FALLING "] == ["death-fall"] and found["low hp"] == ["low-hp"] and found["heavy att"] == ["attack-heavy"] and found["combat idle"] == ["idle-combat"]
    assert found["basics"] == [row[1] for row in catalog.preset_rows() if row[2] == "Basics"] and found["nothing"] == [] and found[""] == names and not found[None]
