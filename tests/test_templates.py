"""Pose templates by base state: coverage, directions, and when they are passed over."""

from pyspark.sql import functions as F

from pixelmill.operators import templates


def made(spark):
    files = spark.createDataFrame([("walk.png", bytearray(b"w")), ("attack.png", bytearray(b"a")), (".png", bytearray(b"x")), ("idle.gif", bytearray(b"i"))], "name string, content binary")
    return templates.templates_of(files)


def test_covered_names_are_sorted(spark):
    assert [r["name"] for r in templates.covered(made(spark)).collect()] == ["attack", "walk"]


def test_templates_by_base_state(spark):
    states = spark.createDataFrame([(1, "attack"), (2, " Attack-South-East "), (3, "walk-north"), (4, "idle"), (5, "attack-up"), (6, None)], "id int, state string")
    got = {r.id: r.template for r in templates.with_template(states, made(spark)).collect()}
    assert {k: bytes(v) if v else None for k, v in got.items()} == {1: b"a", 2: b"a", 3: b"w", 4: None, 5: None, 6: None}
    assert {r.base: r.n for r in templates.uncovered(states, made(spark)).collect()} == {"idle": 1, "attack-up": 1, None: 1}


def test_a_reference_comes_first_and_templates_can_be_off(spark):
    states = spark.createDataFrame([(1, "walk", True, False), (2, "walk", False, False), (3, "walk", True, True), (4, "walk", None, None)], "id int, state string, on boolean, own boolean")
    got = templates.with_template(states, made(spark), enabled=F.col("on"), reference=F.col("own"))
    assert got.columns == [*states.columns, "template"] and {r.id for r in got.where("template IS NOT NULL").collect()} == {1}
