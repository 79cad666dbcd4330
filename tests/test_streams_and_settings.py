"""Attempts as a stream, several top lists at once, and settings from several layers."""

import random

from pyspark.sql import functions as F

from pixelmill.operators import corpus
from pixelmill.sources import settings
from pixelmill.streaming import live

ATTEMPTS = "state bigint, attempt int, expected int, found int, n_errors int"


def test_a_stream_ends_where_the_table_does(spark, tmp_path):
    rng = random.Random(3)
    rows = [(s, a, 4, rng.choice([3, 4, 4, 5]), rng.choice([0, 0, 1, 2])) for s in range(60) for a in range(rng.randint(1, 5))]
    rng.shuffle(rows)
    for k in range(4):  # four files, each a batch, in no order of attempts
        spark.createDataFrame(rows[k::4], ATTEMPTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    end = live.run_to_table(live.best_so_far(read), str(tmp_path / "out"))
    want = corpus.best_attempts(spark.createDataFrame(rows, ATTEMPTS)).drop("status")
    assert sorted(map(tuple, end.drop("closed").collect())) == sorted(map(tuple, want.collect()))
    again = live.run_to_table(live.best_so_far(read), str(tmp_path / "out"))  # nothing new: nothing changes
    assert again.count() == 60


def test_keys_close_when_the_watermark_has_passed_them(spark, tmp_path):
    kind = ATTEMPTS + ", made_at timestamp"
    parts = [[(1, 1, 4, 3, 0, "2024-01-01 00:00:00"), (2, 1, 4, 4, 0, "2024-01-01 00:01:00")], [(1, 2, 4, 4, 1, "2024-01-01 00:05:00")], [(3, 1, 4, 4, 0, "2024-01-01 03:00:00")], [(3, 2, 4, 4, 0, "2024-01-01 03:01:00")]]
    for k, part in enumerate(parts):
        rows = spark.createDataFrame(part, ATTEMPTS + ", made_at string").withColumn("made_at", F.to_timestamp("made_at"))
        rows.coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / f"in{k}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{k}-{f.name}")
    read = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    end = {r.state: r for r in live.run_to_table(live.best_so_far(read, late="30 minutes"), str(tmp_path / "out")).collect()}
    assert end[1].closed and (end[1].attempt, end[1].found, end[1].n_errors) == (2, 4, 1) and end[2].closed and not end[3].closed and end[3].attempt == 1


def test_status_has_four_classes(spark):
    rows = spark.createDataFrame([(4, 4, 0), (4, 3, 0), (4, 4, 2), (4, 4, None)], "expected int, found int, n_errors int")
    assert [r.s for r in rows.select(corpus.status().alias("s")).collect()] == ["ok", "frames", "quality", "partial"]


def test_top_lists(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 0.0, 1.5, 2.5, float("nan")]), rng.randint(0, 9)) for i in range(300)]
    table = spark.createDataFrame(rows, "id bigint, a double, b int")
    lists = corpus.top_lists(table, "id", [("first", "a", 5), ("second", "b", 12), ("none", "a", 0)])
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    got = {}
    for r in lists.orderBy("list", "rank").collect():
        got.setdefault(r["list"], []).append((r.id, r.value))
    best = lambda k, n: [(r[0], float(r[k])) for r in sorted((r for r in rows if r[k] is not None and r[k] == r[k]), key=lambda r: (-r[k], r[0]))[:n]]
    assert got == {"first": best(1, 5), "second": best(2, 12)}


SAVED, OUTSIDE = "owner int, name string, value string", "owner int, layer int, name string, value string"


def load(spark, saved, outside, **more):
    return {r.owner: r for r in settings.loaded(spark.createDataFrame(saved, SAVED), spark.createDataFrame(outside, OUTSIDE), **more).collect()}


def test_old_settings_become_the_first_services(spark):
    found = load(spark, [(1, "key", "old"), (1, "model", "m1"), (2, "key", "old"), (2, "gemini.key", "new"), (2, "model", "m1"), (2, "gemini.model", "m2"), (3, "key", " ")], [])
    assert (found[1].active, found[1].keys, found[1].models) == ("gemini", {"gemini": "old"}, {"gemini": "m1"})
    assert (found[2].keys, found[2].models) == ({"gemini": "new"}, {"gemini": "m2"}) and (found[3].active, found[3].keys) == ("gemini", {})


def test_saved_keys_come_before_layers_and_names_in_order(spark):
    outside = [(1, 0, "FAL_API_KEY", "b"), (1, 1, "FAL_KEY", "a"), (1, 1, "OPENAI_API_KEY", "outside"), (2, 2, "ARK_API_KEY", "late"), (2, 1, "ARK_API_KEY", ""), (2, 3, "ARK_API_KEY", "later"), (3, 0, "REPLICATE_API_KEY", "r")]
    found = load(spark, [(1, "openai.key", "own"), (1, "openai.model", "x"), (3, "service", "openai")], outside)
    assert found[1].keys == {"openai": "own", "fal": "a"} and found[1].active == "openai"
    assert found[2].keys == {"byteplus": "late"} and found[2].active == "byteplus" and found[3].active == "openai"


def test_configuration_of_a_service(spark):
    table = settings.loaded(spark.createDataFrame([(1, "gemini.key", "g"), (1, "fal.key", "f"), (1, "fal.model", "m")], SAVED), spark.createDataFrame([], OUTSIDE))
    rows = table.select(*(settings.configured(table, F.lit(s)).alias(s) for s in ("fal", "unknown", "openai"))).first()
    assert (rows.fal.key, rows.fal.model, rows.unknown.key, rows.openai.key) == ("f", "m", "g", None)


def test_other_services(spark):
    found = load(spark, [(1, "b.key", "k")], [(1, 0, "A_KEY", "x"), (2, 0, "B_KEY", "y")], services={"a": ["A_KEY"], "b": ["B_KEY"]})
    assert found[1].active == "a" and found[2].active == "b"
