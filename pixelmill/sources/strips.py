"""Pixel tables derived from the supplier table: one strip of 96 x 32 pixels a supplier.

Strips hold 2 to 4 figures with soft rims on a magenta ground; every fifth strip has a bridge that joins its
figures. All arithmetic is on integers, so any engine derives the same pixels. On images of one's own,
the operators take tables of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT = 96, 32
#: Strips that a task makes pixels of, so that its memory does not grow with the table.
STRIPS = 128


def strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, expected (figures that were drawn), slot (columns a figure has); dealt by image.

    A supplier is some bytes and its strip thousands of rows, so a scan's few tasks would not do. What groups or joins by image
    finds its rows dealt already.
    """
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("image_id"))
    rows = rows.repartition(max(1, -(-rows.count() // STRIPS)), "image_id")
    rows = rows.withColumn("expected", (2 + F.col("image_id") % 3).cast("int"))
    return rows.withColumn("slot", F.expr(f"cast({WIDTH} div expected as int)"))


def places(spark: SparkSession) -> DataFrame:
    """p: the places of a strip, by rows."""
    return spark.range(0, WIDTH * HEIGHT, 1, 1).select(F.col("id").alias("p"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, expected, slot, pose, lx (column in the figure's slot), x, y, r, g, b, a: a row a pixel.

    Rows are made in the tasks of their strips; no row is moved. They come from a cross join with a strip's places, not from a generator, whose
    number of rows Spark does not estimate: it would take pixels for small enough to broadcast.
    """
    grid = strips(spark, sf_dir).crossJoin(F.broadcast(places(spark)))
    grid = grid.selectExpr("image_id", "expected", "slot", f"cast(p % {WIDTH} as int) as x", f"cast(p div {WIDTH} as int) as y")
    grid = grid.selectExpr("*", "cast(least(expected - 1, x div slot) as int) as pose", "cast(slot div 4 as int) as q")
    grid = grid.selectExpr("*", "x - pose * slot as lx", "cast(40 + (image_id * 37) % 160 as int) as fr", "cast(60 + (image_id * 53 + pose * 4) % 160 as int) as fg", "cast(30 + (image_id * 29) % 90 as int) as fb")
    core = f"(lx >= q AND lx < slot - q AND y >= 6 + pose AND y < 28) OR (image_id % 5 = 0 AND y >= 16 AND y < 19 AND x >= q AND x < {WIDTH} - q)"
    rim = "lx >= q - 2 AND lx < slot - q + 2 AND y >= 4 + pose AND y < 30"
    zone = grid.selectExpr("*", f"CASE WHEN {core} THEN 2 WHEN {rim} THEN 1 ELSE 0 END AS zone")
    return zone.selectExpr(
        "image_id", "expected", "slot", "pose", "cast(lx as int) as lx", "x", "y",
        "cast(CASE zone WHEN 2 THEN fr WHEN 1 THEN (fr + 765) div 4 ELSE 255 END as int) as r",
        "cast(CASE zone WHEN 2 THEN fg WHEN 1 THEN fg div 4 ELSE 0 END as int) as g",
        "cast(CASE zone WHEN 2 THEN fb WHEN 1 THEN (fb + 765) div 4 ELSE 255 END as int) as b",
        "255 AS a",
    )
