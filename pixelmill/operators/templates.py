"""Pose templates: image files named by states, looked up by a state's name without its direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import base_state


def templates_of(files: DataFrame) -> DataFrame:
    """(name, content) of image files (name, content): PNGs with a name before the ending, which is the state's."""
    rows = files.where(F.col("name").endswith(".png") & (F.length("name") > 4))
    return rows.select(F.expr("substring(name, 1, length(name) - 4)").alias("name"), "content")


def covered(templates: DataFrame) -> DataFrame:
    """The names that have a template, in order; no content is read."""
    return templates.select("name").distinct().orderBy("name")


def with_template(states: DataFrame, templates: DataFrame, state: str = "state", enabled: Column | None = None, reference: Column | None = None) -> DataFrame:
    """``states`` with ``template``: the content of the file that its base name has, null if there is none.

    Only where templates are ``enabled`` (default: everywhere) and there is no ``reference`` of the state's own, which always comes first. States that are
    not to have one never meet the contents.
    """
    asked = (F.lit(True) if enabled is None else F.coalesce(enabled, F.lit(False))) & ~(F.lit(False) if reference is None else F.coalesce(reference, F.lit(False)))
    rows = states.withColumn("_base", F.when(asked, base_state(F.col(state))))
    named = templates.groupBy("name").agg(F.first("content").alias("template"))
    return rows.join(named, F.col("_base") == F.col("name"), "left").select(*states.columns, "template")


def uncovered(states: DataFrame, templates: DataFrame, state: str = "state") -> DataFrame:
    """(base, n): base names of states that no template covers, and how many states that concerns."""
    rows = states.groupBy(base_state(F.col(state)).alias("base")).agg(F.count("*").alias("n"))
    return rows.join(templates.select(F.col("name").alias("base")).distinct(), "base", "left_anti")
