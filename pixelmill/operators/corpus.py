"""Corpus-level reports: attempts, pass rates, samples by category, line crossings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best_attempts(attempts: DataFrame, keys: tuple[str, ...] = ("state",)) -> DataFrame:
    """Of each state the first attempt that passes, else the one with the best found * 100 - errors * 10 (the first of equals).

    ``attempts``: keys, attempt, expected, found, n_errors. Attempts after a pass were never made, and do not count.
    """
    passed = (F.col("found") == F.col("expected")) & (F.col("n_errors") == 0)
    order = F.struct(F.when(passed, 1).otherwise(0).alias("p"), F.when(passed, F.lit(0)).otherwise(F.col("found") * 100 - F.col("n_errors") * 10).alias("s"), -F.col("attempt"))
    best = attempts.groupBy(*keys).agg(F.max_by(F.struct("attempt", "expected", "found", "n_errors"), order).alias("b"))
    rows = best.select(*keys, "b.*")
    return rows.withColumn("status", status())


def status() -> Column:
    """What became of an attempt: ``ok``, ``frames`` (another number than expected), ``quality`` (errors), or ``partial`` where its errors are not known."""
    ok = (F.col("found") == F.col("expected")) & (F.col("n_errors") == 0)
    return F.when(ok, "ok").when(F.col("found") != F.col("expected"), "frames").when(F.col("n_errors") > 0, "quality").otherwise("partial")


def quality_report(results: DataFrame, category: str = "category") -> DataFrame:
    """Totals by category and over all (null): number, passes, mismatches, defects, pass rate, mean score, static share."""
    return results.rollup(category).agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("passed"), F.count_if(F.col("found") != F.col("expected")).alias("mismatched"),
        F.count_if(F.col("n_errors") > 0).alias("defects"), F.round(F.avg((F.col("status") == "ok").cast("double")), 6).alias("pass_rate"),
        F.round(F.avg("score"), 6).alias("mean_score"), F.count_if(F.col("motion") < 0.02).alias("static"),
    )


def accuracy(found: DataFrame, target: float = 0.85) -> DataFrame:
    """(expected, strips, exact, found, accuracy, passed) of strips (expected, found), and over all (expected null).

    ``passed``: whether the share of exact numbers reaches the target.
    """
    exact = F.col("found") == F.col("expected")
    share = F.avg(exact.cast("double"))
    return found.rollup("expected").agg(F.count("*").alias("strips"), F.count_if(exact).alias("exact"), F.sum("found").alias("found"), F.round(share, 6).alias("accuracy"), (share >= target).alias("passed"))


def compared(now: DataFrame, before: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """An old report beside a new one: keys, each value, its old value and the change; rows that only one has keep nulls."""
    old = before.select(*keys, *(F.col(v).alias(f"old_{v}") for v in values))
    rows = now.select(*keys, *values).join(old, keys, "full")
    return rows.select(*keys, *(c for v in values for c in (F.col(v), F.col(f"old_{v}"), (F.col(v) - F.col(f"old_{v}")).alias(f"{v}_change"))))


def roster(best: DataFrame, character: str) -> DataFrame:
    """(character, states, ok, frames, quality, ready): each character's states by status, from their best attempts."""
    kinds = [F.count_if(F.col("status") == k).alias(k) for k in ("ok", "frames", "quality")]
    return best.groupBy(character).agg(F.count("*").alias("states"), *kinds).withColumn("ready", F.col("ok") == F.col("states"))


def gallery(best: DataFrame, state: str = "state") -> DataFrame:
    """(state, html): a card for a page of results; what is a name in it is escaped."""
    name = F.col(state).cast("string")
    for sign, word in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        name = F.replace(name, F.lit(sign), F.lit(word))
    told = F.concat(F.lit('<figure class="'), F.col("status"), F.lit('"><figcaption>'), name, F.lit(": "), F.col("found"), F.lit("/"), F.col("expected"), F.lit(", "), F.col("n_errors"), F.lit(" errors</figcaption></figure>"))
    return best.select(state, told.alias("html"))


def named_selection(rows: DataFrame, column: str, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose name is asked for, names asked for that no row has)."""
    asked = rows.sparkSession.createDataFrame([(n.strip().lower(),) for n in names if n.strip()], "asked string").distinct()
    key = F.lower(F.trim(F.col(column)))
    return rows.join(F.broadcast(asked), key == F.col("asked"), "left_semi"), asked.join(rows.select(key.alias("asked")).distinct(), "asked", "left_anti")  # the caller's list


def first_per_group(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each group; Spark prunes each partition before the shuffle."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def crossings(profile: DataFrame, parts: DataFrame) -> DataFrame:
    """(image_id, crossed): even cut lines of ``parts`` (image_id, n, width) that meet more than 6 % of the largest mass.

    ``profile`` counts opaque pixels by column.
    """
    top = profile.groupBy("image_id").agg(F.max("mass").alias("top"))
    lines = parts.where("n > 1").select("image_id", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"), "n", "width").selectExpr("image_id", "cast(k * width div n as int) as pos")
    met = lines.join(profile, ["image_id", "pos"]).join(top, "image_id")
    return met.groupBy("image_id").agg(F.count_if(F.col("mass") > F.lit(0.06) * F.col("top")).alias("crossed"))


def top_lists(rows: DataFrame, key: str, lists: list[tuple[str, str, int]]) -> DataFrame:
    """(list, rank, key, value): for each (name, measure, n) the n rows with the largest measure, ties by key; a null or NaN measure is in no list.

    All lists come from one pass: rows are told apart by list where they are made, each task keeps its own best, and only those are shuffled.
    """
    cells = F.array(*[F.struct(F.lit(name).alias("list"), F.lit(n).alias("most"), F.col(measure).cast("double").alias("value")) for name, measure, n in lists])
    each = rows.select(key, F.inline(cells)).where("value IS NOT NULL AND NOT isnan(value)")
    rank = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("value"), key))
    most = max(n for *_, n in lists)
    return each.withColumn("rank", rank).where(F.col("rank") <= most).where("rank <= most").select("list", "rank", key, "value")


def scanned(strips: DataFrame, even: DataFrame, cut: DataFrame, crossed: DataFrame) -> DataFrame:
    """A row a strip with at least two figures: what even parts do to it beside what extraction does.

    ``even`` and ``cut`` are (image_id, ratio, spread) of the frames of both ways, ``cut`` with the number ``found``; ``crossed`` has image_id and crossed.
    """
    def named(rows, tail):
        return rows.withColumnsRenamed({"ratio": f"balance_{tail}", "spread": f"spread_{tail}"})

    rows = strips.select("image_id", "expected").where("expected >= 2")
    for other in (named(even, "even"), named(cut, "cut"), crossed):
        rows = rows.join(other, "image_id", "left")
    gain = F.when(F.col("balance_cut") > 0, F.col("balance_even") / F.col("balance_cut")).otherwise(F.col("balance_even"))
    return rows.withColumns({"segment_gain": gain, "centre_gain": F.col("spread_even") - F.col("spread_cut"), "missed": F.coalesce("found", F.lit(0)) != F.col("expected")})
