"""Projection profiles and what is found on them: runs, peaks, cuts, extents, owners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..constants import ALPHA_T, BODY_SHARE, RUN_EPS, RUN_MASS, RUN_PEAK
from . import lines as ln


def projected(pixels: DataFrame, axis: str = "x", keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keys, pos, mass): alpha summed by column or row. Partial sums go over the network, not pixels."""
    return pixels.groupBy(*keys, F.col(axis).alias("pos")).agg(F.sum("a").cast("double").alias("mass"))


def opaque_columns(pixels: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keys, pos, mass): how many opaque pixels each column has."""
    return pixels.groupBy(*keys, F.col("x").alias("pos")).agg(F.count_if(F.col("a") > ALPHA_T).cast("double").alias("mass"))


def gap_runs(profile: DataFrame, gap: int = 6) -> DataFrame:
    """(image_id, x0, x1): stretches of columns with content, parted by ``gap`` empty columns or more."""
    order = Window.partitionBy("image_id").orderBy("pos")
    filled = profile.where("mass > 0").withColumn("new", F.coalesce((F.col("pos") - F.lag("pos").over(order) > gap).cast("int"), F.lit(1)))
    return filled.withColumn("run", F.sum("new").over(order)).groupBy("image_id", "run").agg(F.min("pos").alias("x0"), (F.max("pos") + 1).alias("x1")).drop("run")


def filled(profile: DataFrame, first: int, last: int) -> DataFrame:
    """(image_id, pos, mass) with every place from first to last; a missing one has no mass."""
    axis = profile.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("pos"))
    return axis.join(profile, ["image_id", "pos"], "left").select("image_id", "pos", F.coalesce("mass", F.lit(0.0)).alias("mass"))


def smoothed(profile: DataFrame, win: int) -> DataFrame:
    """Centred moving average over 2 * (win // 2) + 1 places, shorter at the ends."""
    half = win // 2
    near = Window.partitionBy("image_id").orderBy("pos").rowsBetween(-half, half)
    return profile.withColumn("mass", F.avg("mass").over(near))


def runs(profile: DataFrame, min_width: int, drop_minor: bool = True) -> DataFrame:
    """(image_id, x0, x1, mass, peak): stretches above a share of the largest mass, wide and high enough.

    With ``drop_minor``, runs of less than a fifth of the heaviest one's mass go.
    """
    whole = Window.partitionBy("image_id")
    rows = profile.withColumn("top", F.max("mass").over(whole)).where((F.col("top") > 0) & (F.col("mass") > F.lit(RUN_EPS) * F.col("top")))
    rows = rows.withColumn("island", F.col("pos") - F.row_number().over(whole.orderBy("pos")))
    found = rows.groupBy("image_id", "island").agg(F.min("pos").alias("x0"), (F.max("pos") + 1).alias("x1"), F.sum("mass").alias("mass"), F.max("mass").alias("peak"), F.first("top").alias("top"))
    found = found.where((F.col("x1") - F.col("x0") >= min_width) & (F.col("peak") >= F.lit(RUN_PEAK) * F.col("top"))).drop("island", "top")
    if drop_minor:
        found = found.withColumn("most", F.max("mass").over(whole)).where(F.col("mass") >= F.col("most") * F.lit(RUN_MASS)).drop("most")
    return found


def upper_median(column: str):
    """The element at place n div 2 of the sorted values (the upper one of two middle ones)."""
    return F.expr(f"element_at(array_sort(collect_list({column})), cast(count({column}) div 2 as int) + 1)")


def peaks(profile: DataFrame, min_width: int) -> DataFrame:
    """(image_id, x0, x1, pos): prominent local maxima of each run; a run without one has its first candidate or middle."""

    def found(mass):
        return [{"x0": a, "x1": b, "peaks": ln.peaks_of(mass, a, b)} for a, b in ln.runs_of(mass, min_width)]

    kind = T.ArrayType(T.StructType([*ln.SPAN.fields, T.StructField("peaks", T.ArrayType(T.IntegerType()))]))
    rows = ln.lines(profile).select("image_id", F.explode(ln.on_lines(found, kind)("pos", "mass")).alias("s"))
    return rows.select("image_id", "s.x0", "s.x1", F.explode("s.peaks").alias("pos"))


def pose_counts(profile: DataFrame, min_width: int) -> DataFrame:
    """(image_id, x0, x1, n): figures in each run: its peaks, but no more than its width has room for."""

    def found(mass):
        return [{"x0": a, "x1": b, "n": n} for a, b, n in ln.counted_of(mass, min_width)]

    kind = T.ArrayType(T.StructType([*ln.SPAN.fields, T.StructField("n", T.IntegerType())]))
    return ln.lines(profile).select("image_id", F.inline(ln.on_lines(found, kind)("pos", "mass")))


def cuts(profile: DataFrame, parts: DataFrame) -> DataFrame:
    """(image_id, x0, cuts): the cheapest columns that part [x0, x1) into n spans; null where there is no room, or one span.

    The cost of a cut is the profile's mass there plus a penalty on uneven widths; of equally cheap ways the leftmost wins.
    """

    def cheapest(mass, x0, x1, n):
        return ln.cuts_of(mass, x0, x1, n) if n > 1 and x1 - x0 >= n else None

    rows = parts.select("image_id", *(F.col(c).cast("int").alias(c) for c in ("x0", "x1", "n"))).join(ln.lines(profile), "image_id", "left")
    return rows.select("image_id", "x0", ln.on_lines(cheapest, T.ArrayType(T.IntegerType()))("pos", "mass", "x0", "x1", "n").alias("cuts"))


def _sides(pixels: DataFrame, keys: tuple[str, ...], empty: bool = False) -> DataFrame:
    """(keys, x, y): columns and rows with mass, each as an array of (pos, mass), from one aggregation of the pixels; ``empty``: those without mass too."""
    axes = F.array(*[F.struct(F.lit(i).alias("axis"), F.col(c).alias("pos")) for i, c in enumerate("xy")])
    seen = pixels.withColumn("a", F.when(F.col("a") > 0, F.col("a")).otherwise(0)) if empty else pixels.where("a > 0")
    mass = seen.select(*keys, "a", F.inline(axes)).groupBy(*keys, "axis", "pos").agg(F.sum("a").cast("double").alias("mass"))
    rows = mass.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("axis", "pos", "mass"))).alias("c"))
    return rows.select(*keys, F.filter("c", lambda s: s["axis"] == 0).alias("x"), F.filter("c", lambda s: s["axis"] == 1).alias("y"))


def _span(side: str, share: float):
    found = ln.on_lines(lambda m: ln.extent_of(m, share), T.IntegerType())
    return found(F.transform(side, lambda v: v["pos"]), F.transform(side, lambda v: v["mass"]))


def extents(pixels: DataFrame, keys: tuple[str, ...] = ("image_id",), share: float = BODY_SHARE) -> DataFrame:
    """(keys, body_w, body_h): the shortest stretches of columns and of rows that hold the share of the mass (0 where there is none).

    Places without mass are kept, so that images without any need no second pass over the pixels and no join.
    """
    return _sides(pixels, keys, empty=True).select(*keys, _span("x", share).alias("body_w"), _span("y", share).alias("body_h"))


def measured(owned: DataFrame, share: float = BODY_SHARE) -> DataFrame:
    """``boxed`` and ``extents`` of each span's own pixels, from one aggregation."""
    total = lambda side, value: F.aggregate(side, F.lit(0.0), lambda t, v: t + value(v))
    ends = [(F.element_at(side, at)["pos"]).alias(f"{name}_{side}") for name, at in (("min", 1), ("max", -1)) for side in ("x", "y")]
    cx = total("x", lambda v: v["pos"] * v["mass"]) / total("x", lambda v: v["mass"])
    return _sides(owned, ("image_id", "seg")).select("image_id", "seg", *ends, cx.alias("cx"), _span("x", share).alias("body_w"), _span("y", share).alias("body_h"))


def owners(labelled: DataFrame, spans: DataFrame) -> DataFrame:
    """(image_id, label, owner): the span that holds most of a component's pixels; the first of equals.

    A column in several spans belongs to the last of them.
    """
    at = _placed(labelled.groupBy("image_id", "label", "x").agg(F.count("*").alias("n")), spans)
    weighed = at.groupBy("image_id", "label", "seg").agg(F.sum("n").alias("n"))
    best = F.max_by("seg", F.when(F.col("seg").isNotNull(), F.struct("n", -F.col("seg"))))
    return weighed.groupBy("image_id", "label").agg(F.coalesce(best, F.lit(-1)).alias("owner"))


def _placed(columns: DataFrame, spans: DataFrame) -> DataFrame:
    """``columns`` (image_id, x, ...) with ``seg``, the last span that holds the column, or null; an image's spans are one row, so no column is lost or doubled."""
    held = spans.groupBy("image_id").agg(F.collect_list(F.struct("seg", "x0", "x1")).alias("_s"))
    own = F.array_max(F.transform(F.filter("_s", lambda s: (F.col("x") >= s["x0"]) & (F.col("x") < s["x1"])), lambda s: s["seg"]))
    return columns.join(held.hint("merge"), "image_id", "left").withColumn("seg", own).drop("_s")


def owned_boxes(labelled: DataFrame, spans: DataFrame) -> DataFrame:
    """``contents`` of ``labelled`` and its ``owners``, from one aggregation of the pixels: components are labelled once."""
    at = labelled.groupBy("image_id", "label", "x").agg(F.count("*").alias("n"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.sum("a").alias("s"))
    kinds = F.sum("n").over(Window.partitionBy("image_id", "label", "seg"))
    whole = Window.partitionBy("image_id", "label")
    at = _placed(at, spans).withColumn("n", kinds).withColumn("owner", F.max_by("seg", F.when(F.col("seg").isNotNull(), F.struct("n", -F.col("seg")))).over(whole))
    return at.where("owner IS NOT NULL").groupBy("image_id", F.col("owner").alias("seg")).agg(
        F.min("x").alias("min_x"), F.min("y0").alias("min_y"), F.max("x").alias("max_x"), F.max("y1").alias("max_y"), (F.sum(F.col("x") * F.col("s")) / F.sum("s")).alias("cx")
    )


def bands(pixels: DataFrame, expected: DataFrame, height: int) -> DataFrame:
    """(image_id, band, y0, y1): a grid's rows, parted in the middle of the gaps between them.

    Images whose content does not fall into exactly the ``rows`` (2 or more) of ``expected`` (image_id,
    rows) are left out: they are to be taken as one row.
    """
    found = runs(smoothed(projected(pixels, "y"), max(3, height // 220)), max(4, height // 100))
    order, whole = Window.partitionBy("image_id").orderBy("x0"), Window.partitionBy("image_id")
    middle = F.floor((F.lag("x1").over(order) + F.col("x0")) / 2)
    rows = found.select("image_id", (F.row_number().over(order) - 1).alias("band"), F.coalesce(middle, F.lit(0)).cast("int").alias("y0"), F.count("*").over(whole).alias("n"))
    rows = rows.withColumn("y1", F.coalesce(F.lead("y0").over(Window.partitionBy("image_id").orderBy("band")), F.lit(height)))
    return rows.join(expected.where("rows >= 2"), "image_id").where("n = rows").select("image_id", "band", "y0", "y1")


def opaque(pixels: DataFrame) -> DataFrame:
    return pixels.where(F.col("a") > ALPHA_T)


def segments(profile: DataFrame, expected: DataFrame, width: int, min_run: int) -> DataFrame:
    """(image_id, seg, x0, x1): a strip's figures, from its smoothed profile.

    Runs are split by their figures; a strip whose number then differs from ``expected`` (image_id,
    expected) is cut into that many whole, where both its content and itself have 16 columns for each.
    """

    def found(mass, n):
        return [{"x0": a, "x1": b} for a, b in ln.segments_of(mass, n, width, min_run)]

    rows = ln.lines(profile).join(expected.select("image_id", F.col("expected").cast("int").alias("expected")), "image_id")
    return rows.select("image_id", F.posexplode(ln.on_lines(found, T.ArrayType(ln.SPAN))("pos", "mass", "expected")).alias("seg", "s")).select("image_id", "seg", "s.x0", "s.x1")


def contents(labelled: DataFrame, owner: DataFrame) -> DataFrame:
    """(image_id, seg, min_x, min_y, max_x, max_y, cx): what each span owns; ``labelled`` are pixels with alpha and label."""
    return boxed(labelled.join(owner.where("owner >= 0"), ["image_id", "label"]).withColumnRenamed("owner", "seg"))


def boxed(owned: DataFrame) -> DataFrame:
    """(image_id, seg, min_x, min_y, max_x, max_y, cx) of pixels with their span; cx is weighed by alpha."""
    return owned.groupBy("image_id", "seg").agg(
        F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"), (F.sum(F.col("x") * F.col("a")) / F.sum("a")).alias("cx")
    )


def owned_pixels(labelled: DataFrame, spans: DataFrame) -> DataFrame:
    """Opaque pixels (image_id, x, y, a, seg) of each span: those of the components it owns.

    If that leaves a span of an image without any, the image's spans are taken as plain columns instead, and spans without content go.
    """
    columns = spans.select("image_id", "seg", "x0", "x1")
    owner = owners(labelled, columns).withColumnRenamed("owner", "seg").where("seg >= 0")
    held = owner.groupBy("image_id").agg(F.countDistinct("seg").alias("held")).join(columns.groupBy("image_id").agg(F.count("*").alias("n")), "image_id", "right")
    clipped = held.select("image_id", (F.coalesce("held", F.lit(0)) < F.col("n")).alias("clipped"))
    rows = labelled.select("image_id", "x", "y", "a", "label").join(clipped, "image_id").join(owner, ["image_id", "label"], "left")
    by_owner = rows.where("NOT clipped AND seg IS NOT NULL").select("image_id", "x", "y", "a", "seg")
    by_column = rows.where("clipped").drop("seg").join(columns, "image_id").where("x >= x0 AND x < x1").select("image_id", "x", "y", "a", "seg")
    return by_owner.unionByName(by_column)
