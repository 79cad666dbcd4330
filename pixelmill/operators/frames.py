"""Measures, checks and scores of frames: tables (image_id, frame, x, y, r, g, b, a) with one size a set."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..constants import (
    ALPHA_T, BASE_ERROR, BASE_WARN, DRIFT_ERROR, DRIFT_WARN, EDGE_MARGIN, EDGE_MAX, KEY_DIST, KEY_MAX, LARGE_RATIO, MAGENTA, MIN_CONTENT, MIN_CONTENT_SHARE, SMALL_RATIO,
)
from ..functions import color
from ..sources.images import pixels_of, sets_of

FRAME = ["image_id", "frame"]


def on() -> Column:
    return F.col("a") > ALPHA_T


def boxes(frames: DataFrame) -> DataFrame:
    """(image_id, frame, x, y, w, h): the content's box; zeros for an empty frame."""
    found = frames.groupBy(*FRAME).agg(*(f(F.when(on(), F.col(c))).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xy"))
    zero = F.lit(0)
    return found.select(*FRAME, F.coalesce("lo_x", zero).alias("x"), F.coalesce("lo_y", zero).alias("y"), F.coalesce(F.expr("hi_x - lo_x + 1"), zero).alias("w"), F.coalesce(F.expr("hi_y - lo_y + 1"), zero).alias("h"))


def centroids(frames: DataFrame) -> DataFrame:
    """(image_id, frame, cx, cy, w, h) weighed by alpha, of frames with content. Sums are of integers."""
    found = frames.where(on()).groupBy(*FRAME).agg(F.sum(F.col("x") * F.col("a")).alias("sx"), F.sum(F.col("y") * F.col("a")).alias("sy"), F.sum("a").alias("s"), *(f(c).alias(n + c) for n, f in (("lo", F.min), ("hi", F.max)) for c in "xy"))
    return found.selectExpr(*FRAME, "sx / s AS cx", "sy / s AS cy", "hix - lox + 1 AS w", "hiy - loy + 1 AS h")


def jitter(frames: DataFrame) -> DataFrame:
    """(image_id, cx, cy, w, h): how far the centroids and sizes of a set spread."""
    return centroids(frames).groupBy("image_id").agg(*((F.max(c) - F.min(c)).alias(c) for c in ("cx", "cy", "w", "h")))


def histograms(frames: DataFrame) -> DataFrame:
    """(image_id, frame, bin, share) over 64 colour bins of the opaque pixels."""
    binned = frames.where(on()).groupBy(*FRAME, color.hist_bin(F.col("r"), F.col("g"), F.col("b")).alias("bin")).agg(F.count("*").alias("n"))
    return binned.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*FRAME))).drop("n")


def _cells(frames: DataFrame, key: tuple[int, int, int]) -> DataFrame:
    """One row a frame and colour bin (null: its empty pixels), with what the inspection counts; dealt by set.

    Everything further is windows over a set's few rows, so a set's frames meet in one partition and pixels stay where they are.
    """
    r, g, b = (F.col(c) for c in "rgb")
    near = (color.rgb_distance(r, g, b, key) <= KEY_DIST) & color.key_tinted(r, g, b, key)
    m = EDGE_MARGIN
    edge = (F.col("x") < m) | (F.col("x") >= F.col("w") - m) | (F.col("y") < m) | (F.col("y") >= F.col("h") - m)
    cells = frames.groupBy(*FRAME, F.when(on(), color.hist_bin(r, g, b)).alias("bin")).agg(
        F.max("w").alias("width"), F.max("h").alias("height"), F.count_if(on()).alias("n"), F.count_if(on() & edge).alias("edge"), F.count_if(on() & near).alias("residue")
    )
    frame, bins, whole = Window.partitionBy(*FRAME), Window.partitionBy("image_id", "bin"), Window.partitionBy("image_id")
    cells = cells.repartition("image_id").withColumn("frames", F.size(F.collect_set("frame").over(whole)))
    cells = cells.withColumn("share", F.when(F.col("bin").isNotNull(), F.col("n") / F.sum("n").over(frame)))
    rest = (F.sum("share").over(bins) - F.col("share")) / (F.col("frames") - 1)
    return cells.withColumn("common", F.when(F.col("frames") > 1, F.least(F.col("share"), rest)))


def palette_similarity(frames: DataFrame) -> DataFrame:
    """(image_id, frame, similarity): each frame's histogram against the mean of the set's others."""
    cells = _cells(_sized(frames), MAGENTA).where("frames > 1")
    return cells.groupBy(*FRAME).agg(F.coalesce(F.sum("common"), F.lit(0.0)).alias("similarity"))


def _sized(frames: DataFrame) -> DataFrame:
    """Frames with their width and height, which are taken from the pixels where no column tells."""
    if "w" in frames.columns and "h" in frames.columns:
        return frames
    whole = Window.partitionBy(*FRAME)
    return frames.withColumn("w", F.max("x").over(whole) + 1).withColumn("h", F.max("y").over(whole) + 1)


def base_similarity(frames: DataFrame, base: DataFrame) -> DataFrame:
    """(image_id, similarity): mean similarity of a set's frames to its base image (image_id, r, g, b, a)."""
    shown = base.groupBy("image_id").agg(F.avg((F.col("a") <= ALPHA_T).cast("int")).alias("clear")).where("clear >= 0.05").select("image_id")
    ref = histograms(base.join(shown, "image_id").withColumn("frame", F.lit(-1))).select("image_id", "bin", F.col("share").alias("ref"))
    ids = frames.select(*FRAME).distinct().join(shown, "image_id")
    both = histograms(frames).join(ref, ["image_id", "bin"]).groupBy(*FRAME).agg(F.sum(F.least("share", "ref")).alias("s"))
    return ids.join(both, FRAME, "left").groupBy("image_id").agg(F.avg(F.coalesce("s", F.lit(0.0))).alias("similarity"))


def reports(frames: DataFrame, key: tuple[int, int, int] = MAGENTA) -> DataFrame:
    """(image_id, frame, width, height, content, edge, residue): one pass of conditional counts."""
    r, g, b = (F.col(c) for c in "rgb")
    near = (color.rgb_distance(r, g, b, key) <= KEY_DIST) & color.key_tinted(r, g, b, key)
    m = EDGE_MARGIN
    edge = (F.col("x") < m) | (F.col("x") >= F.col("w") - m) | (F.col("y") < m) | (F.col("y") >= F.col("h") - m)
    sized = _sized(frames).groupBy(*FRAME)
    return sized.agg(F.max("w").alias("width"), F.max("h").alias("height"), F.count_if(on()).alias("content"), F.count_if(on() & edge).alias("edge"), F.count_if(on() & near).alias("residue"))


#: Rule -> what to ask for when a set is made again; a hint is given once a set.
HINTS = {
    "empty": "fill every column", "edge": "keep clear of the edges", "residue": "avoid the key colour", "less_content": "keep one size", "too_small": "keep one scale",
    "too_large": "keep figures apart", "drift": "keep the character's colours", "other_character": "copy the reference",
}


def inspected(frames: DataFrame, key: tuple[int, int, int] = MAGENTA, base: DataFrame | None = None) -> DataFrame:
    """(image_id, frame, ..., errors, warnings): every rule of the inspection, as arrays of rule names.

    One aggregation of the pixels; the rest are windows over a set's rows.
    """
    rows = _cells(_sized(frames), key).groupBy(*FRAME).agg(
        F.max("width").alias("width"), F.max("height").alias("height"), *(F.sum(c).alias(c) for c in ("edge", "residue")), F.sum("n").alias("content"),
        F.max("frames").alias("frames"), F.sum("common").alias("common"),
    )
    rows = rows.withColumn("similarity", F.when(F.col("frames") > 1, F.coalesce("common", F.lit(0.0))))
    whole = Window.partitionBy("image_id")
    sorted_ = F.sort_array(F.collect_list("content").over(whole))
    rows = rows.withColumn("median", F.element_at(sorted_, F.floor(F.size(sorted_) / 2).cast("int") + 1)).withColumn("area", F.floor(F.sum(F.col("width") * F.col("height")).over(whole) / F.col("frames")))
    cutoff = F.floor(F.col("area") * F.lit(MIN_CONTENT_SHARE)).cast("int")
    ratio = F.when((F.col("frames") >= 3) & (F.col("median") > 0), F.col("content") / F.col("median"))
    faint = F.col("content") < F.greatest(F.lit(MIN_CONTENT), F.expr("width * height div 100"))
    errors = [("empty", faint), ("residue", F.col("residue") > KEY_MAX), ("drift", F.col("similarity") < DRIFT_ERROR)]
    warnings = [
        ("edge", F.col("edge") > EDGE_MAX), ("less_content", (cutoff > 0) & (F.col("content") < cutoff)), ("too_small", ratio < SMALL_RATIO), ("too_large", ratio > LARGE_RATIO),
        ("drift", (F.col("similarity") >= DRIFT_ERROR) & (F.col("similarity") < DRIFT_WARN)),
    ]
    if base is not None:
        rows = rows.join(base_similarity(frames, base).withColumnRenamed("similarity", "base"), "image_id", "left")
        errors.append(("other_character", F.col("base") < BASE_ERROR))
        warnings.append(("near_character", (F.col("base") >= BASE_ERROR) & (F.col("base") < BASE_WARN)))
    named = [F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules])) for rules in (errors, warnings)]
    return rows.select(*FRAME, "content", "edge", "residue", "similarity", named[0].alias("errors"), named[1].alias("warnings"))


def hints(inspected: DataFrame) -> DataFrame:
    """(image_id, hints): what to ask for when a set is made again, each rule's hint once, in the order of ``HINTS``."""
    failed = inspected.groupBy("image_id").agg(F.flatten(F.collect_list(F.concat("errors", "warnings"))).alias("rules"))
    every = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(hint).alias("hint")) for rule, hint in HINTS.items()])
    return failed.select("image_id", F.transform(F.filter(every, lambda h: F.array_contains("rules", h["rule"])), lambda h: h["hint"]).alias("hints"))


def _compared(frames: DataFrame) -> DataFrame:
    """(image_id, frame, h, top, bottom, motion, likeness): each frame beside the one before, in one pass.

    Frames are compared if their numbers follow each other and their sizes are equal; pixels that are empty in both do not
    count. Pixels are dealt by set once.
    """
    place = Window.partitionBy("image_id", "x", "y").orderBy("frame")
    rows = _sized(frames).repartition("image_id")
    rows = rows.select(*FRAME, "x", "y", "r", "g", "b", "a", "w", "h", *(F.lag(c).over(place).alias(f"p{c}") for c in ("frame", "w", "h", *"rgba")))
    pair = (F.col("pframe") == F.col("frame") - 1) & (F.col("pw") == F.col("w")) & (F.col("ph") == F.col("h")) & (on() | (F.col("pa") > ALPHA_T))
    change = sum((F.abs(F.col(c) - F.col(f"p{c}")) for c in "rgba"), F.lit(0))
    r, g, b, a = ((F.col(c) - F.col(f"p{c}")).cast("double") for c in "rgba")
    d = F.sqrt(F.lit(0.299) * r * r + F.lit(0.587) * g * g + F.lit(0.114) * b * b) + F.lit(0.5) * F.abs(a)
    return rows.groupBy(*FRAME).agg(
        F.max("h").alias("h"), F.min(F.when(on(), F.col("y"))).alias("top"), F.max(F.when(on(), F.col("y"))).alias("bottom"),
        (F.sum(F.when(pair, change)) / 1020.0 / F.count_if(pair)).alias("motion"), (1 - F.avg(F.when(pair, F.least(d / 382.5, F.lit(1.0))))).alias("likeness"),
    )


def _parts(frames: DataFrame) -> DataFrame:
    """(image_id, n, identity, motion, contact): identity and motion are means over the pairs of neighbouring frames that can be compared, contact tells how steady feet and head stand.
    """
    whole = Window.partitionBy("image_id")
    per = _compared(frames)
    off = per.withColumns({f"{c}_off": F.abs(F.col(c) - F.avg(c).over(whole)) for c in ("top", "bottom")})
    mean = off.groupBy("image_id").agg(
        F.count("*").alias("n"), F.avg("likeness").alias("identity"), F.avg("motion").alias("motion"), F.avg("top_off").alias("top"), F.avg("bottom_off").alias("bottom"), F.max("h").alias("h")
    )

    def part(c: str, share: float) -> Column:
        return 1 - F.least(F.col(c) / F.greatest(F.col("h") * F.lit(share), F.lit(2.0)), F.lit(1.0))

    found = {"identity": F.col("identity"), "motion": F.col("motion"), "contact": F.lit(0.75) * part("bottom", 0.10) + F.lit(0.25) * part("top", 0.28)}
    return mean.select("image_id", "n", *(F.coalesce(v, F.lit(0.0)).alias(c) for c, v in found.items()))


def scores(frames: DataFrame) -> DataFrame:
    """(image_id, identity, motion, contact, overall); zeros for sets of one frame."""
    parts = {c: F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.col(c)) for c in ("identity", "motion", "contact")}
    overall = F.lit(0.5) * parts["identity"] + F.lit(0.3) * parts["motion"] + F.lit(0.2) * parts["contact"]
    return _parts(frames).select("image_id", *(v.alias(k) for k, v in parts.items()), overall.alias("overall"))


def motion(frames: DataFrame) -> DataFrame:
    """(image_id, motion): mean change between neighbouring frames, 0 to 1; differences are summed as integers."""
    return _parts(frames).select("image_id", "motion")


def identity(frames: DataFrame) -> DataFrame:
    """(image_id, identity): mean likeness of neighbouring frames."""
    return _parts(frames).select("image_id", "identity")


def contact(frames: DataFrame) -> DataFrame:
    """(image_id, contact): how steady feet and head stand."""
    return _parts(frames).select("image_id", "contact")


def balance(frames: DataFrame) -> DataFrame:
    """(image_id, least, most, ratio) of the opaque pixels of a set's frames."""
    n = frames.groupBy(*FRAME).agg(F.count_if(on()).alias("n"))
    return n.groupBy("image_id").agg(F.min("n").alias("least"), F.max("n").alias("most")).withColumn("ratio", F.when(F.col("least") > 0, F.col("most") / F.col("least")).otherwise(F.lit(999.0)))


def centroid_spread(frames: DataFrame, width: str = "w") -> DataFrame:
    """(image_id, spread): standard deviation (of a population) of unweighted column centroids."""
    c = frames.groupBy(*FRAME).agg(F.coalesce(F.avg(F.when(on(), F.col("x"))), F.max(width) / 2).alias("c"))
    return c.groupBy("image_id").agg(F.stddev_pop("c").alias("spread"))


def steadiness(sums: DataFrame, *also: Column) -> DataFrame:
    """(image_id, ratio, spread, also): ``balance`` and ``centroid_spread`` from (image_id, frame, opaque, opaque_x, w), a row a frame; ``also`` are aggregates."""
    c = F.when(F.col("opaque") > 0, F.col("opaque_x") / F.col("opaque")).otherwise(F.col("w") / 2)
    ratio = F.when(F.min("opaque") > 0, F.max("opaque") / F.min("opaque")).otherwise(F.lit(999.0))
    return sums.groupBy("image_id").agg(ratio.alias("ratio"), F.stddev_pop(c).alias("spread"), *also)


def opaque_sums(frames: DataFrame) -> DataFrame:
    """(image_id, frame, opaque, opaque_x, w): opaque pixels of each frame and the sum of their columns."""
    return frames.groupBy(*FRAME).agg(F.count_if(on()).alias("opaque"), F.sum(F.when(on(), F.col("x"))).alias("opaque_x"), F.max("w").alias("w"))


def body_heights(frames: DataFrame) -> DataFrame:
    """(image_id, frame, height): the tallest column's extent."""
    per = frames.where(on()).groupBy(*FRAME, "x").agg((F.max("y") - F.min("y") + 1).alias("h"))
    return frames.select(*FRAME).distinct().join(per.groupBy(*FRAME).agg(F.max("h").alias("height")), FRAME, "left").select(*FRAME, F.coalesce("height", F.lit(0)).alias("height"))


def mean_body_height(frames: DataFrame, skip: int = -1) -> DataFrame:
    """(image_id, height): mean of a set's body heights, but for the frame ``skip``; 0 where none is left."""
    per = body_heights(frames)
    return per.groupBy("image_id").agg(F.coalesce(F.avg(F.when(F.col("frame") != skip, F.col("height"))), F.lit(0.0)).alias("height"))


def torso_spread(frames: DataFrame) -> DataFrame:
    """(image_id, spread): standard deviation (of a population) of the blue-ish pixels' mean columns (0 in a frame without any)."""
    return metrics(frames).groupBy("image_id").agg(F.stddev_pop("torso").alias("spread"))


def metrics(frames: DataFrame) -> DataFrame:
    """(image_id, frame, residue, halo, edge, torso): counts of tinted, fringed and border pixels, mean column of the blue-ish."""
    r, g, b = (F.col(c) for c in "rgb")
    blue = on() & (b > 140) & (b - r > 40) & (g < 180)
    return frames.groupBy(*FRAME).agg(
        F.count_if(on() & (r > 150) & (b > 150) & (g < 130)).alias("residue"),
        F.count_if(on() & (r - g > 40) & (b - g > 40) & ~((r > 200) & (b > 200) & (g < 80))).alias("halo"),
        F.count_if(on() & F.col("x").isin(0, 1) | on() & (F.col("x") >= F.col("w") - 2)).alias("edge"),
        F.coalesce(F.avg(F.when(blue, F.col("x"))), F.lit(0.0)).alias("torso"),
    )


@F.arrow_udf(T.StructType([T.StructField("w", T.IntegerType()), T.StructField("h", T.IntegerType()), T.StructField("pix", T.BinaryType())]))
def _blended(frames: pa.Array, alpha: pa.Array) -> pa.Array:
    out = []
    for own, share in zip(frames.to_pylist(), alpha.to_pylist(), strict=True):
        w, h = max(f["w"] for f in own), max(f["h"] for f in own)
        under = np.zeros((h, w, 4), dtype=np.int32)
        for f in own:
            over = np.frombuffer(f["pix"], np.uint8).reshape(f["h"], f["w"], 4)
            part, seen = under[: f["h"], : f["w"]], over[..., 3] > ALPHA_T
            part[seen, :3] = (part[seen, :3] * (255 - share) + over[seen, :3] * np.int32(share)) // 255
            part[seen, 3] = 255
        out.append({"w": w, "h": h, "pix": under.astype(np.uint8).tobytes()})
    return pa.array(out, pa.struct([("w", pa.int32()), ("h", pa.int32()), ("pix", pa.binary())]))


def onion_rasters(sets: DataFrame, alpha: int = 90) -> DataFrame:
    """(image_id, w, h, pix): a set's frames (``images.sets_of``) blended over each other in order, at a fixed alpha; clear where none shows anything.

    A set is a row, as the fold needs a place's frames in order; as many as there are.
    """
    return sets.select("image_id", _blended("frames", F.lit(alpha)).alias("s")).select("image_id", "s.*")


def onion_skin(frames: DataFrame, alpha: int = 90, clustered: bool = False) -> DataFrame:
    """(image_id, x, y, r, g, b): ``onion_rasters`` of a table of pixels, as pixels."""
    return pixels_of(onion_rasters(sets_of(_sized(frames), clustered=clustered), alpha)).drop("a")
