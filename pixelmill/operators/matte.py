"""Background keys and chroma matting over pixel tables (image_id, x, y, r, g, b, a)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import ALPHA_T, CHROMA_IN, CHROMA_OUT, FLOOD_TOL, LITTLE_SEEN, MAGENTA, MUCH_RESIDUE, MUCH_SEEN, SEEN_LESS
from ..functions import color
from . import kernels


def key_of(rgb: tuple[int, int, int] = MAGENTA) -> Column:
    return color.ycc(*(F.lit(c) for c in rgb))


def matted(pixels: DataFrame, key: tuple[int, int, int] | Column = MAGENTA) -> DataFrame:
    """Pixels with soft alpha, and key spill taken out of their colours; empty pixels are black.

    ``key`` is one colour, or a struct column of each row's y, cb and cr (its image's own key).
    """
    k = key_of(key) if isinstance(key, tuple) else key
    c = color.ycc(F.col("r"), F.col("g"), F.col("b"))
    # plain columns, each used more than once, so that Catalyst keeps the steps apart and computes each once
    rows = pixels.select("*", *(c[v].alias(f"_{v}") for v in ("y", "cb", "cr")))
    own = F.struct(*(F.col(f"_{v}").alias(v) for v in ("y", "cb", "cr")))
    rows = rows.withColumn("_d", color.chroma_distance(own, k))
    rows = rows.withColumn("_t", color.smoothstep(CHROMA_IN, CHROMA_OUT, F.col("_d"))).withColumn("_s", color.spills(own, k, F.col("_d")))
    nb, nr = color.despilled_chroma(own, k, F.col("_d"))
    rows = rows.withColumns({"_nb": nb, "_nr": nr})
    clean = color.rgb(F.col("_y"), F.col("_nb"), F.col("_nr"))
    seen = F.col("_t") > 0
    new = {v: F.when(~seen, F.lit(0)).when(F.col("_s"), clean[v]).otherwise(F.col(v)).alias(v) for v in "rgb"}
    new["a"] = F.floor(F.col("a").cast("double") * F.col("_t")).cast("int").alias("a")
    # a generator of one row: conditions on the new columns stay above it and are not spelt out again below
    others = [name for name in pixels.columns if name not in new]
    return rows.select(*others, F.inline(F.array(F.struct(*new.values())))).select(*pixels.columns)


def cut_by_distance(pixels: DataFrame, key: tuple[int, int, int] = MAGENTA, tolerance: float = 120.0) -> DataFrame:
    """The plain way: pixels within an RGB distance of the key become empty, their colours stay."""
    d = sum(((F.col(c) - k) * (F.col(c) - k) for c, k in zip("rgb", key, strict=True)), F.lit(0))
    return pixels.withColumn("a", F.when(d <= tolerance * tolerance, F.lit(0)).otherwise(F.col("a")))


def shaded(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Colours darkened along the diagonal, from 0.6 to 1.0, but for the key's family."""
    f = F.lit(0.6) + F.lit(0.4) * (F.col("x") + F.col("y")).cast("double") / (width + height)
    keyed = (F.col("r") > 200) & (F.col("b") > 200) & (F.col("g") < 80)
    return pixels.withColumns({c: F.when(keyed, F.col(c)).otherwise(F.least(F.lit(255), F.floor(F.col(c) * f + 0.5).cast("int"))) for c in "rgb"})


def background_key(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, r, g, b): the mode of the border's chroma, or magenta where 12 % of the samples are of its family.

    Corner patches and the border are sampled as one bag: a pixel counts as often as it is in one of them.
    """
    cw, ch = (n // 5 if n // 5 >= 2 else n for n in (width, height))
    times = sum(
        (F.when(t, 1).otherwise(0) for t in [
            (F.col("x") < cw) & (F.col("y") < ch), (F.col("x") >= width - cw) & (F.col("y") < ch), (F.col("x") < cw) & (F.col("y") >= height - ch),
            (F.col("x") >= width - cw) & (F.col("y") >= height - ch), F.col("y") == 0, F.col("y") == height - 1, F.col("x") == 0, F.col("x") == width - 1,
        ]), F.lit(0),
    )
    c = color.ycc(F.col("r"), F.col("g"), F.col("b"))
    bag = pixels.withColumn("n", times).where("n > 0").withColumn("bin", (F.shiftleft(F.shiftright(c["cb"].cast("int"), 3), 6) + F.shiftright(c["cr"].cast("int"), 3)))
    magenta = color.is_magenta(F.col("r"), F.col("g"), F.col("b"))
    bins = bag.groupBy("image_id", "bin").agg(
        F.sum("n").alias("n"), *(F.sum(F.col(v) * F.col("n")).alias(f"s{v}") for v in "rgb"),
        F.sum(F.when(magenta, F.col("n")).otherwise(0)).alias("mn"), *(F.sum(F.when(magenta, F.col(v) * F.col("n")).otherwise(0)).alias(f"m{v}") for v in "rgb"),
    )
    best = bins.groupBy("image_id").agg(
        F.max_by(F.struct("n", "sr", "sg", "sb"), F.struct("n", -F.col("bin"))).alias("top"), F.sum("n").alias("total"), F.sum("mn").alias("mn"), *(F.sum(f"m{v}").alias(f"m{v}") for v in "rgb")
    )
    chosen = F.expr("mn >= total * 12 div 100 AND mn > 0")
    return best.select("image_id", *(F.when(chosen, F.expr(f"m{v} div nullif(mn, 0)")).otherwise(F.expr(f"top.s{v} div top.n")).cast("int").alias(v) for v in "rgb"))


def residue_share(pixels: DataFrame) -> DataFrame:
    """(image_id, share): opaque pixels near pure magenta in chroma, of all pixels."""
    d = color.chroma_distance(color.ycc(F.col("r"), F.col("g"), F.col("b")), key_of())
    return pixels.groupBy("image_id").agg((F.count_if((F.col("a") > ALPHA_T) & (d < 55)) / F.count("*")).alias("share"))


def cleaned(pixels: DataFrame, width: int, height: int, dealt: bool = False) -> DataFrame:
    """Alpha with lone opaque pixels removed and pinholes (7 or 8 opaque neighbours) filled.

    Neighbour sums are separable: a row window of three columns, then a column window of three rows of
    those sums. Pixels are dealt by image once, which both windows can work with; ``dealt``: they are already.
    """
    on = (F.col("a") > ALPHA_T).cast("int")
    across = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(-1, 1)
    down = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(-1, 1)
    rows = (pixels if dealt else pixels.repartition("image_id")).withColumn("_on", on).withColumn("_row", F.sum("_on").over(across)).withColumn("_nb", F.sum("_row").over(down) - F.col("_on"))
    if width < 3 or height < 3:
        return pixels
    return rows.withColumn("a", F.when((F.col("_on") == 1) & (F.col("_nb") == 0), 0).when((F.col("_on") == 0) & (F.col("_nb") >= 7), 255).otherwise(F.col("a"))).drop("_on", "_row", "_nb")


def without_background(pixels: DataFrame, width: int, height: int, clustered: bool = False) -> DataFrame:
    """Pixels (image_id, x, y, r, g, b, a) with the background removed, whatever its key.

    The image's own key is used; where that leaves too much (or the key is no magenta) and pure magenta leaves less
    residue, magenta is. Both are tried in one pass: a row carries both mattes, the kernel floods both, and windows over
    the image, which has one partition from there on, choose. Then alpha is cleaned up. ``clustered`` as in ``kernels``.
    """
    pixels = pixels.select("image_id", "x", "y", "r", "g", "b", "a")
    keys = background_key(pixels, width, height)
    own = color.ycc(*(F.col(f"k{c}") for c in "rgb"))
    keys = keys.select("image_id", *(F.col(c).alias(f"k{c}") for c in "rgb")).select("image_id", own.alias("key"), color.is_magenta(*(F.col(f"k{c}") for c in "rgb")).alias("magenta"))
    rows, c = pixels.join(keys, "image_id"), color.ycc(F.col("r"), F.col("g"), F.col("b"))
    rows = rows.withColumns({"own_is_key": color.chroma_distance(c, F.col("key")) <= FLOOD_TOL, "pure_is_key": color.chroma_distance(c, key_of()) <= FLOOD_TOL})
    # the kernel and the exchange see plain pixels; both mattes are made behind them
    rows = kernels.with_flood(rows, {"own_out": "own_is_key", "pure_out": "pure_is_key"}, clustered).drop("own_is_key", "pure_is_key").repartition("image_id")
    rows = matted(rows.withColumns({f"{v}0": F.col(v) for v in "rgba"}), F.col("key")).drop("key").withColumnsRenamed({v: f"{v}1" for v in "rgba"})
    rows = matted(rows.withColumnsRenamed({f"{v}0": v for v in "rgba"})).withColumnsRenamed({v: f"{v}2" for v in "rgba"})
    whole = Window.partitionBy("image_id")
    for i, out in ((1, "own_out"), (2, "pure_out")):
        rows = rows.withColumn(f"a{i}", F.when(F.col(out), F.lit(0)).otherwise(F.col(f"a{i}")))
        seen = F.col(f"a{i}") > ALPHA_T
        near = color.chroma_distance(color.ycc(*(F.col(f"{v}{i}") for v in "rgb")), key_of()) < 55
        rows = rows.withColumns({f"seen{i}": F.avg(seen.cast("double")).over(whole), f"left{i}": F.avg((seen & near).cast("double")).over(whole)})
    symptom = (F.col("seen1") > MUCH_SEEN) | (F.col("left1") > MUCH_RESIDUE)
    better = (F.col("seen2") < F.col("seen1") - SEEN_LESS) | (F.col("left2") < F.col("left1"))
    again = (F.col("seen2") > LITTLE_SEEN) & ((symptom & better) | (~F.col("magenta") & (F.col("left2") < F.col("left1"))))
    return cleaned(rows.select("image_id", "x", "y", *(F.when(again, F.col(f"{v}2")).otherwise(F.col(f"{v}1")).alias(v) for v in "rgba")), width, height, dealt=True)
