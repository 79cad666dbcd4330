"""Atlases, manifests, sheet JSON, mirrors and other layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.catalog import directions
from .frames import boxes


def mirrored(frames: DataFrame, width: str = "w") -> DataFrame:
    """Frames turned about their vertical middle."""
    return frames.withColumn("x", F.col(width) - 1 - F.col("x"))


def direction_set(generated: DataFrame) -> DataFrame:
    """Frames of the generated directions, and of those that mirror one of them (the eight are a fixed table)."""
    sources = directions(generated.sparkSession).where("mirror_of IS NOT NULL").select(F.col("key").alias("to"), F.col("mirror_of").alias("direction"))
    turned = mirrored(generated).join(F.broadcast(sources), "direction").drop("direction").withColumnRenamed("to", "direction")
    return generated.withColumn("mirrored", F.lit(False)).unionByName(turned.withColumn("mirrored", F.lit(True)))


def atlas(frames: DataFrame, states: DataFrame, cell_w: int, cell_h: int) -> DataFrame:
    """(image_id, row, frame, x, y, trim x, y, w, h, pivot_x, pivot_y, duration) of every cell.

    ``states`` are (image_id, sheet, row, fps). The pivot is the lowest content of the state's frames, or the
    cell's bottom where that is in the upper half, and never below the cell.
    """
    trims = boxes(frames).select("image_id", "frame", F.col("x").alias("trim_x"), F.col("y").alias("trim_y"), F.col("w").alias("trim_w"), F.col("h").alias("trim_h"))
    rows = trims.join(states, "image_id")
    ground = F.max(F.col("trim_y") + F.col("trim_h")).over(Window.partitionBy("image_id"))
    fps = F.when(F.col("fps") > 0, F.col("fps")).otherwise(8)
    return rows.withColumn("ground", ground).select(
        "sheet", "image_id", "row", "frame", (F.col("frame") * cell_w).alias("x"), (F.col("row") * cell_h).alias("y"), "trim_x", "trim_y", "trim_w", "trim_h",
        F.lit(cell_w // 2).alias("pivot_x"), F.least(F.when(F.col("ground") < cell_h // 2, F.lit(cell_h)).otherwise(F.col("ground")), F.lit(cell_h)).alias("pivot_y"),
        F.floor(1000 / fps).cast("int").alias("duration"),
    )


def sheet_json(cells: DataFrame, cell_w: int, cell_h: int, image: str = "sheet.png") -> DataFrame:
    """(sheet, n_frames, json): a sprite sheet's frames in row order, the tags of its states, and what the sheet is.

    ``cells`` may have ``loop`` (a state without it, or with null, loops); a state that does not is tagged to play once.
    A sheet is one character's, so its list is bounded by the sheet.
    """
    order = Window.partitionBy("sheet").orderBy("row", "image_id", "frame")
    rows = cells if "loop" in cells.columns else cells.withColumn("loop", F.lit(True))
    rows = rows.withColumn("index", F.row_number().over(order) - 1)
    size = F.struct(F.lit(cell_w).alias("w"), F.lit(cell_h).alias("h"))
    cell = F.struct(
        F.concat_ws(" ", F.col("image_id"), F.col("frame")).alias("filename"), F.struct(F.col("x"), F.col("y"), F.lit(cell_w).alias("w"), F.lit(cell_h).alias("h")).alias("frame"),
        F.lit(False).alias("rotated"), F.lit(False).alias("trimmed"), F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(cell_w).alias("w"), F.lit(cell_h).alias("h")).alias("spriteSourceSize"),
        size.alias("sourceSize"), F.col("duration"),
    )
    tags = rows.groupBy("sheet", "row", "image_id").agg(F.min("index").alias("from"), F.max("index").alias("to"), F.bool_and(F.coalesce("loop", F.lit(True))).alias("loop"))
    once = F.when(~F.col("loop"), F.lit("1"))  # a null field is left out of the text
    tag = F.struct("row", F.struct(F.col("image_id").cast("string").alias("name"), F.col("from"), F.col("to"), F.lit("forward").alias("direction"), once.alias("repeat")).alias("t"))
    tagged = tags.groupBy("sheet").agg(F.transform(F.array_sort(F.collect_list(tag)), lambda s: s["t"]).alias("frameTags"))
    listed = rows.groupBy("sheet").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("index", cell.alias("c")))), lambda s: s["c"]).alias("frames"), F.count("*").alias("n_frames"),
        (F.max("x") + cell_w).alias("width"), (F.max("y") + cell_h).alias("height"),
    )
    whole = F.struct(F.col("width").alias("w"), F.col("height").alias("h"))
    meta = F.struct(F.lit("pixelmill").alias("app"), F.lit("1.0").alias("version"), F.lit(image).alias("image"), F.lit("RGBA8888").alias("format"), whole.alias("size"), F.lit("1").alias("scale"), F.col("frameTags"))
    return listed.join(tagged, "sheet").select("sheet", "n_frames", F.to_json(F.struct("frames", meta.alias("meta"))).alias("json"))


def sheet_pixels(frames: DataFrame, states: DataFrame, cell_w: int, cell_h: int) -> DataFrame:
    """(sheet, x, y, r, g, b, a): the frames' pixels at their cells' places; what leaves its cell is clipped."""
    rows = frames.where((F.col("x") < cell_w) & (F.col("y") < cell_h)).join(states.select("image_id", "sheet", "row"), "image_id")
    return rows.select("sheet", (F.col("frame") * cell_w + F.col("x")).alias("x"), (F.col("row") * cell_h + F.col("y")).alias("y"), "r", "g", "b", "a")


def concatenated(frames: DataFrame) -> DataFrame:
    """Frames of a set side by side: pixels moved by the widths of the frames before."""
    sizes = frames.groupBy("image_id", "frame").agg((F.max("x") + 1).alias("width"))
    before = Window.partitionBy("image_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("left", F.coalesce(F.sum("width").over(before), F.lit(0))).select("image_id", "frame", "left")
    return frames.join(placed, ["image_id", "frame"]).withColumn("x", F.col("x") + F.col("left")).drop("left")


def placement(contents: DataFrame, cell_w: int, cell_h: int, margin: int) -> DataFrame:
    """Where each content goes in its cell: shared scale by body extent, a common baseline, centred by mass.

    ``contents``: image_id, seg, min_x, w, h, cx, bottom, body_w, body_h.
    """
    whole = Window.partitionBy("image_id")
    shared = {"body_w": F.max("body_w").over(whole), "body_h": F.max("body_h").over(whole), "base": F.max("bottom").over(whole)}
    return fitted(contents.withColumns(shared), cell_w, cell_h, margin).select("image_id", "seg", F.round("scale", 6).alias("scale"), "sw", "sh", "left", "top")


def fitted(rows: DataFrame, cell_w: int, cell_h: int, margin: int) -> DataFrame:
    """``rows`` with scale, sw, sh, left, top of each content; body_w, body_h and base (the lowest bottom) are its whole set's."""
    room_w, room_h = (cell_w - 2 * margin, cell_h - 2 * margin) if min(cell_w, cell_h) - 2 * margin >= 8 else (cell_w, cell_h)
    scale = F.least(F.lit(1.0), F.lit(float(room_w)) / F.greatest("body_w", F.lit(1)), F.lit(float(room_h)) / F.greatest("body_h", F.lit(1)))
    rows = rows.withColumn("scale", F.least(scale, F.lit(float(room_w)) / F.col("w"), F.lit(float(room_h)) / F.col("h")))
    rows = rows.withColumn("sw", F.greatest(F.lit(1), (F.col("w") * F.col("scale") + 0.5).cast("int"))).withColumn("sh", F.greatest(F.lit(1), (F.col("h") * F.col("scale") + 0.5).cast("int")))
    left = F.greatest(F.lit(0), (F.lit(cell_w / 2) - (F.col("cx") - F.col("min_x")) * F.col("scale") + 0.5).cast("int"))
    top = F.lit(cell_h - margin) - ((F.col("base") - F.col("bottom")) * F.col("scale") + 0.5).cast("int") - F.col("sh")
    return rows.withColumns({"left": F.when(left + F.col("sw") > cell_w, F.lit(cell_w) - F.col("sw")).otherwise(left), "top": F.greatest(F.lit(0), top)})


def box_placement(boxes: DataFrame, cell_w: int, cell_h: int, margin: int, shared: bool) -> DataFrame:
    """Where plainer ways put contents (image_id, seg, min_x, min_y, max_x, max_y): centred by their boxes, on the cell's floor.

    ``shared``: one scale a set, from its largest box and lowest bottom; else each box is fitted by its own height.
    """
    whole = Window.partitionBy("image_id")
    rows = boxes.withColumn("w", F.col("max_x") - F.col("min_x") + 1).withColumn("h", F.col("max_y") - F.col("min_y") + 1)
    room_w, room_h = F.lit(float(cell_w - 2 * margin)), F.lit(float(cell_h - 2 * margin))
    if shared:
        rows = rows.withColumn("base", F.max("max_y").over(whole))
        scale = F.least(F.lit(1.0), room_w / F.max("w").over(whole), room_h / F.max(F.col("h") + F.col("base") - F.col("max_y")).over(whole))
    else:
        rows, scale = rows.withColumn("base", F.col("max_y")), F.least(F.lit(1.0), room_h / F.col("h"))
    rows = rows.withColumn("scale", scale)
    side = [(F.col(c) * F.col("scale") + 0.5).cast("int") for c in "wh"]
    raised = ((F.col("base") - F.col("max_y")) * F.col("scale") + 0.5).cast("int")
    left = ((F.lit(cell_w) - F.col("sw")) / 2).cast("int")
    top = F.lit(cell_h - margin) - raised - F.col("sh")
    rows = rows.withColumns({"sw": side[0], "sh": side[1]})
    return rows.select("image_id", "seg", F.round("scale", 6).alias("scale"), "sw", "sh", left.alias("left"), (F.greatest(F.lit(0), top) if shared else top).alias("top"))


def over(under: DataFrame, upper: DataFrame, keys: tuple[str, ...] = ("image_id", "x", "y")) -> DataFrame:
    """``upper``'s pixels composed over ``under``'s by alpha; where one has no pixel the other stays.

    Both layers have at most one pixel a place. They are summed by place in one exchange, not joined.
    """
    none = F.lit(None).cast("int")
    below = under.select(*keys, *(F.col(c).cast("int").alias(c) for c in "rgba"), *(none.alias(f"u{c}") for c in "rgba"))
    above = upper.select(*keys, *(none.alias(c) for c in "rgba"), *(F.col(c).cast("int").alias(f"u{c}") for c in "rgba"))
    rows = below.unionByName(above).groupBy(*keys).agg(*(F.max(c).alias(c) for layer in ("", "u") for c in (f"{layer}{v}" for v in "rgba")))
    ua, a = F.coalesce("ua", F.lit(0)), F.coalesce("a", F.lit(0))
    whole = ua * 255 + a * (255 - ua)  # 255 times the alpha of both

    def mixed(c: str) -> Column:
        parts = F.coalesce(f"u{c}", F.lit(0)) * ua * 255 + F.coalesce(c, F.lit(0)) * a * (255 - ua)
        return F.when(whole > 0, F.floor(parts / F.when(whole > 0, whole) + 0.5)).otherwise(0).cast("int")

    return rows.select(*keys, *(mixed(c).alias(c) for c in "rgb"), F.floor(whole / 255 + 0.5).cast("int").alias("a"))


def silhouette(frames: DataFrame, colour: tuple[int, int, int]) -> DataFrame:
    """Frames in one colour, alpha as it is."""
    return frames.withColumns({c: F.when(F.col("a") > 0, F.lit(v)).otherwise(0) for c, v in zip("rgb", colour, strict=True)})


def ringed(frames: DataFrame, thickness: int = 1, dealt: bool = False) -> DataFrame:
    """Frames with ``ring``: whether a place is empty, but within ``thickness`` of an opaque pixel (in both directions).

    Frames have a row a place, empty ones too. They are dealt by frame once; both directions are windows over that dealing.
    ``dealt``: they are dealt by frame, or by image, already.
    """
    rows = (frames if dealt else frames.repartition("image_id", "frame")).withColumn("_a", F.coalesce("a", F.lit(0)))
    beside = Window.partitionBy("image_id", "frame", "y").orderBy("x").rangeBetween(-thickness, thickness)
    above = Window.partitionBy("image_id", "frame", "x").orderBy("y").rangeBetween(-thickness, thickness)
    rows = rows.withColumn("_near", F.max("_a").over(beside)).withColumn("_near", F.max("_near").over(above))
    return rows.withColumn("ring", F.expr("_a <= 0 AND _near > 0")).drop("_a", "_near")


def outline(frames: DataFrame, thickness: int = 1, dealt: bool = False) -> DataFrame:
    """(image_id, frame, x, y): the places of ``ringed``."""
    return ringed(frames.select("image_id", "frame", "x", "y", "a"), thickness, dealt).where("ring").select("image_id", "frame", "x", "y")


def cropped(pixels: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """A rectangle, moved to the origin."""
    inside = pixels.where((F.col("x") >= x) & (F.col("x") < x + w) & (F.col("y") >= y) & (F.col("y") < y + h))
    return inside.withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def tight(frames: DataFrame) -> DataFrame:
    """Each frame cropped to its content's box."""
    box = boxes(frames).where("w > 0").selectExpr("image_id", "frame", "x as bx", "y as by", "w as bw", "h as bh")
    rows = frames.join(box, ["image_id", "frame"]).where("x >= bx AND x < bx + bw AND y >= by AND y < by + bh")
    return rows.withColumns({"x": F.col("x") - F.col("bx"), "y": F.col("y") - F.col("by")}).drop("bx", "by", "bw", "bh")


def scaled_down(pixels: DataFrame, factor: int) -> DataFrame:
    """Every factor-th pixel of every factor-th row."""
    rows = pixels.where((F.col("x") % factor == 0) & (F.col("y") % factor == 0))
    return rows.withColumns({"x": F.floor(F.col("x") / factor).cast("int"), "y": F.floor(F.col("y") / factor).cast("int")})


def scaled_up(pixels: DataFrame, factor: int) -> DataFrame:
    """Every pixel as a square of its own."""
    rows = pixels.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(factor * factor - 1))))
    return rows.withColumns({"x": F.col("x") * factor + F.col("_p") % factor, "y": F.col("y") * factor + F.floor(F.col("_p") / factor).cast("int")}).drop("_p")


def stacked(panels: DataFrame, gap: int, vertical: bool = False, sheet: str = "sheet") -> DataFrame:
    """Panels (sheet, panel, x, y, ...) of each sheet beside or below each other, a gap apart."""
    along = "y" if vertical else "x"
    sizes = panels.groupBy(sheet, "panel").agg((F.max(along) + 1).alias("size"))
    before = Window.partitionBy(sheet).orderBy("panel").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.select(sheet, "panel", F.coalesce(F.sum(F.col("size") + gap).over(before), F.lit(0)).alias("at"))
    return panels.join(placed, [sheet, "panel"]).withColumn(along, F.col(along) + F.col("at")).drop("at")


def draw_rects(frames: DataFrame, cell: int, pad: int = 0) -> DataFrame:
    """Where a frame (w, h; scale, dx, dy or nulls) is drawn in its cell: scaled about its foot, moved, inset by ``pad``.

    Scales are kept within 0.5 and 1.5; a frame without a transform, or with the neutral one, is ``plain``.
    """
    s = F.least(F.lit(1.5), F.greatest(F.lit(0.5), F.coalesce("scale", F.lit(1.0))))
    dx, dy = (F.coalesce(c, F.lit(0.0)) for c in ("dx", "dy"))
    w, h = F.col("w") * s, F.col("h") * s
    plain = (F.coalesce("scale", F.lit(1.0)) == 1) & (dx == 0) & (dy == 0)
    return frames.withColumns({"draw_x": F.lit(cell / 2) - w / 2 + dx + pad, "draw_y": F.lit(float(cell)) - h + dy + pad, "draw_w": w, "draw_h": h, "plain": plain})


def view_transforms(frames: DataFrame, k: float) -> DataFrame:
    """Transforms (scale, dx, dy) in cell pixels as those of a view ``k`` times as large: moves grow, scales stay."""
    return frames.withColumns({c: F.col(c) * k for c in ("dx", "dy")})


def baked(frames: DataFrame, cell: int, pad: int = 0) -> DataFrame:
    """Pixels of frames (w, h; scale, dx, dy or nulls) drawn into a cell of ``cell`` and ``pad`` on each side, by nearest pixels.

    A place takes the source pixel under its middle; places that no source covers are left out.
    """
    s = F.least(F.lit(1.5), F.greatest(F.lit(0.5), F.coalesce("scale", F.lit(1.0))))
    rows = draw_rects(frames.withColumn("_s", s), cell, pad)
    side = cell + 2 * pad

    def reach(at: str, c: str) -> Column:
        """The places of the canvas whose middles lie in a source pixel."""
        low, high = F.col(at) + F.col(c) * F.col("_s"), F.col(at) + (F.col(c) + 1) * F.col("_s")
        first, last = F.greatest(F.ceil(low - 0.5), F.lit(0)), F.least(F.ceil(high - 0.5) - 1, F.lit(side - 1))
        return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    rows = rows.withColumn("_x", F.explode(reach("draw_x", "x"))).withColumn("_y", F.explode(reach("draw_y", "y")))
    return rows.withColumns({"x": F.col("_x").cast("int"), "y": F.col("_y").cast("int")}).drop("_x", "_y", "_s", "draw_x", "draw_y", "draw_w", "draw_h", "plain")
