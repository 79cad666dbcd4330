"""What a set of sprites is handed over as: sheets with their manifests, frames, animations and raw strips, as rows (bundle, name, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sanitized_strip
from ..sources import images
from . import layout


def manifest_json(cells: DataFrame, cell_w: int, cell_h: int, image: str = "sprite-sheet.png") -> DataFrame:
    """(sheet, json): what a sheet is and its animations by name: row, rate, loop, places, trims and the common foot point.

    ``cells`` as from ``layout.atlas``, with ``fps`` and ``loop`` of their state. A sheet is one character's, so its lists are bounded by it.
    """
    rect = F.struct(F.col("x"), F.col("y"), F.lit(cell_w).alias("w"), F.lit(cell_h).alias("h"))
    trim = F.struct(F.col("trim_x").alias("x"), F.col("trim_y").alias("y"), F.col("trim_w").alias("w"), F.col("trim_h").alias("h"))
    states = cells.groupBy("sheet", "image_id", "row").agg(
        F.array_sort(F.collect_list(F.struct("frame", rect.alias("rect"), trim.alias("trim")))).alias("c"), F.first("fps").alias("fps"), F.first("loop").alias("loop"),
        F.first("duration").alias("duration"), F.first("pivot_x").alias("px"), F.first("pivot_y").alias("py"), (F.max("x") + cell_w).alias("width"),
    )
    fps = F.when(F.col("fps") > 0, F.col("fps")).otherwise(8)
    entry = F.struct(
        F.col("row"), F.size("c").alias("frames"), fps.alias("fps"), F.coalesce("loop", F.lit(True)).alias("loop"), F.col("duration").alias("durationMs"), F.struct(F.col("px").alias("x"), F.col("py").alias("y")).alias("pivot"),
        F.col("c.rect").alias("rects"), F.col("c.trim").alias("trims"),
    )
    whole = states.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("row", F.col("image_id").cast("string").alias("name"), entry.alias("entry")))).alias("s"), F.max("width").alias("width"), ((F.max("row") + 1) * cell_h).alias("height"))
    sheet = F.struct(F.lit(image).alias("image"), F.col("width"), F.col("height"), F.lit(cell_w).alias("cellWidth"), F.lit(cell_h).alias("cellHeight"))
    animations = F.map_from_entries(F.transform("s", lambda s: F.struct(s["name"], s["entry"])))
    return whole.select("sheet", F.to_json(F.struct(F.lit("pixelmill").alias("app"), F.lit(1).alias("version"), F.col("sheet").cast("string").alias("character"), sheet.alias("sheet"), animations.alias("animations"))).alias("json"))


def _files(rows: DataFrame, bundle, name, content) -> DataFrame:
    return rows.select(bundle.cast("string").alias("bundle"), name.alias("name"), content.alias("content"))


def project(frames: DataFrame, states: DataFrame, palette: DataFrame, cell_w: int, cell_h: int) -> DataFrame:
    """(bundle, name, content): each sheet as a project: sheet, both of its descriptions, every frame, and an APNG and a GIF of every state.

    ``frames``: rasters' pixels (image_id, frame, x, y, r, g, b, a, w, h); ``states``: image_id, sheet, row, fps, loop; ``palette`` as from ``gif_palette``.
    """
    cells = layout.atlas(frames, states, cell_w, cell_h).join(states.select("image_id", "fps", "loop"), "image_id")
    named = lambda tail: F.concat(F.col("sheet").cast("string"), F.lit(f"-{tail}"))
    sheets = images.png_bytes(images.rasters_of(layout.sheet_pixels(frames, states, cell_w, cell_h), "sheet"), "sheet")
    made = images.rasters_of(frames, frame="frame")
    owner = states.select("image_id", "sheet")
    stills = images.png_bytes(made.withColumn("at", F.struct("image_id", "frame")), "at").select("at.*", "content").join(owner, "image_id")
    out = _files(sheets, F.col("sheet"), named("sprite-sheet.png"), F.col("content"))
    out = out.unionByName(_files(layout.sheet_json(cells, cell_w, cell_h), F.col("sheet"), named("sprite-sheet.json"), F.col("json").cast("binary")))
    out = out.unionByName(_files(manifest_json(cells, cell_w, cell_h), F.col("sheet"), named("manifest.json"), F.col("json").cast("binary")))
    state = F.col("image_id").cast("string")
    out = out.unionByName(_files(stills, F.col("sheet"), F.concat(F.lit("frames/"), state, F.lit("/frame-"), F.lpad(F.col("frame").cast("string"), 2, "0"), F.lit(".png")), F.col("content")))
    for kind, ending in (("apng", "png"), ("gif", "gif")):
        moving = images.animated(made, kind, palette).join(owner, "image_id")
        out = out.unionByName(_files(moving, F.col("sheet"), F.concat(F.lit(f"{kind}/"), state, F.lit(f".{ending}")), F.col("content")))
    return out


def raw_strips(rasters: DataFrame, bundle: str = "raw-strips") -> DataFrame:
    """(bundle, name, content): strips (image_id, expected, w, h, pix) as PNG files, and the list that says how many figures each was to have."""
    file = F.concat(sanitized_strip(F.col("image_id").cast("string")), F.lit("-raw.png"))
    strips = images.png_bytes(rasters).select(F.lit(bundle).alias("bundle"), file.alias("name"), "content")
    entry = F.struct(F.col("image_id").cast("string").alias("name"), F.col("expected").alias("frames"), file.alias("path"))
    listed = rasters.select("image_id", "expected").agg(F.array_sort(F.collect_list(entry)).alias("e"))  # a list of names: one file by its nature
    return strips.unionByName(listed.select(F.lit(bundle).alias("bundle"), F.lit("strips.json").alias("name"), F.to_json("e").cast("binary").alias("content")))


def gallery(frames: DataFrame, named: DataFrame, bundle: str = "gallery") -> DataFrame:
    """(bundle, name, content): each set's frames as one strip, in a file named by its state and a stamp; ``named`` has image_id, state, stamp.

    ``frames``: pixels (image_id, frame, x, y, r, g, b, a), clear ones included, so that widths are known.
    """
    strips = images.png_bytes(images.rasters_of(layout.concatenated(frames)))
    name = F.concat(sanitized_strip(F.col("state")), F.lit("-"), F.col("stamp"), F.lit(".png"))
    return strips.join(named, "image_id").select(F.lit(bundle).alias("bundle"), name.alias("name"), "content")
