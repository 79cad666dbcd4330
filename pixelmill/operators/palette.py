"""Palettes, quantisation and pixel scale."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..constants import ALPHA_T, NEAR_CHANNEL
from ..functions import color
from ..sources.images import pixels_of, rasters_of

MERGE_BELOW = 600


def colour_counts(pixels: DataFrame) -> DataFrame:
    """(image_id, r, g, b, n) of the opaque pixels: what every palette step works on instead of pixels."""
    return pixels.where(F.col("a") > ALPHA_T).groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n"))


def gif_palette(pixels: DataFrame, size: int = 255) -> DataFrame:
    """(image_id, rank, r, g, b, n): the most frequent 5-bit buckets by their mean colours; ties by bucket."""
    c = pixels.where("a >= 128")
    bucket = F.shiftleft(F.shiftright("r", 3), 10) + F.shiftleft(F.shiftright("g", 3), 5) + F.shiftright("b", 3)
    means = c.groupBy("image_id", bucket.alias("bucket")).agg(F.count("*").alias("n"), *(F.sum(v).alias(v) for v in "rgb"))
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("n"), "bucket"))
    return means.withColumn("rank", rank).where(F.col("rank") <= size).selectExpr("image_id", "rank", "cast(r div n as int) as r", "cast(g div n as int) as g", "cast(b div n as int) as b", "n")


def sampled(pixels: DataFrame, most: int) -> DataFrame:
    """Every k-th opaque pixel in frame and scan order, k from the number of all pixels."""
    step = pixels.groupBy("image_id").agg(F.greatest(F.lit(1), F.expr(f"count(*) div {most}")).alias("step"))
    order = Window.partitionBy("image_id").orderBy("frame", "y", "x")
    rows = pixels.where(F.col("a") > ALPHA_T).withColumn("i", F.row_number().over(order) - 1)
    return rows.join(step, "image_id").where("i % step = 0").drop("i", "step")


def _cut(colours: np.ndarray, count: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Median cut of weighted colours: always the box of the widest channel, at half its pixels."""
    boxes = [(colours, count)]
    while len(boxes) < size:
        spans = [c.max(axis=0) - c.min(axis=0) if n.sum() > 1 else np.zeros(3, dtype=np.int64) for c, n in boxes]
        widest = max(range(len(boxes)), key=lambda i: (spans[i].max(), -i))
        if spans[widest].max() == 0:
            break
        c, n = boxes[widest]
        channel = int(spans[widest].argmax())
        order = np.argsort(c[:, channel] << 24 | c[:, 0] << 16 | c[:, 1] << 8 | c[:, 2])  # a box's colours are all different
        c, n = c[order], n[order]
        half, upto = int(n.sum()) // 2, np.cumsum(n)
        at = int(np.searchsorted(upto, half))  # the colour that the middle pixel falls in is shared by both halves
        low, high = n.copy(), n.copy()
        low[at] = half - (upto[at] - n[at])
        low[at + 1 :] = 0
        high -= low
        boxes[widest] = (c[low > 0], low[low > 0])
        boxes.append((c[high > 0], high[high > 0]))
    means = sorted(((int(n.sum()), *(int(v) for v in (c * n[:, None]).sum(axis=0) // n.sum())) for c, n in boxes), key=lambda e: -e[0])
    merged: list[list[int]] = []
    for n, *rgb in means:
        near = next((m for m in merged if sum(w * (a - b) ** 2 for w, a, b in zip((2, 4, 3), rgb, m[1:], strict=True)) < MERGE_BELOW), None)
        if near is None:
            merged.append([n, *rgb])
        else:
            total = near[0] + n
            near[:] = [total, *((a * near[0] + b * n) // total for a, b in zip(near[1:], rgb, strict=True))]
    out = [tuple(m[1:]) for m in merged]
    return (out + [(255, 255, 255)])[: max(2, len(out))] if out else [(0, 0, 0), (255, 255, 255)]


def shared_palette(pixels: DataFrame, size: int = 32) -> DataFrame:
    """(image_id, ord, r, g, b): a palette of each set by median cut and merging of near colours.

    A group is an image's distinct colours with their counts, not its pixels.
    """

    def run(table: pa.Table) -> pa.Table:
        colours = np.stack([table.column(c).to_numpy() for c in "rgb"], axis=1).astype(np.int64)
        palette = _cut(colours, table.column("n").to_numpy().astype(np.int64), max(2, size))
        image = table.column("image_id")[0].as_py()
        return pa.table({"image_id": pa.array([image] * len(palette), pa.int64()), "ord": pa.array(range(len(palette)), pa.int32()), **{c: pa.array([p[i] for p in palette], pa.int32()) for i, c in enumerate("rgb")}})

    return colour_counts(pixels).groupBy("image_id").applyInArrow(run, "image_id bigint, ord int, r int, g int, b int")


def nearest(colours: DataFrame, palette: DataFrame) -> DataFrame:
    """(image_id, r, g, b, pr, pg, pb): each distinct colour's nearest palette entry; the first of equals.

    Distinct colours meet their own image's palette only, by an equi join.
    """
    entries = palette.select("image_id", "ord", *(F.col(c).alias(f"p{c}") for c in "rgb"))
    d = color.weighted_distance([F.col(c) for c in "rgb"], [F.col(f"p{c}") for c in "rgb"])
    best = colours.select("image_id", "r", "g", "b").distinct().join(entries, "image_id").groupBy("image_id", "r", "g", "b").agg(F.min_by(F.struct("pr", "pg", "pb"), F.struct(d.alias("d"), "ord")).alias("p"))
    return best.select("image_id", "r", "g", "b", "p.*")


def applied(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """Pixels in palette colours: alpha under 128 becomes empty, the rest opaque."""
    rows = pixels.join(nearest(pixels.where("a >= 128"), palette), ["image_id", "r", "g", "b"], "left")
    kept = F.col("a") >= 128
    others = [c for c in pixels.columns if c not in "rgba"]
    return rows.select(*others, *(F.when(kept, F.col(f"p{c}")).otherwise(F.lit(0)).alias(c) for c in "rgb"), F.when(kept, F.lit(255)).otherwise(F.lit(0)).alias("a"))


def run_lengths(pixels: DataFrame, most: int | None, keys: tuple[str, ...] = ("image_id",), limit: Column | None = None, where: Column | None = None, dealt: bool = False) -> DataFrame:
    """(keys, length, n): runs of like pixels in rows and columns, but for the last one of each line.

    Runs of 2 to ``most`` pixels count, or to ``limit`` where that depends on the image; ``where`` leaves images out. ``dealt``: pixels are dealt by image already.
    """
    pixels = (pixels if where is None else pixels.where(where)).withColumn("limit", F.lit(most) if limit is None else limit)
    found, pixels = None, pixels if dealt else pixels.repartition("image_id")
    for line, along in (("y", "x"), ("x", "y")):
        order = Window.partitionBy(*keys, line).orderBy(along)
        before = [F.lag(c).over(order) for c in "rgba"]
        now = [F.col(c) for c in "rgba"]
        like = ((now[3] <= ALPHA_T) & (before[3] <= ALPHA_T)) | ((now[3] > ALPHA_T) & (before[3] > ALPHA_T) & color.near_rgb(now[:3], before[:3]))
        rows = pixels.withColumn("new", F.when(F.coalesce(like, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
        lengths = rows.groupBy(*keys, line, "island").agg(F.count("*").alias("length"), F.max("limit").alias("limit"))
        last = F.max("island").over(Window.partitionBy(*keys, line))
        part = lengths.withColumn("last", last).where("island < last AND length BETWEEN 2 AND limit").select(*keys, "length")
        found = part if found is None else found.unionByName(part)
    return found.groupBy(*keys, "length").agg(F.count("*").alias("n"))


def pixel_scale(pixels: DataFrame, width: int, height: int, dealt: bool = False) -> DataFrame:
    """(image_id, scale): the run length that covers most; the smaller of equals; 1 for small or native images."""
    ids = pixels.select("image_id").distinct()
    if min(width, height) < 32:
        return ids.withColumn("scale", F.lit(1))
    most = min(32, min(width, height) // 8)
    best = run_lengths(pixels, most, dealt=dealt).groupBy("image_id").agg(F.max_by("length", F.struct(F.col("n") * F.col("length"), -F.col("length"))).alias("scale"))
    return ids.join(best, "image_id", "left").select("image_id", F.coalesce("scale", F.lit(1)).cast("int").alias("scale"))


def block_colours(pixels: DataFrame, scale: int, width: int, height: int) -> DataFrame:
    """(image_id, frame, bx, by, r, g, b): the commonest colour of every block that is half opaque or more; ties by colour."""
    rows = pixels.withColumn("bx", F.expr(f"cast(x div {scale} as int)")).withColumn("by", F.expr(f"cast(y div {scale} as int)")).where(F.col("a") > ALPHA_T)
    counted = rows.groupBy("image_id", "frame", "bx", "by", "r", "g", "b").agg(F.count("*").alias("n"))
    best = counted.groupBy("image_id", "frame", "bx", "by").agg(F.max_by(F.struct("r", "g", "b"), F.struct("n", -F.col("r"), -F.col("g"), -F.col("b"))).alias("c"), F.sum("n").alias("n"))
    area = F.least(F.lit(scale), width - F.col("bx") * scale) * F.least(F.lit(scale), height - F.col("by") * scale)
    return best.where(F.col("n") * 2 >= area).select("image_id", "frame", "bx", "by", "c.*")


def pixelized(pixels: DataFrame, scale: int, width: int, height: int) -> DataFrame:
    """Pixels snapped to their blocks' colours; blocks that are mostly empty become empty."""
    if scale < 2:
        return pixels
    at = [F.expr(f"cast({c} div {scale} as int)").alias(f"b{c}") for c in "xy"]
    rows = pixels.select("image_id", "frame", "x", "y", *at).join(block_colours(pixels, scale, width, height), ["image_id", "frame", "bx", "by"], "left")
    return rows.select("image_id", "frame", "x", "y", *(F.coalesce(c, F.lit(0)).alias(c) for c in "rgb"), F.when(F.col("r").isNull(), 0).otherwise(255).alias("a"))


def colours_of(palette: DataFrame) -> DataFrame:
    """(image_id, colours): each image's palette (image_id, ord, r, g, b) as an array in order."""
    rows = palette.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("ord", "r", "g", "b"))).alias("c"))
    return rows.select("image_id", F.transform("c", lambda e: F.array(e["r"], e["g"], e["b"])).alias("colours"))


def recoloured(image: np.ndarray, colours: np.ndarray) -> np.ndarray:
    """A raster in palette colours, the first of equally near ones; alpha under 128 becomes empty, the rest opaque."""
    kept = image[..., 3] >= 128
    rgb = image[kept][:, :3].astype(np.int64)
    distinct, back = np.unique(rgb[:, 0] << 16 | rgb[:, 1] << 8 | rgb[:, 2], return_inverse=True)
    d = np.stack([distinct >> 16, distinct >> 8 & 255, distinct & 255], axis=1)[:, None] - colours[None]
    out = np.zeros_like(image)
    out[kept, :3] = colours[(d * d * np.array([2, 4, 3])).sum(axis=2).argmin(axis=1)][back.reshape(-1)]
    out[kept, 3] = 255
    return out


def scale_of(image: np.ndarray) -> int:
    """The run length that covers most of a raster's rows and columns, but for the last run of each; the smaller of equals, 1 for small ones."""
    height, width = image.shape[:2]
    if min(height, width) < 32:
        return 1
    total = np.zeros(max(height, width) + 1, dtype=np.int64)
    for lines in (image, image.transpose(1, 0, 2)):
        opaque, rgb = lines[..., 3] > ALPHA_T, lines[..., :3].astype(np.int16)
        like = (opaque[:, 1:] == opaque[:, :-1]) & (~opaque[:, 1:] | (np.abs(rgb[:, 1:] - rgb[:, :-1]).max(axis=2) <= NEAR_CHANNEL))
        new = np.concatenate([np.ones((len(lines), 1), dtype=bool), ~like], axis=1)
        row, at = np.nonzero(new)
        same = row[1:] == row[:-1]
        total += np.bincount((at[1:] - at[:-1])[same], minlength=len(total))[: len(total)]
    length = np.arange(len(total))
    total[(length < 2) | (length > min(32, min(height, width) // 8))] = 0
    return int((total * length).argmax()) if total.any() else 1


def snapped(image: np.ndarray, scale: int) -> np.ndarray:
    """Blocks in their commonest opaque colour, ties by colour; blocks that are mostly empty become empty."""
    if scale < 2:
        return image
    height, width = image.shape[:2]
    across, down = -(-width // scale), -(-height // scale)
    y, x = np.nonzero(image[..., 3] > ALPHA_T)
    rgb = image[y, x, :3].astype(np.int64)
    keys, n = np.unique(((y // scale) * across + x // scale) << 24 | rgb[:, 0] << 16 | rgb[:, 1] << 8 | rgb[:, 2], return_counts=True)
    block = keys >> 24
    order = np.lexsort((keys, -n, block))
    first = order[np.unique(block[order], return_index=True)[1]]
    filled = np.bincount(block, weights=n, minlength=across * down).astype(np.int64)
    area = np.minimum(scale, height - np.arange(down) * scale)[:, None] * np.minimum(scale, width - np.arange(across) * scale)[None]
    small = np.zeros((across * down, 4), dtype=np.uint8)
    main = keys[first]
    small[block[first]] = np.stack([main >> 16 & 255, main >> 8 & 255, main & 255, np.full(len(main), 255)], axis=1)
    small[2 * filled < area.reshape(-1)] = 0
    return small.reshape(down, across, 4).repeat(scale, axis=0).repeat(scale, axis=1)[:height, :width]


def common_colours(image: np.ndarray, size: int) -> np.ndarray:
    """``gif_palette`` of one raster's pixels: the mean colours of the most frequent 5-bit buckets, ties by bucket."""
    rgb = image[image[..., 3] >= 128][:, :3].astype(np.int64)
    bucket, of, n = np.unique(rgb[:, 0] >> 3 << 10 | rgb[:, 1] >> 3 << 5 | rgb[:, 2] >> 3, return_inverse=True, return_counts=True)
    total = np.zeros((len(bucket), 3), dtype=np.int64)
    np.add.at(total, of.reshape(-1), rgb)
    return (total // n[:, None])[np.argsort(-n, kind="stable")[:size]]


@F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _common(frames: pa.Array, size: pa.Array) -> pa.Array:
    out = []
    for own, most in zip(frames.to_pylist(), size.to_pylist(), strict=True):
        found = common_colours(np.concatenate([np.frombuffer(f["pix"], np.uint8) for f in own]).reshape(-1, 1, 4), most)
        out.append(found.tolist() or None)
    return pa.array(out, pa.list_(pa.list_(pa.int32())))


def common_palette(sets: DataFrame, size: int = 255) -> DataFrame:
    """``sets`` (``images.sets_of``) with ``colours``, each set's own palette (null where nothing shows): found where its frames are."""
    return sets.withColumn("colours", _common("frames", F.lit(size)))


_DONE = T.ArrayType(T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("frame", "w", "h", "scale")), T.StructField("pix", T.BinaryType())]))


@F.arrow_udf(_DONE)
def _processed(frames: pa.Array, colours: pa.Array) -> pa.Array:
    out = []
    for own, c in zip(frames.to_pylist(), colours.to_pylist(), strict=True):
        made = [np.frombuffer(f["pix"], np.uint8).reshape(f["h"], f["w"], 4) for f in own]
        if c is not None:
            made = [recoloured(image, np.array(c, dtype=np.int64)) for image in made]
        scale = sorted(scale_of(image) for image in made)[len(made) // 2]
        out.append([{**f, "scale": scale, "pix": snapped(image, scale).tobytes()} for f, image in zip(own, made, strict=True)])
    return pa.array(out, pa.list_(pa.struct([*((c, pa.int32()) for c in ("frame", "w", "h", "scale")), ("pix", pa.binary())])))


def post_processed_sets(sets: DataFrame) -> DataFrame:
    """(image_id, frame, w, h, scale, pix): each set's frames in its ``colours``, snapped to the grid that most of them show.

    ``sets`` are (image_id, frames, colours) as from ``common_palette``, a row a set, so nothing is shuffled. The grid's scale is the upper median
    of the frames' own; sets with a scale under 2 keep their pixels.
    """
    done = _processed.asNondeterministic()("frames", "colours")  # else Catalyst runs it a second time, to filter what the generator gets
    return sets.select("image_id", done.alias("done")).select("image_id", F.inline("done"))


def post_processed_rasters(rasters: DataFrame, palette: DataFrame) -> DataFrame:
    """``post_processed_sets`` of rasters (image_id, frame, w, h, pix) in given palettes (image_id, ord, r, g, b) as from ``shared_palette``.

    Frames meet each other and their palette in one dealing by image. It has a fixed number of tasks: rasters of few colours are compressed
    to so little that Spark would take them for one task's work.
    """
    tasks = int(rasters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frames = F.array_sort(F.collect_list(F.struct(*(F.col(c).cast("int").alias(c) for c in ("frame", "w", "h")), "pix")))
    sets = rasters.repartition(tasks, "image_id").groupBy("image_id").agg(frames.alias("frames"))
    return post_processed_sets(sets.join(colours_of(palette), "image_id", "left"))


def post_processed(frames: DataFrame, palette: DataFrame, sizes: DataFrame) -> DataFrame:
    """``post_processed_rasters`` of a table of pixels: (image_id, frame, x, y, r, g, b, a); ``sizes`` (image_id, w, h) are the frames'."""
    rows = frames.select("image_id", "frame", "x", "y", *"rgba").join(sizes.select("image_id", "w", "h"), "image_id")
    return pixels_of(post_processed_rasters(rasters_of(rows, frame="frame"), palette), "image_id", "frame")
