"""Image files: listing, decoding to rasters and pixels, encoding of PNG, APNG and GIF, writing files.

Rasters are rows (name, w, h, pix): packed RGBA by rows. Codecs run on Arrow batches, one image at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import ALPHA_T
from ..functions.batches import per_group
from .decoders import frames_of

# File name endings of images and their media types; the largest file that is read.
MEDIA = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".bmp": "image/bmp", ".webp": "image/webp"}
MOST_BYTES, MOST_FILES = 64 << 20, 2000  # of a listing for a person; None for all of a folder
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def listing(spark: SparkSession, folder: str, newest_first: bool = False, most: int | None = MOST_FILES) -> DataFrame:
    """(path, name, length, modified) of a folder's images: the first ``most`` by name (None: all), then by name or newest first."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    files = files.where(F.regexp_extract(F.lower("name"), r"(\.[a-z]+)$", 1).isin(list(MEDIA)))
    first = files.orderBy("name").limit(most) if most else files
    return first.orderBy(F.desc("modified"), "name") if newest_first else first.orderBy("name")


def contents(spark: SparkSession, folder: str, most: int | None = MOST_BYTES) -> DataFrame:
    """(path, content, error): bytes of image files of at most ``most`` bytes (None: any); the others carry an error."""
    files = spark.read.format("binaryFile").load(folder).where(F.regexp_extract(F.lower("path"), r"(\.[a-z]+)$", 1).isin(list(MEDIA)))
    fits = F.col("length") <= most if most else F.lit(True)
    return files.select("path", F.when(fits, F.col("content")).alias("content"), F.when(~fits, F.lit("too large")).alias("error"))


def frame_counts(spark: SparkSession, folder: str, stem: str = "frame-") -> DataFrame:
    """(folder, n): how many PNG files with the stem each folder under ``folder`` has."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    found = files.where(name.startswith(stem) & F.lower(name).endswith(".png"))
    return found.groupBy(F.element_at(F.split("path", "/"), -2).alias("folder")).agg(F.count("*").alias("n"))


def strip_entries(spark: SparkSession, path: str) -> DataFrame:
    """(name, frames, path) of a JSON list of strips."""
    listed = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<struct<name:string,frames:int,path:string>>").alias("v"))
    return listed.select(F.inline("v"))


def data_url(content: Column, media: Column) -> Column:
    """Whole bytes as a data URL (needs spark.sql.chunkBase64String.enabled=false for one line)."""
    return F.concat(F.lit("data:"), media, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def data_url_bytes(url: Column) -> Column:
    """The bytes of an image's data URL, null if it is none."""
    body = F.regexp_extract(url, r"^data:image/[a-zA-Z+.-]+;base64,(.*)$", 1)
    return F.when(body != "", F.unbase64(body))


def decode_png(content: bytes) -> np.ndarray:
    """A PNG as rows x columns x RGBA: the still image, or the first frame of an animation."""
    if content[:8] != _SIGNATURE:
        raise ValueError("no PNG signature")
    return frames_of(content)[0]


def _chunk(kind: bytes, part: bytes) -> bytes:
    return struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))


def _packed(image: np.ndarray) -> bytes:
    height, width = image.shape[:2]
    lines = np.zeros((height, 1 + width * 4), dtype=np.uint8)
    lines[:, 1:] = image.reshape(height, -1)
    return zlib.compress(lines.tobytes(), 6)


def encode_png(image: np.ndarray) -> bytes:
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 6, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", _packed(image)) + _chunk(b"IEND", b"")


def encode_apng(images: list[np.ndarray], fps: int, loop: bool) -> bytes:
    """Frames of one size, shown 1/fps of a second each, endlessly or once."""
    height, width = images[0].shape[:2]
    out = _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + _chunk(b"acTL", struct.pack(">II", len(images), 0 if loop else 1))
    number = 0
    for i, image in enumerate(images):
        out += _chunk(b"fcTL", struct.pack(">IIIIIHHBB", number, width, height, 0, 0, 1, max(1, fps), 0, 0))
        number += 1
        if i == 0:
            out += _chunk(b"IDAT", _packed(image))
        else:
            out += _chunk(b"fdAT", struct.pack(">I", number) + _packed(image))
            number += 1
    return out + _chunk(b"IEND", b"")


def _lzw(codes: np.ndarray, bits: int) -> bytes:
    """Variable-width codes for the places of a picture, in blocks of 255 bytes."""
    clear, end = 1 << bits, (1 << bits) + 1
    table, size, buffer, held, out = {}, bits + 1, 0, 0, bytearray()

    def put(code: int) -> None:
        nonlocal buffer, held
        buffer |= code << held
        held += size
        while held >= 8:
            out.append(buffer & 255)
            buffer >>= 8
            held -= 8

    put(clear)
    following, run = end + 1, int(codes[0])
    for value in codes[1:].tolist():
        key = (run, value)
        if key in table:
            run = table[key]
            continue
        put(run)
        if following < 4096:
            table[key] = following
            if following == 1 << size and size < 12:
                size += 1
            following += 1
        else:
            put(clear)
            table, following, size = {}, end + 1, bits + 1
        run = value
    put(run)
    put(end)
    if held:
        out.append(buffer & 255)
    return b"".join(bytes([len(out[i : i + 255])]) + bytes(out[i : i + 255]) for i in range(0, len(out), 255)) + b"\0"


def encode_gif(images: list[np.ndarray], palette: np.ndarray, fps: int, loop: bool) -> bytes:
    """Frames in a shared palette of at most 255 colours; alpha under 128 is place 0, which is clear."""
    height, width = images[0].shape[:2]
    colours = np.zeros((256, 3), dtype=np.uint8)
    colours[1 : len(palette) + 1] = palette[:255]
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0xF7, 0, 0) + colours.tobytes()
    if loop:
        out += b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"
    delay = max(2, 100 // max(1, fps))
    for image in images:
        flat = image.reshape(-1, 4).astype(np.int64)
        distinct, back = np.unique(flat[:, :3], axis=0, return_inverse=True)
        d = distinct[:, None, :] - palette[None, :255].astype(np.int64)
        place = (d * d * np.array([2, 4, 3])).sum(axis=2).argmin(axis=1) + 1
        codes = np.where(flat[:, 3] < 128, 0, place[back.reshape(-1)])
        out += b"\x21\xf9\x04\x09" + struct.pack("<H", delay) + b"\x00\x00" + b"\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 0) + b"\x08" + _lzw(codes, 8)
    return out + b"\x3b"


def decoded(files: DataFrame) -> DataFrame:
    """(path, w, h, pix, error) of (path, content): the first frame of each file as a raster; what is no image keeps its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    image = frames_of(content.as_py() or b"")[0]
                    row = [path, image.shape[1], image.shape[0], image.tobytes(), None]
                except ValueError as problem:
                    row = [path, None, None, None, str(problem)]
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
                yield pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["path", "w", "h", "pix", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, w int, h int, pix binary, error string")


def animations(files: DataFrame) -> DataFrame:
    """(path, frame, w, h, pix, error) of (path, content): every frame of each file; what is no image is one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows = [[path, i, f.shape[1], f.shape[0], f.tobytes(), None] for i, f in enumerate(frames_of(content.as_py() or b""))]
                except ValueError as problem:
                    rows = [[path, None, None, None, None, str(problem)]]
                for row in rows:
                    yield pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["path", "frame", "w", "h", "pix", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, frame int, w int, h int, pix binary, error string")


def animated(frames: DataFrame, kind: str, palette: DataFrame | None = None, fps: int = 8, loop: bool = True) -> DataFrame:
    """(image_id, content): each set's rasters (image_id, frame, w, h, pix), which have one size, as an APNG or a GIF (``kind``).

    A GIF takes its set's ``palette`` (image_id, rank, r, g, b). A group is one set's frames.
    """
    rows = frames.select("image_id", "frame", "w", "h", "pix")
    if kind == "gif":
        colours = palette.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("rank", "r", "g", "b"))).alias("c"))
        rows = rows.join(colours.select("image_id", F.transform("c", lambda e: F.array(e["r"], e["g"], e["b"])).alias("colours")), "image_id", "left")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("frame")
        images = [np.frombuffer(p, np.uint8).reshape(h, w, 4) for w, h, p in zip(*(table.column(c).to_pylist() for c in ("w", "h", "pix")), strict=True)]
        if kind == "gif":
            content = encode_gif(images, np.array(table.column("colours")[0].as_py() or [[0, 0, 0]], dtype=np.uint8), fps, loop)
        else:
            content = encode_apng(images, fps, loop)
        return pa.table([table.column("image_id").slice(0, 1), pa.array([content], pa.binary())], names=["image_id", "content"])

    return per_group(rows, "image_id", run, f"image_id {dict(frames.dtypes)['image_id']}, content binary")


def thumbnail_urls(files: DataFrame, most: int = 200) -> DataFrame:
    """(path, url) of (path, content, media): a data URL that fits into a square; of what fits already, or is no known image, the file as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, media = [], batch.column(2).to_pylist()
            for i, content in enumerate(batch.column(1)):
                raw = content.as_py() or b""
                try:
                    image = frames_of(raw)[0]
                    h, w = image.shape[:2]
                    if max(w, h) > most:
                        raw, media[i] = encode_png(resampled(image, max(1, w * most // max(w, h)), max(1, h * most // max(w, h)))), "image/png"
                except ValueError:
                    pass
                out.append(raw)
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary()), pa.array(media, pa.string())], names=["path", "content", "media"])

    small = files.select("path", "content", "media").mapInArrow(run, "path string, content binary, media string")
    return small.select("path", data_url(F.col("content"), F.col("media")).alias("url"))


def media_type(path: Column) -> Column:
    """The media type that a file's ending tells; null for another ending."""
    ending = F.regexp_extract(F.lower(path), r"(\.[a-z]+)$", 1)
    kinds = F.create_map(*[F.lit(v) for pair in MEDIA.items() for v in pair])
    return kinds[ending]


def pixels_of(rasters: DataFrame, key: str = "image_id", *also: str) -> DataFrame:
    """(key, also, x, y, r, g, b, a): rasters as a row a pixel, made in the raster's own task."""
    names = [key, *also]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(names) + 3)), strict=True):
                w, h, pix = row[len(names) :]
                flat = np.frombuffer(pix, np.uint8).reshape(-1, 4).astype(np.int32)
                y, x = np.divmod(np.arange(w * h, dtype=np.int32), w)
                for at in range(0, w * h, 1 << 16):
                    s = slice(at, at + (1 << 16))
                    n = len(x[s])
                    keys = [pa.array([v] * n, batch.column(i).type) for i, v in enumerate(row[: len(names)])]
                    yield pa.record_batch([*keys, pa.array(x[s]), pa.array(y[s]), *(pa.array(np.ascontiguousarray(flat[s, c])) for c in range(4))], names=[*names, "x", "y", "r", "g", "b", "a"])

    kinds = dict(rasters.dtypes)
    return rasters.select(*names, "w", "h", "pix").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", x int, y int, r int, g int, b int, a int")


_SUMS = ("n", "opaque", "opaque_x", "mark", "sum_r", "sum_g", "sum_b", "sum_a")


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in _SUMS]))
def _summed(w: pa.Array, h: pa.Array, pix: pa.Array) -> pa.Array:
    rows = []
    for a, b, p in zip(w.to_pylist(), h.to_pylist(), pix.to_pylist(), strict=True):
        image = np.frombuffer(p, np.uint8).reshape(b, a, 4)
        alpha = image[..., 3]
        on, x = alpha > ALPHA_T, np.arange(a)
        mark = alpha.astype(np.int64) @ (x + 1) @ np.arange(1, b + 1)
        rows.append((np.count_nonzero(alpha), np.count_nonzero(on), on.sum(axis=0) @ x, mark, *image.sum(axis=(0, 1), dtype=np.int64)))
    values = np.array(rows, dtype=np.int64).reshape(-1, len(_SUMS))
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(values[:, i])) for i in range(len(_SUMS))], names=list(_SUMS))


def sums_of(rasters: DataFrame, *also: str) -> DataFrame:
    """(also, n, opaque, opaque_x, mark, sum_r, sum_g, sum_b, sum_a): what a raster's pixels sum to, without a row a pixel.

    n has alpha; ``opaque`` is above the threshold of empty pixels, ``opaque_x`` the sum of their columns; ``mark`` sums (x + 1) * (y + 1) * a.
    """
    return rasters.select(*also, _summed("w", "h", "pix").alias("s")).select(*also, "s.*")


#: Frames of a set in a row.
SET = pa.list_(pa.struct([("frame", pa.int32()), ("w", pa.int32()), ("h", pa.int32()), ("pix", pa.binary())]))


def _rgba() -> Column:
    """A pixel's bytes as one integer, as they lie in a raster: fewer columns on their way to Python."""
    r, g, b, a = (F.coalesce(c, F.lit(0)).cast("int").bitwiseAND(255) for c in "rgba")
    return r.bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(F.shiftleft(b, 16)).bitwiseOR(F.shiftleft(a, 24)).alias("rgba")


def _raster(table: pa.Table, rows, size: tuple[int, int] | None = None) -> list:
    """Width, height and packed pixels of some of a table's rows."""
    x, y, pix = (table.column(c).to_numpy()[rows] for c in ("x", "y", "rgba"))
    w, h = size or (int(x.max()) + 1, int(y.max()) + 1)
    image = np.zeros((h, w), dtype="<i4")
    image[y, x] = pix
    return [w, h, image.tobytes()]


def _by_frame(table: pa.Table, frame: str) -> list:
    """(frame, w, h, pix) of each of a set's frames, in order."""
    number, w, h = (table.column(c).to_numpy() for c in (frame, "w", "h"))
    out = []
    for n in np.unique(number):
        own = np.flatnonzero(number == n)
        out.append([n, *_raster(table, own, (int(w[own[0]]), int(h[own[0]])))])
    return out


def rasters_of(pixels: DataFrame, key: str = "image_id", clustered: bool = False, frame: str | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """(key, [frame,] also, w, h, pix): a row a raster, from a row a pixel; a group is one image, or one set of frames.

    With ``frame`` a set's rasters are as large as the columns ``w`` and ``h`` say, else as far as there are pixels; places without
    a pixel are clear. ``clustered``: see ``per_group``. ``also`` are columns that an image has one value of.
    """

    def run(table: pa.Table) -> pa.Table:
        heads, rows = table.select([key, *also]).slice(0, 1), []
        if frame is None:
            rows.append([None, *_raster(table, slice(None))])
        else:
            rows = _by_frame(table, frame)
        out = heads.take(pa.array([0] * len(rows)))
        if frame is not None:
            out = out.add_column(1, frame, pa.array([r[0] for r in rows], table.schema.field(frame).type))
        for i, (name, kind) in enumerate((("w", pa.int32()), ("h", pa.int32()), ("pix", pa.binary())), 1):
            out = out.append_column(name, pa.array([r[i] for r in rows], kind))
        return out

    kinds = dict(pixels.dtypes)
    names = [key, *([frame] if frame else []), *also]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", w int, h int, pix binary"
    return per_group(pixels.select(*names, "x", "y", _rgba(), *(("w", "h") if frame else ())), key, run, schema, clustered)


def sets_of(pixels: DataFrame, key: str = "image_id", clustered: bool = False, frame: str = "frame") -> DataFrame:
    """(key, frames): a row a set, its frames in order as an array of (frame, w, h, pix); pixels as for ``rasters_of`` with ``frame``."""

    def run(table: pa.Table) -> pa.Table:
        frames = [dict(zip(("frame", "w", "h", "pix"), row, strict=True)) for row in _by_frame(table, frame)]
        return table.select([key]).slice(0, 1).append_column("frames", pa.array([frames], SET))

    kinds = dict(pixels.dtypes)
    rows = pixels.select(key, F.col(frame).cast("int").alias(frame), "x", "y", _rgba(), "w", "h")
    return per_group(rows, key, run, f"`{key}` {kinds[key]}, frames array<struct<frame:int,w:int,h:int,pix:binary>>", clustered)


def thumbnails(rasters: DataFrame, most: int = 200, key: str = "image_id") -> DataFrame:
    """Rasters fitted into a square by bilinear sampling; those that fit already pass as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for w, h, pix in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if max(w, h) > most:
                    image = np.frombuffer(pix, np.uint8).reshape(h, w, 4)
                    image = resampled(image, max(1, w * most // max(w, h)), max(1, h * most // max(w, h)))
                    w, h, pix = image.shape[1], image.shape[0], image.tobytes()
                rows.append((w, h, pix))
            yield pa.record_batch([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.binary())))], names=[key, "w", "h", "pix"])

    kind = dict(rasters.dtypes)[key]
    return rasters.select(key, "w", "h", "pix").mapInArrow(run, f"`{key}` {kind}, w int, h int, pix binary")


def resampled(image: np.ndarray, width: int, height: int, cubic: bool = False) -> np.ndarray:
    """A smaller or larger image by separable weights (bilinear, or Catmull-Rom) over premultiplied colour."""

    def weights(source: int, target: int) -> np.ndarray:
        ratio = source / target
        reach = max(1.0, ratio)
        centre = (np.arange(target) + 0.5) * ratio - 0.5
        d = np.abs(np.arange(source)[None, :] - centre[:, None]) / reach
        if cubic:
            w = np.where(d < 1, 1.5 * d**3 - 2.5 * d**2 + 1, np.where(d < 2, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2, 0))
        else:
            w = np.maximum(0, 1 - d)
        return w / w.sum(axis=1, keepdims=True)

    full = image.astype(np.float64)
    full[..., :3] *= full[..., 3:] / 255
    out = np.einsum("yh,xw,hwc->yxc", weights(image.shape[0], height), weights(image.shape[1], width), full, optimize=True)
    alpha = np.clip(out[..., 3:], 0, 255)
    rgb = np.divide(out[..., :3] * 255, alpha, out=np.zeros_like(out[..., :3]), where=alpha > 0)
    return np.floor(np.clip(np.concatenate([rgb, alpha], axis=2), 0, 255) + 0.5).astype(np.uint8)


def png_bytes(rasters: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, content) of rasters, as PNG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [encode_png(np.frombuffer(p, np.uint8).reshape(h, w, 4)) for w, h, p in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(files, pa.binary())], names=[key, "content"])

    kind = dict(rasters.dtypes)[key]
    return rasters.select(key, "w", "h", "pix").mapInArrow(run, f"`{key}` {kind}, content binary")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """(name, bytes) of (name, content) rows, once each file is under ``folder`` (a URI that all executors reach).

    A file is written beside its place and then moved, so a task that runs twice leaves one whole file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        target, base = fs.FileSystem.from_uri(folder)
        target.create_dir(base, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = f"{base}/.{name}-{uuid.uuid4().hex}"
                with target.open_output_stream(part) as out:
                    out.write(content)
                target.move(part, f"{base}/{name}")
            yield pa.record_batch([batch.column(0), pa.array([len(c) for c in batch.column(1).to_pylist()], pa.int64())], names=["name", "bytes"])

    return files.select("name", "content").mapInArrow(run, "name string, bytes bigint")
