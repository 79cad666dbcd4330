"""Decoders against encoders written here, and files that are damaged."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.sources import decoders, images

RNG = np.random.default_rng(12)
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def png(samples, colour, depth, interlaced=False, more=()):
    """A PNG of rows x columns x channels of samples."""
    height, width, _ = samples.shape
    body = b""
    for x, y, dx, dy in PASSES if interlaced else [(0, 0, 1, 1)]:
        for line in samples[y::dy, x::dx] if samples[y::dy, x::dx].size else []:
            flat = line.reshape(-1)
            if depth == 16:
                packed = (flat.astype(np.uint16) * 257).astype(">u2").tobytes()
            else:
                bits = (flat[:, None] >> np.arange(depth - 1, -1, -1) & 1).reshape(-1).astype(np.uint8)
                packed = np.packbits(bits).tobytes()
            body += b"\0" + packed
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(interlaced))
    chunks = [(b"IHDR", head), *more, (b"IDAT", zlib.compress(body)), (b"IEND", b"")]
    return images._SIGNATURE + b"".join(images._chunk(*c) for c in chunks)


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize(("colour", "depth"), [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 2), (3, 4), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)])
def test_png_of_every_depth(colour, depth, interlaced):
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    for width, height in ((1, 1), (5, 3), (13, 17)):
        top = 256 if depth == 16 else 1 << depth
        samples = RNG.integers(0, top, (height, width, channels))
        palette = RNG.integers(0, 256, (1 << min(depth, 8), 3)).astype(np.uint8)
        more = [(b"PLTE", palette.tobytes()), (b"tRNS", bytes([7]))] if colour == 3 else []
        (image,) = decoders.frames_of(png(samples, colour, depth, interlaced, more))
        if colour == 3:
            assert (image[..., :3] == palette[samples[..., 0]]).all() and (image[..., 3] == np.where(samples[..., 0] == 0, 7, 255)).all()
            continue
        full = samples if depth >= 8 else samples * 255 // (top - 1)
        rgb = full[..., :1].repeat(3, axis=2) if channels < 3 else full[..., :3]
        assert (image[..., :3] == rgb).all() and (image[..., 3] == (full[..., -1] if colour in (4, 6) else 255)).all()


def test_a_clear_grey():
    samples = np.array([[[0], [3]], [[2], [3]]])
    (image,) = decoders.frames_of(png(samples, 0, 2, more=[(b"tRNS", struct.pack(">H", 3))]))
    assert image[..., 3].tolist() == [[255, 0], [255, 0]]


def made(n, height=20, width=30):
    frames = RNG.integers(0, 256, (n, height, width, 4)).astype(np.uint8)
    frames[..., 3] = np.where(frames[..., 3] > 90, 255, 0)
    return list(frames)


def test_apng_comes_back():
    frames = made(4)
    assert all((a == b).all() for a, b in zip(decoders.frames_of(images.encode_apng(frames, 10, True)), frames, strict=True))


def test_gif_comes_back():
    palette = RNG.integers(0, 256, (200, 3)).astype(np.uint8)
    frames = []
    for _ in range(3):
        place = RNG.integers(0, 200, (64, 90))
        alpha = np.where(RNG.integers(0, 4, (64, 90)) > 0, 255, 0).astype(np.uint8)
        frames.append(np.dstack([palette[place], alpha]))
    back = decoders.frames_of(images.encode_gif(frames, palette, 12, True))
    for a, b in zip(back, frames, strict=True):
        seen = b[..., 3] > 0
        assert (a[..., 3] == b[..., 3]).all() and (a[seen] == b[seen]).all()


def test_gif_of_rows_in_passes_with_a_palette_of_its_own():
    colours = np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]], np.uint8)
    place = RNG.integers(0, 4, (11, 6))
    order = [*range(0, 11, 8), *range(4, 11, 8), *range(2, 11, 4), *range(1, 11, 2)]
    body = b"GIF89a" + struct.pack("<HHBBB", 8, 12, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 1, 1, 6, 11, 0xC1) + colours.tobytes() + b"\x02" + images._lzw(place[order].reshape(-1), 2) + b"\x3b"
    (image,) = decoders.frames_of(body)
    assert image.shape == (12, 8, 4) and (image[1:, 1:7, :3] == colours[place]).all() and not image[0].any() and not image[:, 7].any()


@pytest.mark.parametrize(("bits", "down"), [(1, False), (4, False), (8, False), (24, False), (24, True), (32, False)])
def test_bmp(bits, down):
    width, height = 7, 5
    if bits <= 8:
        palette = RNG.integers(0, 256, (1 << bits, 4)).astype(np.uint8)
        place = RNG.integers(0, 1 << bits, (height, width))
        lines = [np.packbits((row[:, None] >> np.arange(bits - 1, -1, -1) & 1).reshape(-1).astype(np.uint8)).tobytes() for row in place]
        want, table = palette[place][..., 2::-1], palette.tobytes()
    else:
        pixel = RNG.integers(1, 256, (height, width, bits // 8)).astype(np.uint8)
        lines, want, table = [row.tobytes() for row in pixel], pixel[..., 2::-1], b""
    lines = [x.ljust((width * bits + 31) // 32 * 4, b"\0") for x in lines]
    head = struct.pack("<IiiHHIIiiII", 40, width, -height if down else height, 1, bits, 0, 0, 0, 0, 0, 0)
    content = b"BM" + struct.pack("<IHHI", 0, 0, 0, 14 + 40 + len(table)) + head + table + b"".join(lines if down else lines[::-1])
    (image,) = decoders.frames_of(content)
    assert (image[..., :3] == want).all() and (bits < 32 or (image[..., 3] == pixel[..., 3]).all())


# --- a baseline JPEG encoder with made-up Huffman tables of 8 bits


def jpeg(image, half=False, every=0):
    height, width = image.shape[:2]
    r, g, b = (image[..., k].astype(float) for k in range(3))
    planes = [0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b]
    f = 2 if half else 1
    unit = 8 * f
    planes = [np.pad(p, ((0, -height % unit), (0, -width % unit)), mode="edge") - 128 for p in planes]
    if half:
        planes[1:] = [p.reshape(p.shape[0] // 2, 2, -1, 2).mean(axis=(1, 3)) for p in planes[1:]]
    x = np.arange(8)
    basis = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * k + 1) * u * np.pi / 16) for k in x] for u in x])
    walk = [(0, 0)]
    while len(walk) < 64:  # along diagonals, turning at the edges
        i, j = walk[-1]
        up = (i + j) % 2 == 0
        if up:
            walk.append((i + 1, j) if j == 7 else (i, 1 + j) if i == 0 else (i - 1, j + 1))
        else:
            walk.append((i, j + 1) if i == 7 else (i + 1, j) if j == 0 else (i + 1, j - 1))
    symbols = [*range(12), *(run << 4 | size for run in range(16) for size in range(1, 11)), 0xF0]
    symbols = list(dict.fromkeys(symbols))
    code = {s: (k, 8) if k < 250 else None for k, s in enumerate(symbols)}
    bits, out, last, done = [], b"", [0, 0, 0], 0

    def put(value, n):
        bits.append(format(value, f"0{n}b") if n else "")

    def number(v):
        n = abs(v).bit_length()
        return n, (v if v >= 0 else v + (1 << n) - 1)

    def flush():
        text = "".join(bits)
        text += "1" * (-len(text) % 8)
        bits.clear()
        return int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00") if text else b""

    down, across = planes[0].shape[0] // unit, planes[0].shape[1] // unit
    for row in range(down):
        for col in range(across):
            if every and done and done % every == 0:
                out += flush() + bytes([0xFF, 0xD0 + (done // every - 1) % 8])
                last = [0, 0, 0]
            done += 1
            for k, plane in enumerate(planes):
                n = f if k == 0 else 1
                for i in range(n):
                    for j in range(n):
                        y0, x0 = (row * n + i) * 8, (col * n + j) * 8
                        c = np.rint(basis @ plane[y0 : y0 + 8, x0 : x0 + 8] @ basis.T).astype(int)
                        line = [c[p] for p in walk]
                        size, value = number(int(line[0]) - last[k])
                        last[k] = int(line[0])
                        put(*code[size])
                        put(value, size)
                        run = 0
                        for v in line[1:]:
                            if v == 0:
                                run += 1
                                continue
                            while run > 15:
                                put(*code[0xF0])
                                run -= 16
                            size, value = number(int(v))
                            put(*code[run << 4 | size])
                            put(value, size)
                            run = 0
                        if run:
                            put(*code[0])
    out += flush()
    seg = lambda mark, part: bytes([0xFF, mark]) + struct.pack(">H", len(part) + 2) + part
    table = bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols)
    head = struct.pack(">BHHB", 8, height, width, 3) + bytes([1, f << 4 | f, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"\xff\xd8" + seg(0xDB, bytes([0]) + bytes([1] * 64)) + seg(0xC0, head) + seg(0xC4, b"\x00" + table) + seg(0xC4, b"\x10" + table) + (seg(0xDD, struct.pack(">H", every)) if every else b"") + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + out + b"\xff\xd9"


@pytest.mark.parametrize(("half", "every"), [(False, 0), (True, 0), (False, 2), (True, 1)])
def test_jpeg(half, every):
    y, x = np.mgrid[0:37, 0:50]
    image = np.dstack([x * 5, y * 6, 255 - x * 3 - y]).clip(0, 255).astype(np.uint8)
    (back,) = decoders.frames_of(jpeg(image, half, every))
    assert back.shape == (37, 50, 4) and np.abs(back[..., :3].astype(int) - image).max() <= (9 if half else 2) and (back[..., 3] == 255).all()


def test_damaged_files_are_value_errors():
    whole = [images.encode_png(made(1)[0]), images.encode_apng(made(2), 5, True), images.encode_gif(made(2), np.zeros((3, 3), np.uint8), 5, True), jpeg(np.full((9, 9, 3), 80, np.uint8))]
    for content in whole:
        decoders.frames_of(content)
        for cut in range(0, len(content) - 12, max(1, len(content) // 40)):
            try:
                decoders.frames_of(content[:cut])
            except ValueError:
                pass
        for _ in range(30):
            bad = bytearray(content)
            bad[RNG.integers(8, len(bad))] ^= 1 << RNG.integers(0, 8)
            try:
                decoders.frames_of(bytes(bad))
            except ValueError:
                pass
    for content in (b"", b"GIF", b"\xff\xd8\xff", images._SIGNATURE, b"BM" + bytes(60), b"RIFFxxxxWEBP"):
        with pytest.raises(ValueError):
            decoders.frames_of(content)


def test_animations_and_thumbnails_as_tables(spark):
    frames = made(3, 40, 300)
    rows = [("a.png", images.encode_apng(frames, 8, True), "image/png"), ("b.png", images.encode_png(frames[0][:20, :20].copy()), "image/png"), ("c.webp", b"RIFF", "image/webp")]
    files = spark.createDataFrame([(p, bytearray(c), m) for p, c, m in rows], "path string, content binary, media string")
    got = {(r.path, r.frame): r for r in images.animations(files).collect()}
    assert len(got) == 5 and got["c.webp", None].error and bytes(got["a.png", 2].pix) == frames[2].tobytes()
    urls = images.thumbnail_urls(files, 200).withColumn("content", images.data_url_bytes(F.col("url"))).collect()
    small = {r.path: bytes(r.content) for r in urls}
    assert decoders.frames_of(small["a.png"])[0].shape == (26, 200, 4) and small["b.png"] == rows[1][1] and small["c.webp"] == b"RIFF"
