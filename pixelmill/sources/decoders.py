"""Decoders of image files: PNG of all depths and its animations, GIF, BMP and baseline JPEG. Each takes the bytes of one file and gives its frames.

A frame is rows x columns x RGBA. What a file does not hold whole, or a form that is not covered, is a ``ValueError``.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

PNG, GIF, BMP, JPEG = b"\x89PNG\r\n\x1a\n", b"GIF8", b"BM", b"\xff\xd8\xff"
#: Pixels of a frame, and of all frames of a file together, that are decoded.
MOST_PIXELS, MOST_IN_ALL = 1 << 28, 1 << 30
# First column, first row, column step and row step of the seven passes of an interlaced PNG.
_PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def frames_of(content: bytes) -> list[np.ndarray]:
    """The frames of a file of any of the known kinds; one for a still image."""
    for sign, decode in ((PNG, _png), (GIF, _gif), (BMP, _bmp), (JPEG, _jpeg)):
        if content.startswith(sign):
            try:
                return decode(content)
            except (IndexError, KeyError, struct.error, zlib.error) as problem:
                raise ValueError(f"damaged file: {problem!r}") from problem
    raise ValueError("no known image")


def _sized(width: int, height: int, frames: int = 1) -> None:
    if not (width and height) or width * height > MOST_PIXELS or width * height * frames > MOST_IN_ALL:
        raise ValueError(f"size {width} x {height}")


# --- PNG


def unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A line without its filter; only the two that depend on the pixel before in a way that is no sum go byte by byte."""
    if kind == 0:
        return line
    if kind == 1:
        return (np.pad(line, (0, -len(line) % step)).reshape(-1, step).cumsum(axis=0) & 255).reshape(-1)[: len(line)]
    if kind == 2:
        return (line + above) & 255
    if kind > 4:
        raise ValueError(f"filter {kind}")
    out, before = [], above.tolist()
    for i, value in enumerate(line.tolist()):
        left = out[i - step] if i >= step else 0
        up = before[i]
        if kind == 3:
            guess = (left + up) >> 1
        else:
            corner = before[i - step] if i >= step else 0
            a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            guess = left if a <= b and a <= c else up if b <= c else corner
        out.append((value + guess) & 255)
    return np.array(out, dtype=np.int64)


def _samples(raw: bytes, at: int, width: int, height: int, channels: int, depth: int) -> tuple[np.ndarray, int]:
    """Rows x columns x channels of one pass, and where the next one begins."""
    size = (width * channels * depth + 7) // 8
    step = max(1, channels * depth // 8)
    above, lines = np.zeros(size, dtype=np.int64), np.zeros((height, size), dtype=np.uint8)
    block = np.frombuffer(raw, np.uint8, height * (size + 1), at).reshape(height, size + 1)
    for y in range(height):
        above = unfiltered(int(block[y, 0]), block[y, 1:].astype(np.int64), above, step)
        lines[y] = above
    if depth == 8:
        values = lines
    elif depth == 16:
        values = lines.reshape(height, -1, 2)[..., 0]
    else:
        shifts = np.arange(8 - depth, -1, -depth)
        values = (lines[:, :, None] >> shifts & ((1 << depth) - 1)).reshape(height, -1)
    return values[:, : width * channels].reshape(height, width, channels).astype(np.uint8), at + height * (size + 1)


class _Head:
    def __init__(self, part: bytes):
        self.width, self.height, self.depth, self.colour, _, _, self.interlaced = struct.unpack(">IIBBBBB", part)
        _sized(self.width, self.height)
        if self.colour not in (0, 2, 3, 4, 6) or self.depth not in {0: (1, 2, 4, 8, 16), 3: (1, 2, 4, 8)}.get(self.colour, (8, 16)):
            raise ValueError(f"colour {self.colour} of {self.depth} bits")
        self.channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[self.colour]
        self.palette, self.clear = np.zeros((0, 3), np.uint8), b""

    def image(self, body: bytes, width: int, height: int) -> np.ndarray:
        packer = zlib.decompressobj()
        raw = packer.decompress(body, (width * self.channels * self.depth // 8 + 2) * height * 2 + (1 << 16))
        out, at = np.zeros((height, width, self.channels), dtype=np.uint8), 0
        for x, y, dx, dy in _PASSES if self.interlaced else [(0, 0, 1, 1)]:
            w, h = -(-(width - x) // dx), -(-(height - y) // dy)
            if w > 0 and h > 0:
                if len(raw) < at + h * ((w * self.channels * self.depth + 7) // 8 + 1):
                    raise ValueError("pixels are missing")
                out[y::dy, x::dx], at = _samples(raw, at, w, h, self.channels, self.depth)
        return self._coloured(out)

    def _coloured(self, raw: np.ndarray) -> np.ndarray:
        if self.colour == 3:
            if raw.max(initial=0) >= len(self.palette):
                raise ValueError("a place beyond the palette")
            alpha = np.full(len(self.palette), 255, np.uint8)
            alpha[: len(self.clear)] = np.frombuffer(self.clear, np.uint8)[: len(alpha)]
            return np.dstack([self.palette[raw[..., 0]], alpha[raw[..., 0]]])
        alpha = raw[..., -1] if self.colour in (4, 6) else np.full(raw.shape[:2], 255, np.uint8)
        if self.clear and self.colour in (0, 2) and self.depth <= 8:  # one colour is clear; of 16 bits a byte is not enough to tell
            key = np.frombuffer(self.clear, ">u2")
            alpha = np.where((raw == key).all(axis=2), 0, alpha).astype(np.uint8)
        if self.depth < 8:
            raw = raw * (255 // ((1 << self.depth) - 1))
        return np.dstack([raw[..., :1].repeat(3, axis=2) if self.channels < 3 else raw[..., :3], alpha])


def _png(content: bytes) -> list[np.ndarray]:
    at, head, body, frames, parts, ended = 8, None, b"", None, [], False
    while at + 8 <= len(content) and not ended:
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        part = content[at + 8 : at + 8 + size]
        if zlib.crc32(kind + part) != struct.unpack(">I", content[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk's checksum differs")
        at += 12 + size
        if kind == b"IHDR":
            head = _Head(part)
        elif kind == b"PLTE":
            head.palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            head.clear = part
        elif kind == b"acTL":
            frames = struct.unpack(">II", part)[0]
            _sized(head.width, head.height, frames)
        elif kind == b"fcTL":
            parts.append([struct.unpack(">IIIIHHBB", part[4:26]), b""])
        elif kind == b"IDAT":
            body += part
            if parts:
                parts[0][1] += part  # the still image is the first frame
        elif kind == b"fdAT":
            parts[-1][1] += part[4:]
        ended = kind == b"IEND"
    if head is None or not body:
        raise ValueError("no picture")
    if not frames or not parts:
        return [head.image(body, head.width, head.height)]
    canvas, out = np.zeros((head.height, head.width, 4), np.uint8), []
    for (w, h, x, y, _, _, dispose, blend), data in parts:
        if x + w > head.width or y + h > head.height:
            raise ValueError("a frame leaves its canvas")
        before, image = canvas.copy(), head.image(data, w, h)
        canvas[y : y + h, x : x + w] = _over(image, canvas[y : y + h, x : x + w]) if blend else image
        out.append(canvas.copy())
        if dispose == 1:
            canvas[y : y + h, x : x + w] = 0
        elif dispose == 2:
            canvas = before
    return out


def _over(image: np.ndarray, ground: np.ndarray) -> np.ndarray:
    a, b = image[..., 3:].astype(np.float64) / 255, ground[..., 3:].astype(np.float64) / 255
    alpha = a + b * (1 - a)
    rgb = np.divide(image[..., :3] * a + ground[..., :3] * b * (1 - a), alpha, out=np.zeros(image.shape[:2] + (3,)), where=alpha > 0)
    return np.floor(np.concatenate([rgb, alpha * 255], axis=2) + 0.5).astype(np.uint8)


# --- GIF


def unpacked(data: bytes, bits: int, n: int) -> np.ndarray:
    """Places of a picture of ``n`` pixels from variable-width codes."""
    clear, end = 1 << bits, (1 << bits) + 1
    table: list[bytes] = []
    size, held, buffer, before, out, length = bits + 1, 0, 0, None, [], 0
    for byte in data:
        buffer |= byte << held
        held += 8
        while held >= size:
            code, buffer, held = buffer & ((1 << size) - 1), buffer >> size, held - size
            if code == clear:
                table, size, before = [bytes([i]) for i in range(clear)] + [b"", b""], bits + 1, None
                continue
            if code == end or not table:
                if not table:
                    raise ValueError("no table of codes")
                return _places(out, n)
            if before is None:
                entry = table[code]
            else:
                if code > len(table):
                    raise ValueError("an unknown code")
                entry = table[code] if code < len(table) else before + before[:1]
                if len(table) < 4096:
                    table.append(before + entry[:1])
                    if len(table) == 1 << size and size < 12:
                        size += 1
            out.append(entry)
            length += len(entry)
            if length > n + 4096:
                raise ValueError("more pixels than the picture has")
            before = entry
    return _places(out, n)


def _places(out: list[bytes], n: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(out), np.uint8)
    if len(flat) < n:
        raise ValueError("pixels are missing")
    return flat[:n]


def _gif(content: bytes) -> list[np.ndarray]:
    width, height, flags, _, _ = struct.unpack("<HHBBB", content[6:13])
    _sized(width, height)
    at, shared = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared, at = np.frombuffer(content, np.uint8, n * 3, at).reshape(n, 3), at + n * 3

    def blocks() -> bytes:
        nonlocal at
        out = bytearray()
        while content[at]:
            out += content[at + 1 : at + 1 + content[at]]
            at += 1 + content[at]
        at += 1
        return bytes(out)

    canvas, frames, dispose, clear = np.zeros((height, width, 4), np.uint8), [], 0, None
    while content[at] != 0x3B:
        kind = content[at]
        at += 1
        if kind == 0x21:
            label = content[at]
            at += 1
            part = blocks()
            if label == 0xF9:
                dispose, clear = part[0] >> 2 & 7, part[3] if part[0] & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        x, y, w, h, own = struct.unpack("<HHHHB", content[at : at + 9])
        _sized(w, h)
        _sized(width, height, len(frames) + 1)
        if x + w > width or y + h > height:
            raise ValueError("a frame leaves its canvas")
        at += 9
        colours = shared
        if own & 0x80:
            n = 2 << (own & 7)
            colours, at = np.frombuffer(content, np.uint8, n * 3, at).reshape(n, 3), at + n * 3
        bits = content[at]
        at += 1
        place = unpacked(blocks(), bits, w * h).reshape(h, w)
        if own & 0x40:  # rows come in four passes
            place = place[np.argsort(np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))]))]
        if colours is None or place.max() >= len(colours):
            raise ValueError("a place beyond the palette")
        before, seen = canvas.copy(), np.ones((h, w), bool) if clear is None else place != clear
        canvas[y : y + h, x : x + w][seen] = np.dstack([colours[place], np.full((h, w), 255, np.uint8)])[seen]
        frames.append(canvas.copy())
        if dispose == 2:
            canvas[y : y + h, x : x + w] = 0
        elif dispose == 3:
            canvas = before
        dispose, clear = 0, None
    if not frames:
        raise ValueError("no picture")
    return frames


# --- BMP


def _bmp(content: bytes) -> list[np.ndarray]:
    first, size, width, height, _, bits, packed = struct.unpack("<I I i i H H I", content[10:34])
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32) or width <= 0:
        raise ValueError(f"a BMP of {bits} bits, packed by {packed}")
    down, height = height < 0, abs(height)
    _sized(width, height)
    line = (width * bits + 31) // 32 * 4
    rows = np.frombuffer(content, np.uint8, line * height, first).reshape(height, line)
    if bits <= 8:
        count = struct.unpack("<I", content[46:50])[0] or 1 << bits
        palette = np.frombuffer(content, np.uint8, count * 4, 14 + size).reshape(count, 4)[:, 2::-1]
        place = (rows[:, :, None] >> np.arange(8 - bits, -1, -bits) & ((1 << bits) - 1)).reshape(height, -1)[:, :width]
        rgb, alpha = palette[place], np.full((height, width), 255, np.uint8)
    else:
        pixel = rows[:, : width * bits // 8].reshape(height, width, bits // 8)
        rgb, alpha = pixel[..., 2::-1], np.full((height, width), 255, np.uint8)
        if bits == 32 and pixel[..., 3].any():
            alpha = pixel[..., 3]
    image = np.dstack([rgb, alpha])
    return [image if down else image[::-1].copy()]


# --- JPEG


def _zigzag() -> np.ndarray:
    """The place by rows of each coefficient in the order in which they are stored: diagonal by diagonal, back and forth."""
    return np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


class _Bits:
    """The bits of a scan, whose stuffed zero bytes are gone already."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data + b"\0" * 8, "big"), 8 * len(data) + 64
        self.data, self.at, self.held, self.buffer = data, 0, 0, 0

    def fill(self) -> None:
        part = self.data[self.at : self.at + 4].ljust(4, b"\xff")
        if self.at > len(self.data) + 64:
            raise ValueError("the scan ends early")
        self.at += 4
        self.buffer = (self.buffer & ((1 << self.held) - 1)) << 32 | int.from_bytes(part, "big")
        self.held += 32

    def take(self, n: int) -> int:
        if self.held < n:
            self.fill()
        self.held -= n
        return self.buffer >> self.held & ((1 << n) - 1)

    def symbol(self, table: list) -> int:
        if self.held < 16:
            self.fill()
        found = table[self.buffer >> (self.held - 16) & 0xFFFF]
        if found is None:
            raise ValueError("an unknown code")
        self.held -= found[0]
        return found[1]

    def signed(self, n: int) -> int:
        value = self.take(n) if n else 0
        return value if n == 0 or value >> (n - 1) else value - (1 << n) + 1


def _codes(part: bytes) -> tuple[list, int]:
    """(code length, symbol) for every 16 bits that may come, of one table; and the table's bytes."""
    counts, symbols, table, code, k = part[:16], part[16:], [None] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            first = code << (16 - length)
            table[first : first + (1 << (16 - length))] = [(length, symbols[k])] * (1 << (16 - length))
            code, k = code + 1, k + 1
        code <<= 1
    return table, 16 + k


def _jpeg(content: bytes) -> list[np.ndarray]:
    quant, tables, parts, every, at, size = {}, {}, [], 0, 2, None
    while True:
        while content[at] == 0xFF and content[at + 1] == 0xFF:
            at += 1
        mark, length = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
        part = content[at + 4 : at + 2 + length]
        at += 2 + length
        if mark == 0xDB:
            while part:
                wide = part[0] >> 4
                quant[part[0] & 15] = np.frombuffer(part[1:], ">u2" if wide else "u1", 64).astype(np.float64)
                part = part[1 + 64 * (1 + wide) :]
        elif mark == 0xC4:
            while part:
                table, n = _codes(part[1:])
                tables[part[0]], part = table, part[1 + n :]
        elif mark in (0xC0, 0xC1):
            bits, height, width, n = struct.unpack(">BHHB", part[:6])
            _sized(width, height)
            if bits != 8 or n not in (1, 3):
                raise ValueError("a JPEG of other than 8 bits or of 4 colours")
            size, parts = (width, height), [(part[6 + 3 * k], part[7 + 3 * k] >> 4, part[7 + 3 * k] & 15, part[8 + 3 * k]) for k in range(n)]
        elif 0xC2 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
            raise ValueError("only baseline JPEG")
        elif mark == 0xDD:
            every = struct.unpack(">H", part[:2])[0]
        elif mark == 0xDA:
            if size is None or part[0] != len(parts):
                raise ValueError("only scans of all colours together")
            chosen = {part[1 + 2 * k]: part[2 + 2 * k] for k in range(part[0])}
            return [_scan(content[at:], size, [(h, v, quant[q], tables[chosen[c] >> 4], tables[16 | chosen[c] & 15]) for c, h, v, q in parts], every)]


def _scan(data: bytes, size: tuple[int, int], parts: list, every: int) -> np.ndarray:
    width, height = size
    if len(parts) == 1:
        parts = [(1, 1, *parts[0][2:])]
    wide, high = max(p[0] for p in parts), max(p[1] for p in parts)
    across, down = -(-width // (8 * wide)), -(-height // (8 * high))
    # restart marks part the scan; a stuffed zero follows a byte of ones
    pieces, start, i = [], 0, data.find(b"\xff")
    while i >= 0:
        follow = data[i + 1] if i + 1 < len(data) else 0xD9
        if 0xD0 <= follow <= 0xD7:
            pieces.append(data[start:i])
            start = i + 2
        elif follow not in (0, 0xFF):
            break
        i = data.find(b"\xff", i + 1 + (follow != 0xFF))
    pieces.append(data[start : i if i >= 0 else len(data)])
    found = [np.zeros((down * v, across * h, 64), dtype=np.float64) for h, v, *_ in parts]
    zigzag = _zigzag().tolist()
    units, piece = across * down, 0
    for first in range(0, units, every or units):
        bits, last = _Bits(pieces[piece].replace(b"\xff\x00", b"\xff")), [0] * len(parts)
        piece += 1
        for unit in range(first, min(units, first + (every or units))):
            row, column = divmod(unit, across)
            for k, (h, v, _, dc, ac) in enumerate(parts):
                for b in range(h * v):
                    block = found[k][row * v + b // h, column * h + b % h]
                    last[k] += bits.signed(bits.symbol(dc))
                    block[0] = last[k]
                    at = 1
                    while at < 64:
                        code = bits.symbol(ac)
                        if not code & 15:
                            if code != 0xF0:
                                break
                            at += 16
                            continue
                        at += code >> 4
                        block[zigzag[at]] = bits.signed(code & 15)
                        at += 1
    u = np.arange(8)
    basis = np.where(u[:, None] == 0, 8**-0.5, 0.5 * np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16))
    planes = []
    for (h, v, q, *_), blocks in zip(parts, found, strict=True):
        table = np.zeros(64)
        table[zigzag] = q
        square = np.einsum("ux,rcuv,vy->rxcy", basis, (blocks * table).reshape(*blocks.shape[:2], 8, 8), basis, optimize=True)
        plane = np.clip(square.reshape(blocks.shape[0] * 8, -1) + 128, 0, 255)
        planes.append(plane.repeat(high // v, axis=0).repeat(wide // h, axis=1)[:height, :width])
    if len(planes) == 1:
        rgb = np.dstack([planes[0]] * 3)
    else:
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        rgb = np.dstack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb])
    return np.dstack([np.floor(np.clip(rgb, 0, 255) + 0.5).astype(np.uint8), np.full((height, width), 255, np.uint8)])
