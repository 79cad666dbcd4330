"""Words of many texts at once, as 64-bit fingerprints, by array arithmetic over the UTF-8 bytes.

Two word classes are in use. ``ALNUM``: after lower-casing A-Z, runs of 0-9, a-z and everything
beyond ASCII. ``BLANK``: runs of anything but space and the controls 0x09 to 0x0D. Every UTF-8 byte
of a character beyond ASCII is 0x80 or more, so both classes can be told byte by byte.

Fingerprints that decide results are keyed: the driver draws a key for each run and hands it to the tasks, so whoever
writes texts cannot know which words would meet. What is left is chance, 5e-20 for a pair of words.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is worked on alone.
BLOCK_BYTES = 1 << 19

#: Words up to so many bytes are hashed eight bytes at a time, all words at once; longer ones one by one by BLAKE2.
SHORT_BYTES = 64

_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_code = np.arange(256)
ALNUM = (_code >= 0x80) | ((_code >= 0x30) & (_code <= 0x39)) | ((_code >= 0x41) & (_code <= 0x5A)) | ((_code >= 0x61) & (_code <= 0x7A))
BLANK = ~((_code == 0x20) | ((_code >= 0x09) & (_code <= 0x0D)))
SAME = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit integers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is the empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a row over it is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def new_key() -> int:
    """A key for one run; tasks whose fingerprints meet must share it."""
    return secrets.randbits(64)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int) -> np.ndarray:
    """64 bits for each of the byte ranges, of the length and every eight bytes.

    Two lanes of 64 bits take in the same bytes in different ways, each step is mixed with parts of the key, and
    both lanes meet only at the end: eight bytes that make one lane equal leave the other one apart, and without the
    key neither can be computed.
    """
    size = ends - starts
    one, two, three = mix(np.uint64(key) + _STEP * np.arange(1, 4, dtype=np.uint64))
    a = mix(size.astype(np.uint64) * _STEP ^ one)
    b = mix(size.astype(np.uint64) + two)
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    live = np.flatnonzero(size <= SHORT_BYTES)
    at = 0
    while len(live):
        left = size[live] - at
        block = eight[starts[live] + at] & _KEEP[np.minimum(left, 8)]
        a[live] = mix((a[live] ^ block) + one)
        b[live] = mix((b[live] + (block ^ three)) * _ODD ^ two)
        at += 8
        live = live[left > 8]
    out = mix(a ^ (b << np.uint64(32) | b >> np.uint64(32)))
    secret = int(three).to_bytes(8, "little")
    for i in np.flatnonzero(size > SHORT_BYTES):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, key=secret).digest(), "little")
    return out


def fingerprints(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, fold: np.ndarray, key: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start byte, end byte, fingerprint of each word, and each row's number of words.

    ``kind`` says which bytes are of a word, ``fold`` maps bytes before they are hashed; words meet under one ``key`` only.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64), np.zeros(len(offsets) - 1, dtype=np.int64)
    inside = kind[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    finishes = inside
    finishes[:-1] &= ~kind[data[1:]] | cut[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    found = _hashes(fold[data], starts, ends, key)
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, found, counts


def windows(prints: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of every run of ``size`` consecutive words (order counts)."""
    n = len(prints) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = (out ^ (out >> np.uint64(32))) * _ODD + prints[i : i + n]
    return mix(out)
