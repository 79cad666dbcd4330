"""SentencePiece encoding and decoding by streaming Viterbi.

The trellis has a state for every boundary between characters; an arc is a piece. Only boundaries at
most a longest piece behind the newest one can still be left by an arc, so back-pointers are kept for
that window alone. As soon as the paths of all boundaries in the window run through one common
boundary, the ids up to it are committed and forgotten: what is held does not grow with the text (``Window``,
which advances many texts at once, a lane each, by array arithmetic).

Two objectives share the trellis. ``unigram``: the path with the largest sum of scores. ``bpe``, for
models that were trained by merging, where the largest sum is *not* the library's answer: a path is
admitted if every two neighbouring pieces are what merging would make of their characters; exactly one
path to each boundary is, and it is the library's segmentation. Whether two pieces may stand side by
side is found by undoing the merges of the two, and remembered for some ``PAIRS`` pairs.

A boundary between two characters that stand side by side in no piece is crossed by no arc, so there all paths
converge, whatever comes before or after. ``encode`` cuts blocks of text there and gives each different stretch of a
block a lane of its own; equal stretches have equal ids. A text of over ``BLOCK_BYTES`` goes through ``stream`` block by block.

Defined cases: null text has no ids, as the empty text; characters of no piece become their UTF-8
bytes' pieces, or the unknown id in models without byte pieces; a literal U+2581 is encoded as a space
and decodes to one (``round_trip`` then compares with that); texts are never cut; repeated rows and
extra columns are passed on; the new columns' names are the caller's. A model whose rules are others (a normaliser,
another treatment of white space, pieces defined by its user) is refused: see ``vocabulary``.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import blocks, mix, texts_of

#: Where this box keeps a public model, unless the environment names another; give a path for other models.
MODEL = os.environ.get("PIECES_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
#: Pairs of pieces that are remembered.
PAIRS = 1 << 19
#: Bytes of text that are encoded at once; lanes that advance together; characters that a lane reads at once.
BLOCK_BYTES, LANES, READ = 4 << 20, 16384, 64
#: The boundary before a text, one that no path reaches.
START, NONE = -2, -1
_PROBES = ["", " ", "  a  b ", "a\tb\r\nc\n", "ﬁ①Ⅷ ＡＢ é Å ﾊﾟ", "x▁y", " 　​\x00", "Hello, WORLD! 12.5% 日本語 😀"]


def vocabulary(path: str = MODEL) -> dict:
    """Pieces, scores and kinds of a model, read on the driver; some 10,000s of short strings.

    The library encodes some probes and every piece's own characters; a model for which that differs from what
    the trellis gives is refused with a ValueError.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    kinds = ["byte" if model.is_byte(i) else "special" if model.is_control(i) or model.is_unknown(i) else "unused" if model.is_unused(i) else "piece" for i in ids]
    words = {"pieces": [model.id_to_piece(i) for i in ids], "scores": [model.get_score(i) for i in ids], "kinds": kinds, "unknown": model.unk_id()}
    probes = _PROBES + [p.replace(MARK, " ") for p, kind in zip(words["pieces"], kinds, strict=True) if kind != "byte"]
    asked = [ids.tolist() for ids in Trellis(words).encode_all(pa.array(probes))]
    wrong = [p for p, mine, theirs in zip(probes, asked, model.encode(probes), strict=True) if mine != theirs]
    if wrong:
        raise ValueError(f"{path}: the model's own rules give other ids for {len(wrong)} of {len(probes)} probes, such as {wrong[0]!r}")
    return words


class Table:
    """Numbers by 64-bit keys, many at a time: open addressing over arrays."""

    def __init__(self, bits: int):
        self.bits, self.n = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray, default: int = -1) -> np.ndarray:
        slot = self._slots(keys)
        held = self.keys[slot]
        out = self.values[slot]
        missed = np.flatnonzero(held != keys)
        out[missed] = default
        open_ = missed[held[missed] != -1]
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds different keys that are not in the table."""
        slot = self._slots(keys)
        open_ = np.arange(len(keys))
        while len(open_):
            free = open_[self.keys[slot[open_]] == -1]
            self.keys[slot[free]] = keys[free]  # of several for one slot the last stays
            won = self.keys[slot[open_]] == keys[open_]
            self.values[slot[open_[won]]] = values[open_[won]]
            open_ = open_[~won]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        self.n += len(keys)


def _last_merge(piece: str, score: dict[str, float]) -> tuple[str, str] | None:
    """The two parts that merging joins last to make a piece; None if merging its characters makes something else."""
    parts, found = list(piece), None
    while len(parts) > 1:
        scored = [(-score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in score]
        if not scored:
            return None
        at = min(scored)[1]
        found = (parts[at], parts[at + 1])
        parts[at : at + 2] = ["".join(found)]
    return found


class Trellis:
    """Encoder and decoder over one vocabulary; ``objective`` is "bpe" or "unigram"."""

    def __init__(self, words: dict, objective: str = "bpe"):
        n = len(words["pieces"])
        self.unigram = objective == "unigram"
        self.unknown, self.bytewise = words["unknown"], "byte" in words["kinds"]
        self.bytes = np.full(256, self.unknown, dtype=np.int32)
        surfaces, self.id = [], {}
        for i, (piece, kind) in enumerate(zip(words["pieces"], words["kinds"], strict=True)):
            if kind == "byte":
                self.bytes[int(piece[3:5], 16)] = i
                surfaces.append(bytes([int(piece[3:5], 16)]))
            elif kind == "special":
                surfaces.append(" ⁇ ".encode() if i == self.unknown else b"")
            else:
                surfaces.append(piece.replace(MARK, " ").encode())
                if kind == "piece":
                    self.id[piece] = i
        self.surface_at = np.concatenate([[0], np.cumsum([len(s) for s in surfaces])])
        self.surface = np.frombuffer(b"".join(surfaces), np.uint8)
        self.score = np.array([*words["scores"], 0.0])
        self.strings = {p: float(words["scores"][i]) for p, i in self.id.items()}
        self.floor = min(self.strings.values(), default=0.0) - 10.0
        self.score[n] = self.floor
        self.other = n  # stands for any character without a piece
        # what merging joins last; pieces that it never makes are left out
        self.split = np.full((n + 1, 2), -1, dtype=np.int32)
        if not self.unigram:
            for piece in [p for p in self.id if len(p) > 1]:
                found = _last_merge(piece, self.strings)
                if found is None or any(p not in self.id for p in found if len(p) > 1):
                    del self.id[piece]
                else:
                    self.split[self.id[piece]] = [self.id.get(p, self.other) for p in found]
        self.length = np.ones(n + 1, dtype=np.int32)
        for piece, i in self.id.items():
            self.length[i] = len(piece)
        self.longest = max(map(len, self.id), default=1)
        marks = np.zeros(n + 1, dtype=bool)
        marks[[i for p, i in self.id.items() if MARK + MARK in p]] = True
        self.marks = marks
        self.lone_mark = self.id.get(MARK, self.other)
        self._index()
        self.pairs: Table | None = None  # made where it is used, so that it does not travel

    def _index(self) -> None:
        """The pieces as a tree over characters, the joins of two pieces, and the characters that stand side by side."""
        alphabet = sorted({c for p in self.id for c in p})
        self.letter = np.zeros(0x110000, dtype=np.int16)
        self.letter[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.beside = np.zeros((len(alphabet) + 1, len(alphabet) + 1), dtype=bool)
        number = {c: i + 1 for i, c in enumerate(alphabet)}
        nodes, edges, ends = 1, {}, {}
        self.first = np.full(len(alphabet) + 1, NONE, dtype=np.int32)  # the tree's nodes of single characters
        for piece, i in self.id.items():
            at = 0
            for a, b in zip(piece, piece[1:], strict=False):
                self.beside[number[a], number[b]] = True
            for c in piece:
                key = at * 0x8000 + number[c]
                if key not in edges:
                    edges[key] = nodes
                    nodes += 1
                at = edges[key]
            ends[at] = i
        for key, node in edges.items():
            if key < 0x8000:
                self.first[key] = node
        self.tree = Table(max(4, (4 * len(edges) + 1).bit_length()))
        self.tree.put(np.fromiter(edges, np.int64, len(edges)), np.fromiter(edges.values(), np.int32, len(edges)))
        self.ends = np.full(nodes, NONE, dtype=np.int32)
        self.ends[list(ends)] = list(ends.values())
        self.base = self.other + 1
        joins = {}
        for piece, i in self.id.items():
            for k in range(1, len(piece)):
                a, b = self.id.get(piece[:k]), self.id.get(piece[k:])
                if a is not None and b is not None:
                    joins[a * self.base + b] = i
        self.joins = Table(max(4, (4 * len(joins) + 1).bit_length()))
        self.joins.put(np.fromiter(joins, np.int64, len(joins)), np.fromiter(joins.values(), np.int32, len(joins)))

    def _merging_keeps(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the characters of two pieces gives the two pieces.

        Merges are undone from the latest back; the pieces do not fit if at some moment the parts that
        touch could have been joined before the merge that came next. Of equal scores the left one comes first.
        """
        left, right = left.copy(), right.copy()
        fits = np.ones(len(left), dtype=bool)
        until, first = np.full(len(left), -np.inf), np.zeros(len(left), dtype=bool)
        live = np.arange(len(left))
        while len(live):
            a, b = left[live], right[live]
            joined = self.joins.get(a.astype(np.int64) * self.base + b)
            across = np.where(joined >= 0, self.score[joined], -np.inf)
            bad = (joined >= 0) & ((across > until[live]) | (first[live] & (across == until[live])))
            fits[live[bad]] = False
            made_a, made_b = (np.where(self.split[x, 0] >= 0, self.score[x], np.inf) for x in (a, b))
            more = ~bad & (np.isfinite(made_a) | np.isfinite(made_b))
            live, a, b, made_a, made_b = live[more], a[more], b[more], made_a[more], made_b[more]
            of_left = made_a < made_b
            until[live], first[live] = np.where(of_left, made_a, made_b), ~of_left
            left[live[of_left]] = self.split[a[of_left], 1]
            right[live[~of_left]] = self.split[b[~of_left], 0]
        return fits

    def _marks_keep(self, left: int, right: int) -> bool:
        """The same where runs of marks, which share one score, are in play: by merging."""
        names = {i: p for p, i in self.id.items()} if not hasattr(self, "names") else self.names
        self.names = names
        parts = list(names[left] + names[right])
        while len(parts) > 1:
            scored = [(-self.strings[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.strings]
            if not scored:
                break
            at = min(scored)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts == [names[left], names[right]]

    def side_by_side(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two pieces may stand beside each other on an admitted path (the start and unknown characters always may)."""
        keys = left.astype(np.int64) * self.base + right
        if self.pairs is None:
            self.pairs = Table(21)
        out = self.pairs.get(keys)
        out[(left < 0) | (left == self.other) | (right == self.other)] = 1
        new = np.flatnonzero(out < 0)
        if len(new):
            keys, first = np.unique(keys[new], return_index=True)
            a, b = left[new[first]].astype(np.int32), right[new[first]].astype(np.int32)
            found = self._merging_keeps(a, b)
            for k in np.flatnonzero(self.marks[a] | self.marks[b] | ((a == self.lone_mark) & (b == self.lone_mark))):
                found[k] = self._marks_keep(int(a[k]), int(b[k]))
            if self.pairs.n + len(keys) > PAIRS:
                self.pairs = Table(21)
            self.pairs.put(keys[:PAIRS], found[:PAIRS].astype(np.int32))
            out[new] = found[np.searchsorted(keys, left[new].astype(np.int64) * self.base + right[new])]
        return out > 0

    def codes(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The characters of texts, marks put in, and the offsets of texts."""
        data, offsets = texts_of(column)
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        starts = heads[offsets]
        filled = np.diff(starts) > 0
        codes = np.insert(codes, starts[:-1][filled], ord(" "))
        codes[codes == ord(" ")] = ord(MARK)
        return codes, starts + np.concatenate([[0], np.cumsum(filled)])

    def _coded(self, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the stretches between the places ``at``, and where each one's begin; a stretch that comes again is looked up."""
        cells = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * 4), pa.py_buffer(np.ascontiguousarray(codes))])
        named = cells.dictionary_encode()
        each = named.dictionary
        offsets = np.frombuffer(each.buffers()[1], np.int64)[each.offset : each.offset + len(each) + 1] // 4
        flat, begin = self._lanes(np.frombuffer(each.buffers()[2], np.uint32), offsets)
        which = named.indices.to_numpy()
        size = np.diff(begin)[which]
        ends = np.concatenate([[0], np.cumsum(size)])
        return flat[np.repeat(begin[which] - ends[:-1], size) + np.arange(ends[-1])], ends

    def encode_all(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string column."""
        ids, cuts = self.encode(column)
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts and where each text's begin, as the model's library gives them."""
        codes, starts = self.codes(column)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
        letter = self.letter[codes]
        cut = np.ones(len(codes) + 1, dtype=bool)
        cut[1:-1] = ~self.beside[letter[:-1], letter[1:]]
        cut[starts] = True
        at = np.flatnonzero(cut)
        ids, ends = self._coded(codes, at)
        return ids, ends[np.searchsorted(at, starts)]

    def _lanes(self, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many stretches, and where each one's begin. Lanes of like length advance together."""
        size = np.diff(offsets)
        order = np.argsort(size, kind="stable")
        steps = []
        for at in range(0, len(order), LANES):
            lanes = order[at : at + LANES]
            window, read, live = Window(self, len(lanes)), offsets[lanes].copy(), np.arange(len(lanes))
            while len(live):
                n = np.minimum(offsets[lanes[live] + 1] - read[live], READ)
                place = read[live][:, None] + np.arange(n.max())
                window.push(np.where(np.arange(n.max()) < n[:, None], codes[np.minimum(place, len(codes) - 1)], 0), n)
                read[live] += n
                done = read[live] == offsets[lanes[live] + 1]
                row, where, piece, char = window.commit(done)
                steps.append((lanes[live[row]], where, piece, char))
                window.keep(~done)
                live = live[~done]
        lane, where, piece, char = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.lexsort((where, lane))
        return self._ids(lane[order], piece[order], char[order], len(size))

    def _ids(self, lane: np.ndarray, piece: np.ndarray, char: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of committed pieces: those of no piece become their character's bytes."""
        without = piece == self.other
        if not self.bytewise:
            ids = np.where(without, self.unknown, piece).astype(np.int32)
            return ids, np.concatenate([[0], np.cumsum(np.bincount(lane, minlength=lanes))])
        code = char.astype(np.int64)
        width = np.where(without, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 1)
        ends = np.cumsum(width)
        ids = np.repeat(piece, width).astype(np.int32)
        for w in range(1, 5):
            some = np.flatnonzero(without & (width == w))
            for k in range(w):
                rest = code[some] >> 6 * (w - 1 - k)
                lead = (0, 0, 0xC0, 0xE0, 0xF0)[w] if k == 0 else 0x80
                ids[ends[some] - w + k] = self.bytes[(rest & 0x3F if k else rest) | lead]
        return ids, np.concatenate([[0], np.cumsum(np.bincount(lane, weights=width, minlength=lanes))]).astype(np.int64)

    def stream(self, chunks: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of one text that comes in chunks, committed as early as paths converge.

        The stretch that a chunk leaves open stays in a window of its own; ``held`` is how many characters that window has.
        """
        window, before, self.held = None, 0, 0
        for chunk in filter(None, chunks):
            line = (" " + chunk if before == 0 else chunk).replace(" ", MARK)
            codes = np.frombuffer(line.encode("utf-32-le"), np.uint32)
            letter = self.letter[codes]
            at = np.concatenate([[0], np.flatnonzero(~self.beside[letter[:-1], letter[1:]]) + 1, [len(codes)]])
            if window is not None:
                if self.beside[self.letter[before], letter[0]]:
                    yield from self._advance(window, codes[: at[1]])
                    at = at[1:]
                if len(at) > 1:
                    yield self._finish(window)
                    window = None
            if len(at) > 2:
                yield self._coded(codes, at[:-1])[0]
            if len(at) > 1:
                window = Window(self, 1)
                yield from self._advance(window, codes[at[-2] :])
            before, self.held = codes[-1], int(window.size[0])
        if window is not None:
            yield self._finish(window)

    def _advance(self, window: Window, codes: np.ndarray) -> Iterator[np.ndarray]:
        for first in range(0, len(codes), READ):
            part = codes[first : first + READ]
            window.push(part[None, :], np.array([len(part)]))
            row, _, piece, char = window.commit(np.zeros(1, dtype=bool))
            yield self._ids(row, piece[::-1], char[::-1], 1)[0]

    def _finish(self, window: Window) -> np.ndarray:
        row, _, piece, char = window.commit(np.ones(1, dtype=bool))
        return self._ids(row, piece[::-1], char[::-1], 1)[0]

    def encode_long(self, data: np.ndarray, check: bool = True) -> tuple[np.ndarray, bool]:
        """Ids of one long text, a block at a time, and whether they decode to it."""
        edges = [0]
        while edges[-1] < len(data):
            at = min(edges[-1] + BLOCK_BYTES, len(data))
            while at < len(data) and data[at] & 0xC0 == 0x80:
                at -= 1
            edges.append(at)
        want, out, ok, at = data.tobytes().replace(MARK.encode(), b" ") if check else b"", [np.zeros(0, np.int32)], True, -1
        for ids in self.stream(data[a:b].tobytes().decode("utf-8") for a, b in zip(edges[:-1], edges[1:], strict=True)):
            out.append(ids)
            if check:
                got = self.decode_bytes(ids, np.array([0, len(ids)]), False)[0].tobytes()
                ok &= got == (b" " + want[: len(got) - 1] if at < 0 and got else want[at : at + len(got)])
                at += len(got)
        return np.concatenate(out), ok and (not check or max(at, 0) == len(want))

    def decode_bytes(self, ids: np.ndarray, cuts: np.ndarray, begun: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that many texts' ids stand for, and where each text's begin; if these are their first ids, the leading space is taken off."""
        size = np.diff(self.surface_at)[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.surface[np.repeat(self.surface_at[ids] - ends[:-1], size) + np.arange(ends[-1])]
        at = ends[cuts]
        if not begun:
            return data, at
        lead = at[:-1][(np.diff(at) > 0) & (np.append(data, 0)[at[:-1]] == 0x20)]
        keep = np.ones(len(data), dtype=bool)
        keep[lead] = False
        return data[keep], np.concatenate([[0], np.cumsum(keep)])[at]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the leading space that encoding adds is taken off."""
        return self.decode_bytes(np.asarray(ids, dtype=np.int64), np.array([0, len(ids)]))[0].tobytes().decode("utf-8", "replace")

    def decodes(self, column: pa.Array, ids: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Which texts their ids decode to (a mark in a text counts as a space)."""
        data, offsets = texts_of(column)
        got, at = self.decode_bytes(ids, cuts)
        if len(got) == len(data) and (at == offsets).all():
            wrong = np.concatenate([[0], np.cumsum(got != data)])
            ok = np.diff(wrong[offsets]) == 0
        else:
            ok = np.zeros(len(offsets) - 1, dtype=bool)
        for i in np.flatnonzero(~ok):
            ok[i] = got[at[i] : at[i + 1]].tobytes() == data[offsets[i] : offsets[i + 1]].tobytes().replace(MARK.encode(), b" ")
        return ok


class Window:
    """The trellis of many texts that are read side by side: characters and back-pointers not yet committed."""

    def __init__(self, trellis: Trellis, lanes: int):
        self.t = trellis
        self.codes = np.zeros((lanes, 0), dtype=np.uint32)
        self.size = np.zeros(lanes, dtype=np.int64)
        self.passed = np.zeros(lanes, dtype=np.int64)  # characters committed so far
        self.last = np.full((lanes, 1), START, dtype=np.int32)  # at each boundary its last piece
        self.total = np.zeros((lanes, 1))

    def keep(self, rows: np.ndarray) -> None:
        self.codes, self.size, self.passed, self.last, self.total = (x[rows] for x in (self.codes, self.size, self.passed, self.last, self.total))

    def push(self, codes: np.ndarray, sizes: np.ndarray) -> None:
        """Reads characters and extends the paths to the new boundaries."""
        old, new = self.size, self.size + sizes
        lanes, width = len(old), int(new.max(initial=0))
        grown = np.zeros((lanes, width), dtype=np.uint32)
        grown[:, : min(width, self.codes.shape[1])] = self.codes[:, :width]
        row, col = np.nonzero(np.arange(codes.shape[1]) < sizes[:, None])
        grown[row, old[row] + col] = codes[row, col]
        last, total = np.full((lanes, width + 1), NONE, dtype=np.int32), np.zeros((lanes, width + 1))
        have = min(width + 1, self.last.shape[1])
        last[:, :have], total[:, :have] = self.last[:, :have], self.total[:, :have]
        last[np.arange(width + 1) > old[:, None]] = NONE
        self.codes, self.size, self.last, self.total = grown, new, last, total
        ending, pieces = self._arcs()
        for here in range(int(old.min(initial=0)) + 1, width + 1):
            rows = np.flatnonzero((old < here) & (here <= new))
            self._reach(rows, here, ending[rows, here], pieces)

    def _arcs(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """For each boundary the lengths of pieces that end there, as bits; and the pieces by length and first character."""
        t, (lanes, width) = self.t, self.codes.shape
        letter = t.letter[self.codes].astype(np.int64)
        letter[np.arange(width) >= self.size[:, None]] = -1
        ending = np.zeros((lanes, width + 1), dtype=np.int64)
        row, col = np.nonzero(letter >= 0)
        node, pieces = np.zeros(len(row), dtype=np.int64), []
        for length in range(1, t.longest + 1):
            inside = col + length <= self.size[row]
            row, col, node = row[inside], col[inside], node[inside]
            last = letter[row, col + length - 1]
            child = t.first[last] if length == 1 else t.tree.get(node * 0x8000 + last)
            found = np.full((lanes, width), NONE, dtype=np.int32)
            ends = np.where(child >= 0, t.ends[child], NONE)
            if length == 1:
                ends = np.where(ends < 0, t.other, ends)
            found[row, col] = ends
            some = ends >= 0
            ending[row[some], col[some] + length] |= 1 << (length - 1)
            pieces.append(found)
            on = child >= 0
            row, col, node = row[on], col[on], child[on].astype(np.int64)
            if not len(row):
                break
        return ending, pieces

    def _reach(self, rows: np.ndarray, here: int, lengths: np.ndarray, pieces: list[np.ndarray]) -> None:
        """The best admitted arc to a boundary, for the given lanes; the longest piece is tried first."""
        t = self.t
        best = np.full(len(rows), -np.inf)
        live = np.flatnonzero(lengths)
        stack = np.stack([p[:, here - k - 1] if here - k - 1 >= 0 else np.full(len(p), NONE, np.int32) for k, p in enumerate(pieces)])
        while len(live):
            length = np.frexp(lengths[live].astype(np.float64))[1].astype(np.int64)
            lengths[live] &= ~(np.int64(1) << (length - 1))
            lane, begin = rows[live], here - length
            piece, left = stack[length - 1, lane], self.last[lane, begin]
            open_ = left != NONE
            if t.unigram:
                gain = self.total[lane, begin] + t.score[piece]
                better = open_ & (gain > best[live])
                best[live[better]] = gain[better]
                self.last[lane[better], here], self.total[lane[better], here] = piece[better], gain[better]
                live = live[lengths[live] != 0]
            else:
                fits = open_.copy()
                fits[open_] = t.side_by_side(left[open_], piece[open_])
                self.last[lane[fits], here] = piece[fits]
                live = live[~fits & (lengths[live] != 0)]

    def _before(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the last piece of a boundary begins."""
        return at - self.t.length[self.last[rows, at]]

    def _common(self) -> np.ndarray:
        """The last boundary that the paths of all boundaries which an arc can still leave run through."""
        lanes = np.arange(len(self.size))
        tail = self.size[:, None] - np.arange(min(self.t.longest, int(self.size.max(initial=0)) + 1))
        tail = np.where((tail >= 0) & (self.last[lanes[:, None], np.maximum(tail, 0)] != NONE), tail, -1)
        least = np.where(tail >= 0, tail, np.iinfo(np.int64).max).min(axis=1)
        while True:
            top = tail.max(axis=1)
            apart = np.flatnonzero(top > least)
            if not len(apart):
                return top
            before = self._before(apart, top[apart])
            tail[apart] = np.where(tail[apart] == top[apart][:, None], before[:, None], tail[apart])
            least[apart] = np.minimum(least[apart], before)

    def commit(self, done: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(lane, place, piece, its last character) of what is certain: all of lanes that are done, else up to the common boundary."""
        at = np.where(done, self.size, self._common() if not done.all() else 0)
        cur, rows, out = at.copy(), np.flatnonzero(at > 0), []
        while len(rows):
            piece = self.last[rows, cur[rows]]
            out.append((rows, self.passed[rows] + cur[rows], piece, self.codes[rows, cur[rows] - 1]))
            cur[rows] -= self.t.length[piece]
            rows = rows[cur[rows] > 0]
        self.passed += at
        width = int((self.size - at).max(initial=0))
        lane, shifted = np.arange(len(at))[:, None], at[:, None] + np.arange(width + 1)
        inside = shifted <= self.size[:, None]
        kept = np.minimum(shifted, self.last.shape[1] - 1)
        last = np.where(inside, self.last[lane, kept], NONE)
        # a path that does not run through the committed boundary is dead; that boundary's own piece stays as left neighbour
        dead = (last >= 0) & (np.arange(width + 1) - self.t.length[last] < 0)
        dead[:, 0] = False
        last[dead] = NONE
        self.last, self.total = last, self.total[lane, kept]
        self.codes = self.codes[lane, np.minimum(shifted[:, :width], max(self.codes.shape[1] - 1, 0))] if width else np.zeros((len(at), 0), dtype=np.uint32)
        self.size = self.size - at
        none = np.zeros(0, dtype=np.int64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none.astype(np.int32), none.astype(np.uint32))


def _trellis(rows: DataFrame, model: str | dict, objective: str):
    """A trellis for all tasks: as large as the model's vocabulary, whatever the corpus."""
    return rows.sparkSession.sparkContext.broadcast(Trellis(vocabulary(model) if isinstance(model, str) else model, objective))


def with_ids(documents: DataFrame, text_col: str = "text", ids_col: str = "ids", check_col: str | None = "round_trip", model: str | dict = MODEL, objective: str = "bpe") -> DataFrame:
    """``documents`` with the ids of each text and, unless ``check_col`` is None, whether they decode to it."""
    shared = _trellis(documents, model, objective)

    @F.arrow_udf(T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ok", T.BooleanType())]))
    def encoded(text: pa.Array) -> pa.Array:
        trellis, ids, cuts, ok = shared.value, [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], [np.zeros(0, bool)]
        offsets = texts_of(text)[1]
        for first, last in blocks(offsets, BLOCK_BYTES):
            part = text.slice(first, last - first)
            if offsets[last] - offsets[first] > BLOCK_BYTES:  # one long text
                found, good = trellis.encode_long(texts_of(part)[0], bool(check_col))
                at, good = np.array([0, len(found)]), np.array([good])
            else:
                found, at = trellis.encode(part)
                good = trellis.decodes(part, found, at) if check_col else np.ones(last - first, dtype=bool)
            ok.append(good)
            ids.append(found)
            cuts.append(at[1:] + cuts[-1][-1])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(cuts).astype(np.int32)), pa.array(np.concatenate(ids), pa.int32()))
        return pa.StructArray.from_arrays([lists, pa.array(np.concatenate(ok))], names=["ids", "ok"])

    out = documents.withColumn(ids_col, encoded(F.col(text_col).cast("string")))
    if check_col:
        out = out.withColumn(check_col, F.col(ids_col)["ok"])
    return out.withColumn(ids_col, F.col(ids_col)["ids"])


def decoded(rows: DataFrame, ids_col: str = "ids", out: str = "decoded", model: str | dict = MODEL, objective: str = "bpe") -> DataFrame:
    """``rows`` with the text of their ids; null ids give null."""
    shared = _trellis(rows, model, objective)

    @F.arrow_udf(T.StringType())
    def text(ids: pa.Array) -> pa.Array:
        return pa.array([None if cell is None else shared.value.decode(np.array(cell, dtype=np.int64)) for cell in ids.to_pylist()], pa.string())

    return rows.withColumn(out, text(F.col(ids_col)))


def report(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, the ids, their number and the number of characters, and whether decoding gives the text back."""
    rows = with_ids(documents.select("doc_id", "text"), model=model)
    return rows.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"), F.size("ids").cast("bigint").alias("n_ids"), "ids", "round_trip")
