"""Repeated substrings by relative Lempel-Ziv parsing: passages of ``WINDOW`` words or more that stand earlier in the corpus.

The reference is the corpus itself. Parsing every text against every block of it in turn would cost the square of the
corpus, so reference blocks are dealt by content. Of each window of words the run of ``GRAM`` words
with the least fingerprint (the leftmost of equal ones) is its anchor: equal windows have equal anchors at equal places, wherever
they stand. Neighbouring windows share anchors, about seven each, and make a strip: the words that its windows cover.
Strips are the symbols of the parse, and the block that an anchor's hash names holds all strips that could match one.

1. Index: for each anchor the least document, and whether all of its strips are the same words.
2. Parse: each strip of a text is looked up. If the anchor's strips are all the same words, a later one is copied whole
   from the least document. Copied strips that meet and have one source join greedily into factors as long as they go.
3. Factor boundaries: a factor ends inside a strip, whose anchor then has several contexts. There, and only there,
   the windows are compared one by one, each with the least document that has it.

Every covered window gives at least ``WINDOW`` words, so that each factor is long enough to be a duplicate span; no window that
stands earlier is missed, whatever the number of its copies. Shuffled are a row a strip (twice), the windows of boundaries, and
texts on their own key. A hot passage is one row a map task in the index, and its strips' join is split by AQE: both of its
sides are plain tables.

Defined cases: null text is a text without words (nothing removed, hash of the empty text); texts with fewer words than a window
are left whole; texts are read whole, whatever their length; a document is a row: rows that share an id do not come before each other, within
a row earlier places do; a null id comes before all others; repeated rows give equal results; empty tables give empty results; other columns are neither read nor kept
(``deduplicated`` passes them through, helper columns get names that the table does not have). Words are told apart by keyed fingerprints: two of 64
bits must meet by chance for two windows to be mixed up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, scratch, stored
from .words import BLANK, SAME, blocks, fingerprints, mix, new_key, texts_of, windows

WINDOW = 20
#: Words of an anchor. Longer ones are rarer, shorter ones make fewer strips.
GRAM = 6

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least value in every run of ``width`` values, the leftmost of equal ones."""
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        if len(values) <= step:
            return at[:0]
        right = values[step:] < values[:-step]
        at, values = np.where(right, at[step:], at[:-step]), np.where(right, values[step:], values[:-step])
        span += step
    return at


def _strips(prints: np.ndarray, counts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of every strip: its row, first word (in the row), number of windows, anchor and context; and the windows' fingerprints."""
    cuts = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(counts)), counts)
    whole = windows(prints, window)
    live = np.flatnonzero(row[: len(whole)] == row[window - 1 :]) if len(whole) else np.zeros(0, dtype=np.int64)
    if not len(live):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), whole
    grams = windows(prints, gram)
    anchor = _leftmost_least(grams, window - gram + 1)[live]
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    many = np.diff(np.append(new, len(live)))
    first, place = live[new], anchor[new]
    # a strip has fewer windows than a window has words, so that its first and last one hold all of its words
    shape = (place - first).astype(np.uint64) * np.uint64(256) + many.astype(np.uint64)
    context = mix(mix(whole[first] + shape * _STEP) * _STEP + whole[first + many - 1])
    return row[first], first - cuts[row[first]], many, grams[place], context, whole


def _again(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which of a block's keys stand earlier in their row; rows come in order."""
    order = np.lexsort((np.arange(len(keys)), keys, row))
    same = (keys[order][1:] == keys[order][:-1]) & (row[order][1:] == row[order][:-1])
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    return out


def _of_blocks(column: pa.Array, key: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, tuple]]:
    """(first row, last row, bytes, offsets, fingerprints) of blocks of whole texts."""
    data, offsets = texts_of(column)
    for first, last in blocks(offsets):
        at = offsets[first : last + 1]
        part = data[at[0] : at[-1]]
        yield first, last, part, at - at[0], fingerprints(part, at - at[0], BLANK, SAME, key)


def _emit_strips(key: int, window: int, gram: int, places: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, doc = (batch.column(k).to_numpy() for k in (0, 1))
            for first, _, _, _, (_, _, prints, counts) in _of_blocks(batch.column(2), key):
                row, start, many, anchor, context, _ = _strips(prints, counts, window, gram)
                again = _again(anchor, row)
                if places:
                    place = start << 9 | many << 1 | again
                    cells, names = [anchor.view(np.int64), uid[first + row], doc[first + row], place], ["anchor", "uid", "doc", "place"]
                else:
                    cells, names = [anchor.view(np.int64), context.view(np.int64), doc[first + row]], ["anchor", "context", "doc"]
                yield pa.record_batch([pa.array(x) for x in cells], names=names)

    return run


def _emit_windows(key: int, window: int, gram: int):
    """The windows of the strips that ``asks`` names, with whether they stand earlier in the same text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, doc = (batch.column(k).to_numpy() for k in (0, 1))
            asks, asked = batch.column(3).flatten().to_numpy(), np.diff(batch.column(3).offsets.to_numpy())
            ends = np.cumsum(asked)
            for first, last, _, _, (_, _, prints, counts) in _of_blocks(batch.column(2), key):
                row, start, many, anchor, _, whole = _strips(prints, counts, window, gram)
                cuts = np.concatenate([[0], np.cumsum(counts)])
                mine = asks[ends[first] - asked[first] : ends[last - 1]]
                wanted = np.repeat(cuts[:-1], asked[first:last]) + (mine >> 9)
                at = np.searchsorted(cuts[row] + start, wanted)  # strips come in order of their first word
                n = many[at]
                strip = np.repeat(at, n)
                own = start[strip] + np.arange(len(strip)) - np.repeat(np.cumsum(n) - n, n)
                of = row[strip]
                order = np.lexsort((own, of))
                strip, own, of = strip[order], own[order], of[order]
                prints_of = whole[cuts[of] + own]
                again = _again(prints_of, of)
                cells = [anchor[strip].view(np.int64), prints_of.view(np.int64), uid[first + of], doc[first + of], own << 9 | 2 | again]
                yield pa.record_batch([pa.array(x) for x in cells], names=["anchor", "print", "uid", "doc", "place"])

    return run


def _keyed(documents: DataFrame, id_col: str, text_col: str, keep) -> DataFrame:
    """uid (different for every row), doc (what rows are ordered by; null before all others) and text."""
    rows = documents.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63))).alias("doc"), F.col(text_col).cast("string").alias("text"))
    if rows.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return rows.select(F.col("doc").alias("uid"), "doc", "text")
    return keep(rows.select(F.monotonically_increasing_id().alias("uid"), "doc", "text"), "rows")


def _later() -> F.Column:
    return (F.col("doc") > F.col("least")) | ((F.col("place") % 2) == 1)


def pieces(rows: DataFrame, keep, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(uid, place, source) of everything copied: strips that stand earlier as a whole, and single windows at factor boundaries.

    ``place`` is the first word times 512 plus twice the number of windows; ``source`` is the least document that has it.
    """
    if not 2 <= gram < window <= 200:
        raise ValueError("an anchor has at least two words and fewer than a window, a window at most 200")
    key = new_key()
    strips = rows.mapInArrow(_emit_strips(key, window, gram, False), "anchor bigint, context bigint, doc bigint")
    index = strips.groupBy("anchor").agg(F.min("doc").alias("least"), F.count("*").alias("n"), (F.min("context") != F.max("context")).alias("open"))
    index = keep(index.where("n > 1").drop("n"), "index")
    # the same strips once more, with their places, beside what the index says of their anchors
    placed = rows.mapInArrow(_emit_strips(key, window, gram, True), "anchor bigint, uid bigint, doc bigint, place bigint")
    parsed = keep(placed.join(index, "anchor").where(F.col("open") | _later()).select("uid", "place", F.when(~F.col("open"), F.col("least")).alias("source"), "open"), "parsed")
    asks = parsed.where("open").groupBy("uid").agg(F.sort_array(F.collect_list("place")).alias("asks"))
    edges = rows.join(asks, "uid").select("uid", "doc", "text", "asks")
    edges = keep(edges.mapInArrow(_emit_windows(key, window, gram), "anchor bigint, print bigint, uid bigint, doc bigint, place bigint"), "edges")
    known = keep(edges.groupBy("anchor", "print").agg(F.min("doc").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "known")
    found = edges.join(known, ["anchor", "print"]).where(_later()).select("uid", "place", F.col("least").alias("source"))
    return parsed.where("NOT open").select("uid", "place", "source").unionByName(found)


def _factors(place: np.ndarray, source: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(first word, end, source): pieces of one text that meet and have one source, joined greedily; by first word."""
    order = np.lexsort((-(place & 511), place >> 9))
    first, source = (place >> 9)[order], source[order]
    end = first + ((place & 511) >> 1)[order] + window - 1
    out: list[tuple[int, int, int]] = []
    for a, b, s in zip(first.tolist(), end.tolist(), source.tolist(), strict=True):
        if out and out[-1][2] == s and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), s)
        elif not out or b > out[-1][1]:
            out.append((a, b, s))
    return out


_FACTOR = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("source", pa.int64())])
_SCHEMA = "uid bigint, doc bigint, n_words bigint, n_removed bigint, kept_sha256 string, factors array<struct<first:bigint,last:bigint,source:bigint>>, kept string"


def _kept_bytes(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, kept: np.ndarray) -> Iterator[bytes]:
    """Of each text its kept words, joined by one space."""
    n, a, b, of = len(data), starts[kept], ends[kept], row[kept]
    edge = np.zeros(n + 2, dtype=np.int64)
    after = np.minimum(b + 1, offsets[of + 1])  # the byte behind a word becomes the space
    np.add.at(edge, a, 1)
    np.add.at(edge, after, -1)
    out = data.copy()
    out[b[b < offsets[of + 1]]] = 0x20
    inside = np.cumsum(edge[:n]) > 0
    packed = out[inside].tobytes()
    cuts = np.concatenate([[0], np.cumsum(inside)])[offsets]
    last = np.searchsorted(of, np.arange(len(offsets) - 1), "right") - 1
    for r in range(len(offsets) - 1):
        have = last[r] >= 0 and of[last[r]] == r
        spare = int(have and b[last[r]] < offsets[r + 1])  # the space behind the last word
        yield packed[cuts[r] : cuts[r + 1] - spare]


def _remove(window: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, sources = (batch.column(k).flatten().to_numpy() for k in (3, 4))
            many = np.diff(batch.column(3).offsets.to_numpy())
            many[~np.asarray(batch.column(3).is_valid())] = 0
            ends_of = np.cumsum(many)
            for first, last, data, offsets, (starts, ends, _, counts) in _of_blocks(batch.column(2), 0):
                cuts = np.concatenate([[0], np.cumsum(counts)])
                row = np.repeat(np.arange(last - first), counts)
                edge, factors = np.zeros(len(starts) + 1, dtype=np.int64), []
                for r in range(last - first):
                    hi = ends_of[first + r]
                    lo = hi - many[first + r]
                    factors.append(_factors(places[lo:hi], sources[lo:hi], window) if hi > lo else [])
                    for a, b, _ in factors[-1]:
                        edge[cuts[r] + a] += 1
                        edge[cuts[r] + b] -= 1
                kept = np.cumsum(edge[:-1]) == 0
                whole = list(_kept_bytes(data, offsets, starts, ends, row, kept)) if len(data) else [b""] * (last - first)
                removed = counts - np.bincount(row[kept], minlength=last - first)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), pa.array(counts), pa.array(removed), pa.array([hashlib.sha256(x).hexdigest() for x in whole]),
                        pa.array([[dict(zip(("first", "last", "source"), f, strict=True)) for f in x] for x in factors], pa.list_(_FACTOR)),
                        pa.array([x.decode() for x in whole] if texts else [None] * (last - first), pa.string()),
                    ],
                    names=["uid", "doc", "n_words", "n_removed", "kept_sha256", "factors", "kept"],
                )

    return run


def parse(rows: DataFrame, keep, window: int = WINDOW, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """What is left of every keyed row, and its factors (word places, end exclusive, with the least document that has the passage)."""
    copied = pieces(rows, keep, window, gram).groupBy("uid").agg(F.collect_list(F.struct("place", "source")).alias("c"))
    copied = copied.select("uid", F.col("c.place").alias("places"), F.col("c.source").alias("sources"))
    return rows.join(copied, "uid", "left").select("uid", "doc", "text", "places", "sources").mapInArrow(_remove(window, texts), _SCHEMA)


def repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and the ``factors`` that were removed."""
    with scratch(documents.sparkSession, "repeats") as keep:
        found = stored(parse(_keyed(documents, id_col, text_col, keep), keep, window), "repeats")
    return found.select(F.when(F.col("doc") > -(2**63), F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "factors")


def deduplicated(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``documents`` with repeated passages cut from the texts; a text that loses nothing stays as it is, null texts stay null."""
    (key,) = fresh(documents, "key")
    kept_id, kept_text, lost = fresh(documents.withColumn(key, F.lit(0)), "kept_id", "kept_text", "lost")
    with scratch(documents.sparkSession, "deduplicated") as keep:
        rows = stored(documents.withColumn(key, F.monotonically_increasing_id()), "rows")
        keyed = rows.select(F.col(key).alias("uid"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63))).alias("doc"), F.col(text_col).cast("string").alias("text"))
        found = stored(parse(keyed, keep, window, texts=True).where("n_removed > 0"), "kept")
    found = found.select(F.col("uid").alias(kept_id), F.col("kept").alias(kept_text), F.lit(True).alias(lost))
    out = rows.join(found, rows[key] == found[kept_id], "left")
    return out.withColumn(text_col, F.when(F.col(lost), F.col(kept_text)).otherwise(F.col(text_col))).select(*documents.columns)
