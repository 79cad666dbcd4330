"""Benchmark decontamination by a distributed positional inverted index.

The corpus is indexed by parts ("segments") of some MB of whole texts. A segment holds its terms'
fingerprints, sorted, and for each of them the ascending list of the places where it stands; a place
counts words through the segment, and ``doc_starts`` tells which text a place is of. Segments are rows
of a table in the shared folder, so postings are never shuffled and the hottest term is cut into as
many lists as there are segments. A search orders each window's terms by their lists' lengths in the segment and
intersects them from the rarest, each moved by its term's offset, all windows at once, until nothing or the places of
the phrases remain. With ``slop`` a term may stand that many words away from its place (proximity).

Benchmarks are cut into blocks of whole items by a running sum of lengths, at most ``BLOCK_CHARS`` characters each (one
longer item is a block of its own). Every block is broadcast apart, and a task takes them one after the other while it
holds a segment: the index is read once, whatever the number of blocks, and texts are not shuffled.

Defined cases: null text is a text without words (no window, never hit) and as an item no item; an item with a
null id hits words as any other, but is not counted or named in ``items``; items that share an id count once;
repeated rows and repeated or null document ids are kept apart, each row gives one result row; empty tables give
empty results or no hits; other columns are neither read nor kept, so their names cannot clash; texts of any length
stay whole. Words are told apart by fingerprints under a key that the index draws and keeps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import content_key, fresh, scratch, stored
from .words import ALNUM, LOWER, blocks, fingerprints, new_key, texts_of

WINDOW = 13
SEGMENT_BYTES = 8 << 20
BLOCK_CHARS = 4_000_000
#: Places that are held against lists at once.
PLACES = 1 << 20
#: Contaminated texts' keys that may be broadcast, 32 bytes each.
SMALL = 100_000

_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _segment(number: int, key: int, ids: list[pa.Array], counts: list[np.ndarray], prints: list[np.ndarray]) -> pa.RecordBatch:
    found = np.concatenate(prints)
    starts = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
    order = np.argsort(found, kind="stable")
    ordered = found[order]
    new = np.ones(len(ordered), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    firsts = np.append(np.flatnonzero(new), len(ordered)).astype(np.int32)
    cells = [starts, ordered[firsts[:-1]], firsts, order.astype(np.int32)]
    keys = pa.concat_arrays(ids)
    keys = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
    return pa.record_batch([pa.array([number], pa.int64()), pa.array([key], pa.int64()), keys, *(pa.array([x.tobytes()], pa.binary()) for x in cells)], names=["segment", "key", "doc_ids", "doc_starts", "terms", "firsts", "positions"])


def _index(key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        ids, counts, prints, size, rows = [], [], [], 0, 0
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            for first, last in blocks(offsets):
                at = offsets[first : last + 1]
                _, _, found, many = fingerprints(data[at[0] : at[-1]], at - at[0], ALNUM, LOWER, key)
                ids.append(batch.column(0).slice(first, last - first))
                counts.append(many)
                prints.append(found)
                size += int(at[-1] - at[0])
                rows += last - first
                if size >= SEGMENT_BYTES or rows >= 100_000:
                    yield _segment(number, key, ids, counts, prints)
                    number += 1
                    ids, counts, prints, size, rows = [], [], [], 0, 0
        if ids:
            yield _segment(number, key, ids, counts, prints)

    return run


def build_index(documents: DataFrame, id_col: str | Column = "doc_id", text_col: str = "text", keep=stored) -> DataFrame:
    """The postings of all words of all texts, written to the shared folder: one row a segment.

    ``segment`` numbers them by task and place in the task, ``key`` is what words were hashed with. Ids may be of any type.
    """
    key = F.col(id_col).cast("bigint") if isinstance(id_col, str) else id_col
    rows = documents.select(key.alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return keep(rows.mapInArrow(_index(new_key() >> 1), f"segment bigint, key bigint, doc_ids array<{kind}>, doc_starts binary, terms binary, firsts binary, positions binary"), "postings")


class Query:
    """A block of items: its words as numbers of distinct terms."""

    def __init__(self, items: pa.Table, size: int, key: int):
        prints, lengths = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in items.to_batches():
            data, offsets = texts_of(batch.column(1))
            _, _, found, counts = fingerprints(data, offsets, ALNUM, LOWER, key)
            prints.append(found)
            lengths.append(counts)
        self.size = size
        self.ids = items.column(0).to_pylist()
        self.lengths = np.concatenate(lengths)
        self.terms, numbers = np.unique(np.concatenate(prints), return_inverse=True)
        self.words = numbers.astype(np.int32)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each window the item (its place in the block), the first word and the number of words."""
        cut = np.cumsum(self.lengths) - self.lengths
        n = np.minimum(self.lengths, self.size)
        many = np.where(self.lengths > 0, self.lengths - n + 1, 0)
        item = np.repeat(np.arange(len(many)), many)
        return item, cut[item] + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many), n[item]


class Postings:
    """A segment's lists as one ascending array: a term's number times ``span``, plus the place."""

    def __init__(self, have: np.ndarray, firsts: np.ndarray, positions: np.ndarray, slop: int, window: int):
        self.have, self.firsts, self.positions, self.slop = have, firsts.astype(np.int64), positions.astype(np.int64), slop
        self.span = len(positions) + 2 * (slop + window) + 2  # a place moved by an offset stays among its term's
        self.keys = np.repeat(np.arange(len(have), dtype=np.int64) * self.span, np.diff(self.firsts)) + self.positions

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """The numbers that terms have here; -1 where there is none."""
        if not len(self.have):
            return np.full(len(terms), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.have, terms), len(self.have) - 1)
        return np.where(self.have[at] == terms, at, -1)

    def near(self, number: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which places have the term of that number, at most ``slop`` away."""
        wanted = number * self.span + place
        at = np.searchsorted(self.keys, wanted - self.slop)
        found = at < len(self.keys)
        found[found] = self.keys[at[found]] <= wanted[found] + self.slop
        return found


def _phrases(lists: Postings, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) wherever the terms of a row of ``numbers`` stand in their order."""
    many = lists.firsts[numbers + 1] - lists.firsts[numbers]
    order = np.argsort(many, axis=1, kind="stable")  # from the rarest
    least = np.take_along_axis(many, order[:, :1], axis=1)[:, 0]
    rows, places = [], []
    ends = np.cumsum(least)
    first = 0
    while first < len(numbers):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PLACES, "right")))
        row = np.repeat(np.arange(first, last), least[first:last])
        head = numbers[np.arange(first, last), order[first:last, 0]]
        own = np.arange(len(row)) - np.repeat(np.cumsum(least[first:last]) - least[first:last], least[first:last])
        place = lists.positions[np.repeat(lists.firsts[head], least[first:last]) + own] - order[row, 0]
        for k in range(1, numbers.shape[1]):
            offset = order[row, k]
            keep = lists.near(numbers[row, offset], place + offset)
            row, place = row[keep], place[keep]
            if not len(row):
                break
        rows.append(row)
        places.append(place)
        first = last
    return np.concatenate(rows), np.concatenate(places)


def _occurrences(query: Query, windows: tuple, lists: Postings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, first place, words) of every occurrence of the block's windows in one segment."""
    item, start, length = windows
    numbers = lists.numbers(query.terms)[query.words]
    running = np.concatenate([[0], np.cumsum(numbers >= 0)])
    may = running[start + length] - running[start] == length
    out = [(np.zeros(0, dtype=np.int64),) * 3]
    for n in np.unique(length[may]):
        which = np.flatnonzero(may & (length == n))
        row, place = _phrases(lists, numbers[start[which][:, None] + np.arange(n)])
        out.append((item[which[row]], place, np.full(len(row), n)))
    return tuple(np.concatenate([x[k] for x in out]) for k in range(3))


def _runs(mask: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Of each text the runs of set words, in the text's own places."""
    n = len(mask)
    edge = np.zeros(n + 1, dtype=bool)
    edge[starts] = True
    first = mask.copy()
    first[1:] &= ~mask[:-1] | edge[1:n]
    last = mask.copy()
    last[:-1] &= ~mask[1:] | edge[1:n]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    cuts = np.searchsorted(begin, starts)
    base = starts[np.searchsorted(starts, begin, "right") - 1]
    cells = pa.StructArray.from_arrays([pa.array((begin - base).astype(np.int32)), pa.array((end - base).astype(np.int32))], fields=list(_SPANS.value_type))
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), cells)


def _search(shared: list, window: int, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(2)[i].values
                starts, have, firsts, positions = (np.frombuffer(batch.column(k)[i].as_py(), kind) for k, kind in zip(range(3, 7), (np.int32, np.uint64, np.int32, np.int32), strict=True))
                n, total = len(ids), int(starts[-1])
                lists = Postings(have, firsts, positions, slop, window)
                change, named = np.zeros(total + 1, dtype=np.int64), [set() for _ in range(n)]
                for block in shared:
                    query: Query = block.value
                    item, place, length = _occurrences(query, query.windows(), lists)
                    inside = (place >= 0) & (place + length <= total)
                    item, place, length = item[inside], place[inside], length[inside]
                    doc = np.searchsorted(starts, place, "right") - 1
                    whole = place + length <= starts[doc + 1]
                    item, place, length, doc = item[whole], place[whole], length[whole], doc[whole]
                    change += np.bincount(place, minlength=total + 1) - np.bincount(place + length, minlength=total + 1)
                    for d, k in np.unique(np.stack([doc, item], axis=1), axis=0).tolist():
                        if query.ids[k] is not None:
                            named[d].add(query.ids[k])
                    if len(shared) > 1:
                        block.__dict__.pop("_value", None)  # one block at a time in the worker's memory
                cells = [ids, pa.array(np.diff(starts).astype(np.int64)), _runs(np.cumsum(change[:-1]) > 0, starts), pa.array([sorted(x) for x in named], pa.list_(pa.int64()))]
                yield pa.record_batch(cells, names=["doc_id", "n_words", "spans", "items"])

    return run


def _cut(most: int):
    """Items with the block that each belongs to: a running sum of lengths, by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            numbers = []
            for n in batch.column(2).to_pylist():
                if held and held + n > most:
                    block, held = block + 1, 0
                held += n
                numbers.append(block)
            yield pa.record_batch([*batch.columns, pa.array(numbers, pa.int64())], names=["item", "text", "chars", "block"])

    return run


def search(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, slop: int = 0, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per indexed text: doc_id, n_words, hit ``spans`` (word places, end exclusive) and ``items``."""
    spark = index.sparkSession
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    head = index.select("key").first()  # all segments of an index have the same
    wanted = items.select(F.col(id_col).cast("bigint").alias("item"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").withColumn("chars", F.length("text").cast("bigint"))
    with scratch(spark, "items") as keep:
        cut = keep(wanted.mapInArrow(_cut(block_chars), "item bigint, text string, chars bigint, block bigint"), "cut")
        passes, held = [[]], 0
        for row in cut.groupBy("block").agg(F.sum("chars").alias("n")).orderBy("block").collect():  # a row a block, not an item
            if held and held + row["n"] > block_chars:
                passes.append([])
                held = 0
            held += row["n"]
            passes[-1].append(row["block"])
        # each at most ``block_chars`` of text; the driver holds one at a time
        shared = [spark.sparkContext.broadcast(Query(cut.where(F.col("block").isin(some)).select("item", "text").toArrow(), window, head["key"] if head else 0)) for some in passes]
    return index.mapInArrow(_search(shared, window, slop), f"doc_id {kind}, n_words bigint, spans array<struct<first:int,last:int>>, items array<bigint>")


def judge(found: DataFrame) -> DataFrame:
    """Counts and the verdict: a text is contaminated if 1 in 20 of its words, and one at least, is hit."""
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    out = found.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["last"] - s["first"])).withColumn("n_items", F.size("items").cast("bigint"))
    return out.withColumn("items_sha256", F.sha2(F.concat_ws(",", names), 256)).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns for every row of ``documents``."""
    found = search(build_index(documents), benchmark)
    return judge(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items")


def clean(documents: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``documents`` without the contaminated ones; columns as they are.

    The verdict depends on the text alone, so it is looked up by what names the text.
    """
    (key,) = fresh(documents, "key")
    with scratch(documents.sparkSession, "clean") as keep:
        index = build_index(documents, content_key(text_col), text_col, keep)
        bad = stored(judge(search(index, benchmark)).where("contaminated").select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    keyed = documents.withColumn(key, content_key(text_col))
    return keyed.join(F.broadcast(bad) if bad.count() <= SMALL else bad, key, "left_anti").select(*documents.columns)
