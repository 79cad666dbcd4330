"""Near duplicates by ProbMinHash: weighted shingles, probability Jaccard, banding, verification.

A text's shingles (five words) are weighted by how often they stand in it. Every shingle is a Poisson
process whose rate is its weight; each arrival goes to a random register, which keeps the earliest one.
Arrivals later than the latest register's earliest change nothing, so a process ends there: the
work for a text of n shingles and m registers is about n + m ln m arrivals, not n * m. Two texts
agree in a register with the probability Jaccard similarity of their weights.

Texts with equal words form one class, named by one of its rows. Each band of a class's registers is a
bucket key. A bucket is not expanded into pairs: its members are held against one leader, its smallest id, and
what is alike is one group from then on. Where a bucket still spans several groups, those outside of its largest one
are held against a member of that, in up to ``LEADERS`` rounds, as long as a quarter of the pairs turn out to be links.
What then is left over is compared in full, but only across groups: strays with all other members, in cells of at most
``BLOCK`` by ``BLOCK``, so that one stray among a million copies costs a million comparisons, not their square. A cell's
pairs never leave it: sketches tell which members have a near pair there, incidence matrices of those give the
similarities, and of the links only those that join groups come out. So hot buckets of true copies cost a pair a
member, and no link is lost to a cap.

A pair goes to verification if its registers' agreement, estimated from sketches of a few bits a
register, is not ``DEVIATIONS`` standard deviations below what the threshold gives. Verification computes the probability Jaccard similarity of the two texts exactly.

Defined cases: a text of 1 to 4 words is one shingle; texts without a word (null, empty, signs only)
are alike if they are equal, null as empty; repeated rows are one class; ids may repeat or be null,
rows are told apart by a key of their own; empty tables give empty results; very long texts are
shingled whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import content_key, fresh, scratch, stored, text_of
from .components import components
from .words import ALNUM, LOWER, blocks, fingerprints, mix, new_key, texts_of, windows

SHINGLE = 5
THRESHOLD = 0.8
#: 40 bands of 6: a pair of similarity 0.8 shares no band with probability 5e-6, one of 0.3 shares one with 0.03.
BANDS, ROWS = 40, 6
#: Bytes of text that are signed at once: enough texts to share the cost of the arrival rounds.
SIGN_BYTES = 1 << 20
#: Bits of each register that a class's sketch keeps.
SKETCH_BITS = 4
#: A pair is verified only if its sketches differ in no more registers than a pair at the threshold does
#: with so many standard deviations: it is passed over with probability 3e-6, less than by the banding.
DEVIATIONS = 4.5
#: Rounds of leaders before cells; members of a bucket on each side of a cell.
LEADERS, BLOCK = 4, 1000
#: Class ids that may be broadcast, 50 bytes each.
SMALL = 200_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.uint64(0xC2B2AE3D27D4EB4F)


def _weights(found: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of one text's words, and their counts."""
    if not len(found):
        return found, np.zeros(0, dtype=np.int64)
    return np.unique(windows(found, min(size, len(found))), return_counts=True)


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, registers: int) -> np.ndarray:
    """ProbMinHash of many texts at once: for each text and register the element that arrived first.

    ``row``, ``element`` and ``weight`` are parallel; a text's elements are distinct.
    """
    earliest = np.full(rows * registers, np.inf)
    winner = np.zeros(rows * registers, dtype=np.uint64)
    time, at, many = np.zeros(len(element)), 0, 1
    while len(row):
        # the next arrivals of every process that still runs
        draw = mix(element[:, None] + _STEP * np.arange(at + 1, at + many + 1, dtype=np.uint64))
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        times = time[:, None] + np.cumsum(-np.log(uniform), axis=1) / weight[:, None]
        place = row[:, None] * registers + ((mix(draw ^ _SALT) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        early = np.flatnonzero(times < earliest[place])
        put, when = place.reshape(-1)[early], times.reshape(-1)[early]
        np.minimum.at(earliest, put, when)
        first = earliest[put] == when
        winner[put[first]] = element[early[first] // many]
        live = times[:, -1] < earliest.reshape(rows, registers).max(axis=1)[row]
        row, element, weight, time = row[live], element[live], weight[live], times[live, -1]
        at += many
        many = 1 if at < 3 else min(64, max(2, (1 << 18) // max(1, len(row))))
    return winner.reshape(rows, registers)


def _keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A key of 64 bits for every band of every text."""
    parts = signature.reshape(len(signature), bands, -1)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(parts.shape[2]):
        out = mix(out * _STEP + parts[:, :, i])
    return out


def _sketches(signature: np.ndarray) -> np.ndarray:
    """The low bits of every register, bit plane after bit plane, in words of 64 bits."""
    n, registers = signature.shape
    planes = []
    for bit in range(SKETCH_BITS):
        flags = np.zeros((n, -(-registers // 64) * 64), dtype=bool)
        flags[:, :registers] = (signature >> np.uint64(bit)) & np.uint64(1)
        planes.append(np.packbits(flags, axis=1).view(np.int64))
    return np.concatenate(planes, axis=1)


def _differing(a: str, b: str, registers: int) -> Column:
    """Registers in which two sketches differ."""
    words = -(-registers // 64)
    total = F.lit(0)
    for w in range(words):
        unlike = None
        for plane in range(SKETCH_BITS):
            one = F.col(a)[plane * words + w].bitwiseXOR(F.col(b)[plane * words + w])
            unlike = one if unlike is None else unlike.bitwiseOR(one)
        total = total + F.bit_count(unlike)
    return total


def _allowed(threshold: float, registers: int) -> int:
    differ = (1 - threshold) * (1 - 2.0**-SKETCH_BITS)
    return int(registers * differ + DEVIATIONS * (registers * differ * (1 - differ)) ** 0.5)


def _sign(bands: int, per_band: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            for first, last in blocks(offsets, SIGN_BYTES):
                at = offsets[first : last + 1]
                part = data[at[0] : at[-1]]
                _, _, found, counts = fingerprints(part, at - at[0], ALNUM, LOWER, key)
                n = last - first
                cuts = np.concatenate([[0], np.cumsum(counts)])
                shingles = [_weights(found[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                sizes = np.array([len(s) for s, _ in shingles])
                row = np.repeat(np.arange(n), sizes)
                signature = signatures(row, np.concatenate([s for s, _ in shingles]), np.concatenate([c for _, c in shingles]).astype(np.float64), n, bands * per_band)
                sketch = _sketches(signature)
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * sketch.shape[1]), pa.array(sketch.reshape(-1)))
                keys = _keys(signature, bands).astype(np.int64)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * bands, bands, dtype=np.int32)), pa.array(keys.reshape(-1)))
                # the class: a chain over all words in order; two chains make a collision of classes negligible
                chain = [_chain(found[a:b]) if b > a else _raw(part[o:p]) for a, b, o, p in zip(cuts[:-1], cuts[1:], at[:-1] - at[0], at[1:] - at[0], strict=True)]
                yield pa.record_batch(
                    [pa.array(range(uid, uid + n), pa.int64()), batch.column(0).slice(first, n), batch.column(2).slice(first, n), pa.array(chain, pa.binary()), pa.array(counts), keys, sketch],
                    names=["uid", "doc_id", "tkey", "words", "n_words", "keys", "sketch"],
                )
                uid += n

    return run


def _chain(found: np.ndarray) -> bytes:
    """16 bytes that stand for a sequence of words."""
    place = np.arange(1, len(found) + 1, dtype=np.uint64)
    one = mix(found + place * _STEP).sum(dtype=np.uint64)
    two = mix(mix(found ^ _SALT) + place * _SALT).sum(dtype=np.uint64)
    return np.array([one, two], dtype=np.uint64).tobytes()


def _raw(data: np.ndarray) -> bytes:
    """17 bytes that stand for a text without words."""
    return b"-" + hashlib.blake2b(data.tobytes(), digest_size=16).digest()


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two weighted sets (sorted elements, weights), exactly.

    The sum over common d of 1 / sum over e of max(x_e / x_d, y_e / y_d). With equal weights it is the
    Jaccard similarity. Sorting by x / y turns the inner sum into two running sums.
    """
    if not len(a[0]) or not len(b[0]):
        return 0.0
    every = np.union1d(a[0], b[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])] = a[1]
    y[np.searchsorted(every, b[0])] = b[1]
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y = x[order], y[order]
    above = np.cumsum(x[::-1])[::-1]  # of elements with a ratio at least this one's
    below = np.cumsum(y) - y
    common = (x > 0) & (y > 0)
    return float((1.0 / (above[common] / x[common] + below[common] / y[common])).sum())


def _weighted(column: pa.Array, key: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The weighted shingles of a column of texts; they meet under one ``key`` only."""
    data, offsets = texts_of(column)
    out = []
    for first, last in blocks(offsets):
        at = offsets[first : last + 1]
        _, _, found, counts = fingerprints(data[at[0] : at[-1]], at - at[0], ALNUM, LOWER, key)
        cuts = np.concatenate([[0], np.cumsum(counts)])
        out += [_weights(found[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def _verify(threshold: float, key: int):
    """Pairs at the threshold or over it; the rows of one left text come together and its shingles are weighed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 400) for whole in batches for at in range(0, whole.num_rows, 400)):
            ids = batch.column(0).to_numpy()
            new = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1 if len(ids) else 0))
            left, right = _weighted(batch.column(2).take(pa.array(new)), key), _weighted(batch.column(3), key)
            of = np.searchsorted(new, np.arange(len(ids)), "right") - 1
            alike = np.array([similarity(left[k], b) for k, b in zip(of.tolist(), right, strict=True)])
            keep = pa.array(np.flatnonzero(alike >= threshold))
            yield pa.record_batch([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(alike, pa.float64()).take(keep)], names=["src", "dst", "similarity"])

    return run


def sign(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, per_band: int = ROWS, keep=stored) -> DataFrame:
    """Every row with a key of its own, what names its text, its words' class and its band keys, written to the shared folder."""
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).cast("string").alias("text"), content_key(text_col).alias("tkey"))
    return keep(rows.mapInArrow(_sign(bands, per_band, new_key()), "uid bigint, doc_id bigint, tkey binary, words binary, n_words bigint, keys array<bigint>, sketch array<bigint>"), "signatures")


def _cards(texts: DataFrame) -> DataFrame:
    """The weighted shingles of classes: id, elements (sorted), weights."""
    key = new_key()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = _weighted(batch.column(1), key)
            offsets = np.concatenate([[0], np.cumsum([len(e) for e, _ in cells])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([c[k] for c in cells]).astype(np.int64) if cells else np.zeros(0, np.int64))) for k in (0, 1)]
            yield pa.record_batch([batch.column(0), *lists], names=["id", "elements", "weights"])

    return texts.select("id", "text").mapInArrow(run, "id bigint, elements array<bigint>, weights array<bigint>")


def _shared_mass(a: np.ndarray, b: np.ndarray, row: np.ndarray, flat: np.ndarray, mass: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows a by rows b the mass of the first one, and of the second, in common elements: products of incidence matrices."""
    _, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(often > 1) - 1  # an element of one member is in no intersection
    keep = often[column] > 1
    row, col, mass = row[keep], number[column[keep]], mass[keep]
    order = np.argsort(col, kind="stable")
    row, col, mass = row[order], col[order], mass[order]
    shared, other = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, 2048):
        lo, hi = np.searchsorted(col, [at, at + 2048])
        there, heavy = (np.zeros((n, min(2048, int(col[-1]) + 1 - at)), np.float32) for _ in range(2))
        there[row[lo:hi], col[lo:hi] - at] = 1
        heavy[row[lo:hi], col[lo:hi] - at] = mass[lo:hi]
        shared += heavy[a] @ there[b].T
        other += there[a] @ heavy[b].T
    return shared, other


def _crossing(ids: np.ndarray, label: np.ndarray, in_main: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of strays ``a`` with members ``b`` are of two groups; of two strays the pair counts once."""
    return (label[a][:, None] != label[b][None, :]) & (in_main[b][None, :] | (ids[a][:, None] < ids[b][None, :]))


def _close(allowed: int):
    """Of a cell the rows that have a near pair there, told by their sketches."""

    def run(table: pa.Table) -> pa.Table:
        ids, label = (table.column(c).to_numpy() for c in ("id", "label"))
        stray, in_main = (table.column(c).to_numpy(zero_copy_only=False) for c in ("stray", "in_main"))
        sketch = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
        a, b = np.flatnonzero(stray), np.flatnonzero(~stray)
        words, differ = sketch.shape[1] // SKETCH_BITS, np.zeros((len(a), len(b)), dtype=np.int32)
        for w in range(words):
            unlike = np.zeros((len(a), len(b)), dtype=np.uint64)
            for plane in range(SKETCH_BITS):
                unlike |= sketch[a, plane * words + w][:, None] ^ sketch[b, plane * words + w][None, :]
            differ += np.bitwise_count(unlike)
        near = (differ <= allowed) & _crossing(ids, label, in_main, a, b)
        rows = np.sort(np.concatenate([a[near.any(axis=1)], b[near.any(axis=0)]]))
        return table.drop_columns("sketch").take(pa.array(rows)).select(["bucket", "i", "j", "id", "label", "in_main", "stray"])

    return run


def _cell_links(threshold: float):
    """Verified links that join groups, of one cell: its strays against its other side."""

    def run(table: pa.Table) -> pa.Table:
        ids, label = (table.column(c).to_numpy() for c in ("id", "label"))
        stray, in_main = (table.column(c).to_numpy(zero_copy_only=False) for c in ("stray", "in_main"))
        elements, weights = table.column("elements").combine_chunks(), table.column("weights").combine_chunks()
        sizes = np.diff(elements.offsets.to_numpy())
        flat, mass = elements.flatten().to_numpy().view(np.uint64), weights.flatten().to_numpy().astype(np.float64)
        row = np.repeat(np.arange(len(ids)), sizes)
        total = np.bincount(row, weights=mass, minlength=len(ids))
        a, b = np.flatnonzero(stray), np.flatnonzero(~stray)
        shared, other = _shared_mass(a, b, row, flat, mass, len(ids))
        # a common element wins both races only if it comes before the other text's own elements too: with common
        # shares p and q that has probability pq / (q + (1 - q)p) at most, which is exact for equal weights
        p, q = shared / total[a][:, None], other / total[b][None, :]
        bound = p * q / np.maximum(np.maximum(q + (1 - q) * p, p + (1 - p) * q), 1e-9)
        may = (bound >= threshold - 1e-6) & _crossing(ids, label, in_main, a, b)
        even = (total == sizes)[a][:, None] & (total == sizes)[b][None, :]
        size = sizes.astype(np.float64)
        alike = np.where(may & even, shared / np.maximum(size[a][:, None] + size[b][None, :] - shared, 1.0), 0.0)
        names, group = np.unique(label, return_inverse=True)
        now, out = np.arange(len(names)), []
        of_a, of_b = group[a], group[b]

        def join(x: int, y: int, value: float) -> None:
            now[now == now[of_b[y]]] = now[of_a[x]]
            out.append((*sorted((int(ids[a[x]]), int(ids[b[y]]))), value))

        linked = alike >= threshold
        for x in np.flatnonzero(linked.any(axis=1)):  # of all links, those that join what is not joined yet
            for y in np.flatnonzero(linked[x] & (now[of_b] != now[of_a[x]])):
                if now[of_b[y]] != now[of_a[x]]:
                    join(x, y, float(alike[x, y]))
        # pairs with repeated shingles one by one, the likeliest first, as long as their groups are apart
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        left, right = np.nonzero(may & ~even & (now[of_a][:, None] != now[of_b][None, :]))
        for k in np.argsort(-bound[left, right], kind="stable"):
            x, y = int(left[k]), int(right[k])
            if now[of_b[y]] != now[of_a[x]]:
                value = similarity(*((flat[cuts[m] : cuts[m + 1]], mass[cuts[m] : cuts[m + 1]]) for m in (a[x], b[y])))
                if value >= threshold:
                    join(x, y, value)
        return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["src", "dst", "similarity"])

    return run


class _Linker:
    """The steps from classes to verified links; what they store goes at the end of the run's block."""

    def __init__(self, documents: DataFrame, reps: DataFrame, id_col: str, text_col: str, threshold: float, registers: int, keep):
        self.rows = documents.select(F.col(id_col).cast("bigint").alias("of"), content_key(text_col).alias("key"), text_of(text_col).cast("string").alias("text"))
        self.reps, self.threshold, self.keep = reps, threshold, keep
        self.differ = _differing("sketch", "other_sketch", registers)
        self.allowed = _allowed(threshold, registers)
        self.sketches = reps.select("id", "sketch")

    def near(self, pairs: DataFrame) -> DataFrame:
        """Of pairs of ids those that may reach the threshold."""
        other = self.sketches.select(F.col("id").alias("src"), F.col("sketch").alias("other_sketch"))
        return pairs.join(self.sketches.withColumnRenamed("id", "dst"), "dst").join(other, "src").where(self.differ <= self.allowed).select("src", "dst")

    def texts(self, ids: DataFrame, most: int) -> DataFrame:
        """The text of one row of each class in ``ids`` (at most ``most`` of them); a row that repeats counts once."""
        ids = ids.join(self.reps.select("id", "doc_id", "tkey"), "id")
        ids = F.broadcast(ids) if most <= SMALL else ids
        found = self.rows.join(ids, (self.rows["key"] == ids["tkey"]) & self.rows["of"].eqNullSafe(ids["doc_id"]))
        return self.keep(found.select("id", "text").dropDuplicates(["id"]), "texts")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Links (src, dst, similarity) among stored pairs."""
        n = pairs.count()
        if not n:
            return pairs.withColumn("similarity", F.lit(1.0))
        texts = self.texts(pairs.select(F.col("src").alias("id")).unionByName(pairs.select(F.col("dst").alias("id"))).distinct(), 2 * n)
        left = texts.withColumnsRenamed({"id": "src", "text": "src_text"}).join(pairs.select("src").distinct(), "src", "left_semi")
        both = pairs.join(texts.withColumnsRenamed({"id": "dst", "text": "dst_text"}), "dst").join(left, "src").select("src", "dst", "src_text", "dst_text")
        return self.keep(both.mapInArrow(_verify(self.threshold, new_key()), "src bigint, dst bigint, similarity double"), "links")

    def across(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """Links (src, dst, similarity) that join groups sharing a bucket, from all pairs between them."""
        rows = _labelled(members, labels)
        sizes = rows.groupBy("bucket", "label").agg(F.count("*").alias("n"))
        mixed = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("parts"))
        mixed = mixed.where("parts > 1").select("bucket", "main", "n", (F.col("n") - F.col("most")).alias("strays"))
        open_ = self.keep(rows.join(mixed, "bucket"), "open")

        def blocks_of(size: str) -> Column:
            return F.ceil(F.col(size) / BLOCK).cast("int")

        own = F.pmod(F.xxhash64("id"), blocks_of("n")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), blocks_of("strays")).cast("int")
        cell = ["bucket", "i", "j", "id", "label", (F.col("label") == F.col("main")).alias("in_main")]
        stray = open_.where("label <> main").withColumn("i", own[1]).withColumn("j", F.explode(F.sequence(F.lit(0), blocks_of("n") - 1))).select(*cell, F.lit(True).alias("stray"))
        every = open_.withColumn("j", own[0]).withColumn("i", F.explode(F.sequence(F.lit(0), blocks_of("strays") - 1))).select(*cell, F.lit(False).alias("stray"))
        cells = stray.unionByName(every).join(self.sketches, "id").groupBy("bucket", "i", "j")
        close = self.keep(cells.applyInArrow(_close(self.allowed), "bucket bigint, i int, j int, id bigint, label bigint, in_main boolean, stray boolean"), "close")
        n = close.count()
        if not n:
            return close.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("similarity"))
        cards = self.keep(_cards(self.texts(close.select("id").distinct(), n)), "cards")
        return self.keep(close.join(cards, "id").groupBy("bucket", "i", "j").applyInArrow(_cell_links(self.threshold), "src bigint, dst bigint, similarity double"), "links")

    def lead(self, members: DataFrame, labels: DataFrame, tried: DataFrame, turn: int) -> DataFrame:
        """(src, dst): members of buckets with several groups, outside of the largest one, beside one member of that."""
        rows = _labelled(members, labels)
        sizes = rows.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.min_by("id", F.xxhash64("id", F.lit(turn))).alias("head"))
        mains = sizes.groupBy("bucket").agg(F.max_by(F.struct("label", "head"), F.struct("n", "label")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
        pairs = rows.join(mains.select("bucket", "main"), "bucket").where("label <> main.label").select(F.least("id", "main.head").alias("src"), F.greatest("id", "main.head").alias("dst")).distinct()
        return self.keep(self.near(pairs.join(tried, ["src", "dst"], "left_anti")), "near")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _groups(links: DataFrame) -> DataFrame:
    """(id, label): ids that links join, as far as two steps to smaller ids tell; equal labels are of one component."""
    low = links.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("label"))
    return low.join(low.select(F.col("id").alias("label"), F.col("label").alias("next")), "label", "left").select("id", F.coalesce("next", "label").alias("label"))


def link(documents: DataFrame, signed: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, registers: int = BANDS * ROWS) -> tuple[DataFrame, DataFrame]:
    """(id, component) of the classes that have links, and verified links (src, dst, similarity) that hold the components together.

    A class's id is the smallest ``uid`` of its rows.
    """
    with scratch(documents.sparkSession, "link") as keep:
        reps = signed.where("n_words > 0").groupBy("words").agg(F.min("uid").alias("id"), F.min_by(F.struct("doc_id", "tkey", "keys", "sketch"), "uid").alias("rep")).select("id", "rep.*")
        reps = keep(reps, "classes")
        bands = reps.select("id", F.explode("keys").alias("bucket"))
        # the smallest id leads, so that a large group has one leader in all its buckets
        heads = bands.groupBy("bucket").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
        members = keep(bands.join(heads, "bucket"), "members")
        linker = _Linker(documents, reps, id_col, text_col, threshold, registers, keep)
        pairs = members.where("id <> head").select(F.col("head").alias("src"), F.col("id").alias("dst")).distinct()
        tried = near = keep(linker.near(pairs), "near")
        members, found = members.select("bucket", "id"), linker.verified(near)
        for turn in range(1, LEADERS):
            near = linker.lead(members, _groups(found), tried, turn)
            links = linker.verified(near)
            tried, found = tried.unionByName(near), found.unionByName(links)
            if 4 * links.count() < near.count():  # other members would not do much better: the rest is for the cells
                break
        found = stored(found.unionByName(linker.across(members, _groups(found))), "links")
        return components(found), found


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, ``class_id`` (smallest doc_id of its group), ``class_size``
    (rows in the group), ``keep`` (true for one row of each group), and the row's ``tkey`` and ``uid``."""
    signed = sign(documents, id_col, text_col)
    merged, _ = link(documents, signed, id_col, text_col)
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))
    each = signed.groupBy("words").agg(lowest.alias("low"), F.count("*").alias("n"), F.min("uid").alias("id"))
    each = each.join(merged, "id", "left").withColumn("component", F.coalesce("component", "id"))
    whole = each.groupBy("component").agg(F.min("low").alias("best"), F.sum("n").alias("class_size"))
    named = each.join(whole, "component").select("words", F.col("best.doc_id").alias("class_id"), F.col("best.uid").alias("best_uid"), "class_size")
    return signed.select("uid", "doc_id", "tkey", "words", "n_words").join(named, "words").select(
        "doc_id", "n_words", "class_id", "class_size", (F.col("uid") == F.col("best_uid")).alias("keep"), "tkey", "uid"
    )


def deduplicated(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with one row of each group of near duplicates; columns as they are.

    Kept rows are found again by id (null as any other value) and by what names the text; rows that repeat in both count once.
    """
    key, text_key = fresh(documents, "key", "text_key")
    kept = near_duplicates(documents, id_col, text_col).where("keep").select(F.col("doc_id").alias("kept_id"), F.col("tkey").alias("kept_key"))
    rows = documents.withColumn(key, F.col(id_col).cast("bigint")).withColumn(text_key, content_key(text_col))
    kept = kept.toDF(*fresh(rows, "kept_id", "kept_key"))
    same = rows[text_key].eqNullSafe(kept[kept.columns[1]]) & rows[key].eqNullSafe(kept[kept.columns[0]])
    return rows.join(kept, same, "left_semi").dropDuplicates([text_key, key]).select(*documents.columns)
