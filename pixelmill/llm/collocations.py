"""Collocations of two and three words, counted by tries of Apriori-safe candidates.

1. Candidates, level by level. Each task counts its phrases by fingerprint, Spark sums: an upper bound of a phrase's frequency (equal
   fingerprints can only add). A phrase is only counted if all shorter parts may be frequent, which tasks read off bitmaps of
   ``2 ** BITS`` bits, whatever the corpus: a bit that two phrases share lets one more be counted and never loses one.
   A phrase's fingerprint is made of that of its words but the last and the last one's in a way that can be undone, so that sums carry
   one word's fingerprint and the phrase's words are found again by joins; only single words are spelled by tasks.
2. The candidates are dealt into shards of ``SHARD`` phrases by the phrase's hash. Each shard becomes a double-array trie,
   broadcast; its size is bounded by the shard's.
3. In one pass over the texts each position is dealt to the shard of the phrase that begins there. A task takes one trie at a
   time; all positions' states advance together, level by level (language, first word, second word ...), and those that
   reach an accepting state are counted. Spark adds up the tasks' counts, which are exact.
4. Scores, cuts, the removal of parts of longer phrases and the ranks are joins and windows on candidates alone.

Frequent first words spread over all shards, and nothing is kept per phrase that may not be frequent. Ranks are cut in each task before the
shuffle. Texts are not shuffled.

Defined cases: null text is the empty text; null language is ``und``; texts are read whole; repeated rows count each; equal scores are
ordered by frequency and then phrase; a language without candidates gives no rows, nor does an empty table; other columns are not read,
so their names cannot clash. Words are told apart by keyed fingerprints of 64 bits; a chance collision of two words is not looked into.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import doublearray
from .common import scratch, stored
from .words import LOWER, blocks, fingerprints, mix, new_key, texts_of

LEAST, TOP, LONGEST = 10, 2000, 3
#: Bits of a bitmap of phrases that may be frequent, as a power of two: 16 MB.
BITS = 27
#: Phrases of a trie: some 5 MB.
SHARD = 1 << 17
#: Positions that walk through the tries together.
POSITIONS = 1 << 19
#: Counted phrases that are merged before they leave a task.
MERGED = 1 << 19
#: Bytes of text that are cut into words at once; a longer text is cut alone.
BLOCK_BYTES = 1 << 20

_code = np.arange(256)
_CUT = np.isin(_code, [ord(c) for c in ".,;:!?"]) | ((_code >= 0x0A) & (_code <= 0x0D))
_WORD = ~(_CUT | (_code == 0x20) | (_code == 0x09))
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Tokens:
    """The words of a block of texts, and its phrases of each length as fingerprints that hold the language."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, key: int):
        self.data = LOWER[data]
        self.starts, self.ends, self.prints, counts = fingerprints(data, offsets, _WORD, LOWER, key)
        self.row = np.repeat(np.arange(len(counts)), counts)
        self.lang = langs[self.row]
        piece = np.concatenate([[0], np.cumsum(_CUT[data])])[self.starts]
        self.phrases, self.whole = [mix(self.prints ^ mix(self.lang))], [np.ones(len(self.row), dtype=bool)]
        for n in range(2, LONGEST + 1):
            m = max(0, len(self.row) - n + 1)
            self.phrases.append(mix(self.phrases[-1][:m] * _STEP + self.prints[n - 1 :]))
            self.whole.append((self.row[:m] == self.row[n - 1 :]) & (piece[:m] == piece[n - 1 :]))

    def may(self, n: int, bits: list[np.ndarray]) -> np.ndarray:
        """Places of phrases of ``n`` words whose parts of n - 1 words have their bit; of all lengths in ``bits``, their own too."""
        ok = self.whole[n - 1].copy()
        m = len(ok)
        if len(bits) >= n - 1 and n > 1:
            part = _have(bits[n - 2], self.phrases[n - 2])
            ok &= part[:m] & self._behind(n, bits[n - 2])
        if len(bits) >= n:
            ok &= _have(bits[n - 1], self.phrases[n - 1])
        return np.flatnonzero(ok)

    def spelled(self, at: np.ndarray, n: int) -> pa.Array:
        """The phrases of ``n`` words at the places, their words joined by one space."""
        word = (at[:, None] + np.arange(n)).reshape(-1)
        size = self.ends[word] - self.starts[word]
        first = np.cumsum(size + 1) - size - 1
        source = np.repeat(self.starts[word] - first, size + 1) + np.arange(int(size.sum()) + len(size))
        source[first + size] = len(self.data)  # the space behind each word, but for a phrase's last one
        kept = np.ones(len(source), dtype=bool)
        kept[(first + size)[n - 1 :: n]] = False
        flat = np.append(self.data, np.uint8(0x20))[source[kept]]
        offsets = np.concatenate([[0], np.cumsum((size + 1).reshape(-1, n).sum(axis=1) - 1)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes()))

    def _behind(self, n: int, bits: np.ndarray) -> np.ndarray:
        """Whether the last n - 1 words of the phrase at each place have their bit."""
        return _have(bits, self.phrases[n - 2])[1:]


def _have(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Whether the leading bits of fingerprints name a set bit."""
    at = (prints >> np.uint64(65 - (8 * len(bits)).bit_length())).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _print(lang: str, key: int) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8, key=key.to_bytes(8, "little"), person=b"language").digest(), "little")


def _blocks(batch: pa.RecordBatch, key: int) -> Iterator[tuple[_Tokens, list[str], np.ndarray]]:
    """Blocks of a batch (lang, text): words, names of languages and each row's number among them."""
    coded = batch.column(0).dictionary_encode()
    names, number = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    prints = np.array([_print(x, key) for x in names], dtype=np.uint64)
    data, offsets = texts_of(batch.column(1))
    for first, last in blocks(offsets, BLOCK_BYTES):
        at = offsets[first : last + 1]
        own = number[first:last]
        yield _Tokens(data[at[0] : at[-1]], at - at[0], prints[own], key), names, own


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, total = [], []
        for tokens, langs, own in _blocks(batch, 0):
            many = np.bincount(own[tokens.row], minlength=len(langs))
            names += langs
            total += many.tolist()
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(total, pa.int64())], names=["lang", "n"])


def _counted(n: int, bits, key: int):
    """How often each phrase of ``n`` words that may be frequent stands in a batch, by fingerprint, with its last word's."""

    def merged(parts: list[tuple]) -> pa.RecordBatch:
        prints, lasts, totals = (np.concatenate([p[k] for p in parts]) for k in range(3))
        found, first, of = np.unique(prints, return_index=True, return_inverse=True)
        many = np.bincount(of, weights=totals, minlength=len(found)).astype(np.int64)
        last = lasts[first] if n > 1 else np.zeros(len(found), np.uint64)
        return pa.record_batch([pa.array(found.view(np.int64)), pa.array(last.view(np.int64)), pa.array(many)], names=["print", "last", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = [b.value for b in bits]
        for batch in batches:
            parts, size = [], 0
            for tokens, _, _ in _blocks(batch, key):
                at = tokens.may(n, have)
                found, first, many = np.unique(tokens.phrases[n - 1][at], return_index=True, return_counts=True)
                parts.append((found, tokens.prints[at[first] + n - 1], many))
                size += len(found)
                if size >= MERGED:
                    yield merged(parts)
                    parts, size = [], 0
            if parts:
                yield merged(parts)

    return run


def _chunk(key: tuple, table: pa.Table) -> pa.Table:
    flags = np.zeros(1 << 15, dtype=bool)
    flags[table.column("low").to_numpy()] = True
    return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], names=["high", "flags"])


def bitmap(prints: DataFrame) -> np.ndarray:
    """A bit for the leading ``BITS`` bits of every ``print``: built in chunks of 4 KB, whatever the number of phrases."""
    at = F.shiftrightunsigned("print", 64 - BITS)
    places = prints.select(F.shiftright(at, 15).alias("high"), at.bitwiseAND(F.lit((1 << 15) - 1)).alias("low")).distinct()
    chunks = places.groupBy("high").applyInArrow(_chunk, "high bigint, flags binary").toArrow()
    out = np.zeros((1 << (BITS - 15), 1 << 12), dtype=np.uint8)
    for batch in chunks.to_batches():
        flags = batch.column(1)
        first, last = np.frombuffer(flags.buffers()[1], np.int32)[[flags.offset, flags.offset + len(flags)]]
        out[batch.column(0).to_numpy()] = np.frombuffer(flags.buffers()[2], np.uint8)[first:last].reshape(-1, 1 << 12)
    return out.reshape(-1)


def _spelled(bits, key: int):
    """The words that may be frequent: each once a task, with its fingerprint as a phrase of one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, seen = [b.value for b in bits], np.zeros(0, dtype=np.uint64)
        for batch in batches:
            for tokens, langs, own in _blocks(batch, key):
                at = tokens.may(1, have)
                prints, first = np.unique(tokens.phrases[0][at], return_index=True)
                new = ~np.isin(prints, seen, assume_unique=True)
                prints, at = prints[new], at[first[new]]
                seen = np.union1d(seen, prints)
                names = pa.array(langs, pa.string()).take(pa.array(own[tokens.row[at]]))
                yield pa.record_batch([pa.array(prints.view(np.int64)), names, tokens.spelled(at, 1)], names=["print", "lang", "word"])

    return run


def _unmixed(x: np.ndarray) -> np.ndarray:
    """What ``mix`` was given."""
    first, second = (np.uint64(pow(c, -1, 1 << 64)) for c in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
    x = (x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))) * second
    x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * first
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fingerprint of a phrase without its last word."""
    back = np.uint64(pow(int(_STEP), -1, 1 << 64))
    for batch in batches:
        whole, last = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
        yield pa.record_batch([*batch.columns, pa.array(((_unmixed(whole) - last) * back).view(np.int64))], names=["print", "last", "head"])


def _tails(key: int):
    """The fingerprint that a phrase's last word has as a phrase of its language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(2).dictionary_encode()
            langs = np.array([_print(x, key) for x in coded.dictionary.to_pylist()], dtype=np.uint64)[coded.indices.to_numpy()]
            tail = mix(batch.column(1).to_numpy().view(np.uint64) ^ mix(langs))
            yield pa.record_batch([batch.column(0), batch.column(2), batch.column(3), pa.array(tail.view(np.int64))], names=["print", "lang", "phrase", "tail"])

    return run


def _word_prints(column: pa.Array, key: int) -> np.ndarray:
    """The fingerprints of all words of phrases, one after the other."""
    data, offsets = texts_of(column)
    return fingerprints(data, offsets, _WORD, LOWER, key)[2]


def _trie(key: int):
    """A shard of candidates (number, lang, words, phrase) as one row: alphabet and double array."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("number")
        many = table.column("words").to_numpy().astype(np.int64)
        cuts = np.cumsum(many) - many
        text = table.column("phrase").combine_chunks()
        flat = _word_prints(text, key)
        coded = table.column("lang").combine_chunks().dictionary_encode()
        langs = np.array([_print(x, key) for x in coded.dictionary.to_pylist()], dtype=np.uint64)[coded.indices.to_numpy()]
        alphabet = np.unique(np.concatenate([flat, langs]))
        codes = np.full((len(many), LONGEST + 1), -1, dtype=np.int64)
        codes[:, 0] = np.searchsorted(alphabet, langs)
        for k in range(LONGEST):
            there = many > k
            codes[there, k + 1] = np.searchsorted(alphabet, flat[cuts[there] + k])
        base, check, accept = doublearray.build(codes, many + 1)
        return pa.table([pa.array([table.column("shard")[0].as_py()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (alphabet, base, check, accept))], names=["shard", "alphabet", "base", "check", "accept"])

    return run


class Trie:
    """A shard's trie in a worker, or on its way there."""

    def __init__(self, alphabet, *arrays):
        self.alphabet = np.frombuffer(alphabet, np.uint64)
        self.arrays = tuple(np.frombuffer(x, np.int32) for x in arrays)

    def count(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, occurrences) of the phrases that rows of fingerprints (language, words) are."""
        at = np.minimum(np.searchsorted(self.alphabet, prints), len(self.alphabet) - 1)
        codes = np.where(self.alphabet[at] == prints, at, -1)
        total = np.bincount(doublearray.walk(self.arrays, codes))
        number = np.flatnonzero(total)
        return number, total[number]


def _walked(tries: list, bits, key: int):
    """Every position's phrases of each length through the trie of their shard."""

    def flush(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        merged = {n: [np.concatenate(x) for x in zip(*parts, strict=True)] for n, parts in held.items() if parts}
        for shard, trie in enumerate(tries):
            for prints, of in merged.values():
                mine = prints[of == shard]
                if len(mine):
                    number, total = trie.value.count(mine)
                    yield pa.record_batch([pa.array(np.full(len(number), shard, dtype=np.int32)), pa.array(number.astype(np.int32)), pa.array(total.astype(np.int64))], names=["shard", "number", "n"])
            if len(tries) > 1:
                trie.__dict__.pop("_value", None)  # one trie at a time in the worker's memory

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = [b.value for b in bits]
        held: dict[int, list] = {n: [] for n in range(2, LONGEST + 1)}
        size = 0
        for batch in batches:
            for tokens, _, _ in _blocks(batch, key):
                for n in held:
                    at = tokens.may(n, have)
                    held[n].append((np.stack([tokens.lang[at], *(tokens.prints[at + k] for k in range(n))], axis=1), (tokens.phrases[n - 1][at] % np.uint64(len(tries))).astype(np.int32)))
                    size += len(at)
                if size >= POSITIONS:
                    yield from flush(held)
                    held, size = {n: [] for n in held}, 0
        if size:
            yield from flush(held)

    return run


def candidates(rows: DataFrame, key: int, keep: Callable, least: int = LEAST) -> tuple[DataFrame, DataFrame, list]:
    """(words with their frequency, candidate phrases, bitmaps of phrases of each length): all phrases that may stand ``least`` times."""
    context, bits, tables = rows.sparkSession.sparkContext, [], []
    for n in range(1, LONGEST + 1):
        sums = rows.mapInArrow(_counted(n, list(bits), key), "print bigint, last bigint, n bigint").groupBy("print").agg(F.min("last").alias("last"), F.sum("n").alias("n"))
        tables.append(keep(sums.where(F.col("n") >= least), f"level{n}"))
        bits.append(context.broadcast(bitmap(tables[-1])))
    # tasks spell a word each, so it is named once before it meets the sums
    spelled = rows.mapInArrow(_spelled(bits[:1], key), "print bigint, lang string, word string").groupBy("print").agg(F.first("lang").alias("lang"), F.first("word").alias("word"))
    words = keep(spelled.join(tables[0].select("print", F.col("n").alias("f")), "print"), "words")
    shorter, found = words.select(F.col("print").alias("head"), "lang", F.col("word").alias("phrase")), None
    tails = words.select(F.col("print").alias("tail"), "word")
    for n in range(2, LONGEST + 1):
        headed = tables[n - 1].select("print", "last").mapInArrow(_heads, "print bigint, last bigint, head bigint")
        begun = headed.join(shorter, "head").select("print", "last", "lang", "phrase").mapInArrow(_tails(key), "print bigint, lang string, phrase string, tail bigint")
        part = keep(begun.join(tails, "tail").select(F.lit(n).alias("words"), "print", "lang", F.concat_ws(" ", "phrase", "word").alias("phrase")), f"named{n}")
        found = part if found is None else found.unionByName(part)
        shorter = part.select(F.col("print").alias("head"), "lang", "phrase")
    return words.select("lang", "word", "f"), found, bits


def count(rows: DataFrame, found: DataFrame, bits: list, key: int, keep: Callable, shard: int = SHARD) -> DataFrame:
    """(lang, words, phrase, n): how often each candidate stands in the rows (lang, text)."""
    shards = max(1, -(-found.count() // shard))
    # the remainder of the fingerprint taken as unsigned, as the tasks take it
    low = F.pmod("print", F.lit(shards).cast("bigint"))
    of = F.when(F.col("print") >= 0, low).otherwise(F.pmod(low + F.lit(2**64 % shards), F.lit(shards).cast("bigint"))).cast("int")
    numbered = found.withColumn("shard", of).withColumn("number", F.row_number().over(Window.partitionBy("shard").orderBy("lang", "phrase")) - 1)
    numbered = keep(numbered.select("shard", "number", "lang", "words", "phrase"), "numbered")
    built = keep(numbered.groupBy("shard").applyInArrow(_trie(key), "shard int, alphabet binary, base binary, check binary, accept binary"), "tries")
    context = rows.sparkSession.sparkContext
    tries = []
    for k in range(shards):  # the driver holds one trie, of a bounded size, at a time
        row = built.where(F.col("shard") == k).drop("shard").toArrow()  # buffers, of which no copies are made here
        empty = (np.zeros(1, np.uint64), *doublearray.build(np.zeros((1, 1), np.int64), np.ones(1, np.int64)))
        tries.append(context.broadcast(Trie(*((c[0].as_buffer() for c in row.columns) if row.num_rows else empty))))
        del row
    counts = rows.mapInArrow(_walked(tries, bits, key), "shard int, number int, n bigint").groupBy("shard", "number").agg(F.sum("n").alias("n"))
    return keep(numbered.join(counts, ["shard", "number"]).select("lang", "words", "phrase", "n"), "counts")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)), in decimals of 38 digits; a is at most l and r, so that it is at most a million."""
    wide = lambda c: c.cast("decimal(16,0)")
    up = (wide(a) * wide(a)).cast("decimal(32,0)") * F.lit(1000000).cast("decimal(7,0)")
    down = (wide(left) * wide(right)).cast("decimal(32,0)")
    return F.call_function("div", up.cast("decimal(38,0)"), down.cast("decimal(38,0)"))


def ranked(counts: DataFrame, words: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, score of each language's first phrases, from counts of phrases and of words (lang, word, f)."""
    often = counts.where(F.col("n") >= least)
    split = F.split("phrase", " ")
    two = often.where("words = 2").select("lang", split[0].alias("w1"), split[1].alias("w2"), F.col("n").alias("a"))
    three = often.where("words = 3").select("lang", split[0].alias("w1"), split[1].alias("w2"), split[2].alias("w3"), F.col("n").alias("a"))
    one = lambda w, f: words.select("lang", F.col("word").alias(w), F.col("f").alias(f))
    pair = lambda x, y, f: two.select("lang", F.col("w1").alias(x), F.col("w2").alias(y), F.col("a").alias(f))
    inside = three.select("lang", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "a").groupBy("lang", "p.w1", "p.w2").agg(F.max("a").alias("longer"))
    short = two.join(inside, ["lang", "w1", "w2"], "left").where("longer IS NULL OR 100 * longer < 50 * a")
    short = short.join(one("w1", "l"), ["lang", "w1"]).join(one("w2", "r"), ["lang", "w2"])
    short = short.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    long = three.join(one("w1", "l1"), ["lang", "w1"]).join(pair("w2", "w3", "r1"), ["lang", "w2", "w3"]).join(pair("w1", "w2", "l2"), ["lang", "w1", "w2"]).join(one("w3", "r2"), ["lang", "w3"])
    cuts = F.least(*[F.struct(score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)])
    long = long.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", cuts.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = short.unionByName(long).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "score")


def collocations(documents: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``top`` phrases."""
    rows = documents.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    key = new_key()
    with scratch(documents.sparkSession, "collocations") as keep:
        totals = rows.mapInArrow(_totals, "lang string, n bigint").groupBy("lang").agg(F.sum("n").alias("n"))
        words, found, bits = candidates(rows, key, keep, least)
        counts = count(rows, found, bits, key, keep, shard)
        return stored(ranked(counts, words, least, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
