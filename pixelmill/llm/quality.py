"""Quality rules as a bitmask ledger.

Every text is measured once; every rule is evaluated once on the measurements and leaves one bit in
``mask``. ``ledger`` stores measurements and bits in the shared folder. A policy is a named, versioned set of
rules: a text is kept if it has none of the policy's bits. Changing a policy, or asking what a policy would do
without one of its rules (ablation), works on the stored masks by bitwise aggregation and never reads a text again.

Defined cases: null text is a text without words (it fails ``too_short``); texts are measured whole,
whatever their length; equal rows are measured alike and all stay rows; empty tables give empty
ledgers; input columns are passed through untouched in ``with_ledger``, where the one new column gets
a name of the caller's choice, so that no name clashes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .words import BLANK, SAME, blocks, fingerprints, mix, new_key, texts_of, windows

MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_capitals",
    "n_chars", "n_digits", "n_points", "n_braces", "n_beyond_ascii", "n_distinct_words", "n_stop_words", "longest_word", "n_long_words", "n_lettered_words",
    "n_bullet_lines", "n_ellipsis_lines", "n_short_lines",
]
REPEAT_WINDOW = 8
# Frequent words of English, German, French and Spanish.
STOP_WORDS = "the of and to in that is der die und das ist nicht le la les et des est el los que en y por".split()
LONG_WORD, SHORT_LINE = 20, 3

#: Rule -> condition of failure over the measurements. The place in this list is the rule's bit; new
#: rules are added at the end, so that stored masks stay readable.
RULES: list[tuple[str, str]] = [
    ("too_short", "n_words < 20"),
    ("repeats_itself", "100 * n_repeat_words > 30 * n_words"),
    ("symbol_noise", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    ("shouting", "n_letters >= 50 AND 10 * n_capitals > 4 * n_letters"),
    ("odd_word_length", "n_words > 0 AND (word_chars > 40 * n_words OR 2 * word_chars < 3 * n_words)"),
    ("too_long", "n_words > 100000"),
    ("digits", "5 * n_digits > n_chars"),
    ("no_punctuation", "n_words >= 50 AND n_points = 0"),
    ("much_punctuation", "2 * n_points > n_words"),
    ("braces", "n_braces > 0 AND 100 * n_braces > n_chars"),
    ("few_letters", "2 * (n_letters + n_beyond_ascii) < word_chars"),
    ("few_lettered_words", "5 * n_lettered_words < 4 * n_words"),
    ("few_distinct_words", "n_words >= 50 AND 5 * n_distinct_words < n_words"),
    ("no_stop_words", "n_words >= 50 AND n_stop_words < 2"),
    ("giant_word", "longest_word > 1000"),
    ("many_long_words", "5 * n_long_words > n_words"),
    ("bullet_lines", "n_lines >= 4 AND 10 * n_bullet_lines > 9 * n_lines"),
    ("ellipsis_lines", "n_lines >= 4 AND 10 * n_ellipsis_lines > 3 * n_lines"),
    ("short_lines", "n_lines >= 10 AND 5 * n_short_lines > 4 * n_lines"),
    ("some_repeated_lines", "n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines"),
    ("some_repetition", "100 * n_repeat_words > 15 * n_words"),
]
#: Policy -> its rules. Versions are only ever added.
POLICIES: dict[str, list[str]] = {
    "base": ["too_short", "repeats_itself"],
    "v1": ["too_short", "repeats_itself", "symbol_noise", "repeated_lines", "shouting", "odd_word_length"],
    "strict": [name for name, _ in RULES],
}


def _bytes(signs: str) -> np.ndarray:
    return np.isin(np.arange(256), [ord(c) for c in signs])


_code = np.arange(256)
_SYMBOL = _bytes("#*$%&|<>")
_LINE = _code != 0x0A
_CAPITAL = (_code >= 0x41) & (_code <= 0x5A)
_LETTER = _CAPITAL | ((_code >= 0x61) & (_code <= 0x7A))
_DIGIT = (_code >= 0x30) & (_code <= 0x39)
_HEAD = (_code & 0xC0) != 0x80  # the first byte of a character
_BEYOND = _code >= 0xC0
_BULLET = _bytes("-*")
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Words and lines are compared within a text only, so every worker may have a key of its own.
_KEY = new_key()
_ROUND, _DOTS = np.frombuffer("•".encode(), np.uint8), np.frombuffer("…".encode(), np.uint8)


def _running(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])


def _own(prints: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Fingerprints made distinct between rows."""
    return mix(prints + row.astype(np.uint64) * _ODD)


def _distinct(prints: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Different fingerprints in each row."""
    _, first = np.unique(_own(prints, row), return_index=True)
    return np.bincount(row[first], minlength=rows)


def _stop_prints() -> np.ndarray:
    data, offsets = texts_of(pa.array(STOP_WORDS))
    return fingerprints(data, offsets, BLANK, SAME, _KEY)[2]


def _repeated(prints: np.ndarray, of_word: np.ndarray, rows: int) -> np.ndarray:
    """Words in windows that a row has twice or more."""
    found = windows(prints, REPEAT_WINDOW)
    if not len(found):
        return np.zeros(rows, dtype=np.int64)
    at = np.flatnonzero(of_word[: len(found)] == of_word[REPEAT_WINDOW - 1 :])
    keys = _own(found[at], of_word[at])
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(prints) + 1, dtype=np.int64)
    edge[at[twice]] += 1
    edge[at[twice] + REPEAT_WINDOW] -= 1
    return np.bincount(of_word[np.cumsum(edge[:-1]) > 0], minlength=rows)


def _ends_with(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Which byte ranges end with three given bytes."""
    at = np.maximum(ends - 3, 0)
    return (ends - starts >= 3) & (data[at] == tail[0]) & (data[np.minimum(at + 1, len(data) - 1)] == tail[1]) & (data[np.minimum(at + 2, len(data) - 1)] == tail[2])


def _measure_block(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    rows = len(offsets) - 1
    if not len(data):
        return [np.zeros(rows, dtype=np.int64)] * len(MEASURES)
    begins, finishes, prints, n_words = fingerprints(data, offsets, BLANK, SAME, _KEY)
    of_word = np.repeat(np.arange(rows), n_words)
    head = _HEAD[data]
    chars = _running(head)
    size = chars[finishes] - chars[begins]
    lettered = _running(_LETTER[data] | (data >= 0x80))
    longest = np.zeros(rows, dtype=np.int64)
    np.maximum.at(longest, of_word, size)

    starts, ends, lines, n_lines = fingerprints(data, offsets, _LINE, SAME, _KEY)
    first, last = np.searchsorted(begins, starts), np.searchsorted(begins, ends)  # the words of each line
    wordy = last > first
    of_line = np.repeat(np.arange(rows), n_lines)[wordy]
    first, last, lines = first[wordy], last[wordy] - 1, lines[wordy]
    with_words = np.bincount(of_line, minlength=rows)
    dup = with_words - _distinct(lines, of_line, rows)
    lead = begins[first]
    bullet = _BULLET[data[lead]] | _ends_with(data, lead + 3, lead, _ROUND)
    dots = _ends_with(data, finishes[last], begins[last], np.frombuffer(b"...", np.uint8)) | _ends_with(data, finishes[last], begins[last], _DOTS)

    def count(kind: np.ndarray) -> np.ndarray:
        return np.diff(_running(kind[data])[offsets])

    def by(row: np.ndarray, flags: np.ndarray) -> np.ndarray:
        return np.bincount(row[flags], minlength=rows)

    return [
        n_words, np.bincount(of_word, weights=size, minlength=rows).astype(np.int64), count(_SYMBOL), with_words, dup, _repeated(prints, of_word, rows), count(_LETTER), count(_CAPITAL),
        np.diff(chars[offsets]), count(_DIGIT), count(_bytes(".,;:!?")), count(_bytes("{}")), count(_BEYOND), _distinct(prints, of_word, rows), by(of_word, np.isin(prints, _stop_prints())),
        longest, by(of_word, size > LONG_WORD), by(of_word, lettered[finishes] > lettered[begins]),
        by(of_line, bullet), by(of_line, dots), by(of_line, last - first < SHORT_LINE),
    ]


def measure(column: pa.Array) -> list[np.ndarray]:
    """The measurements of a column of texts, in the order of ``MEASURES``."""
    data, offsets = texts_of(column)
    parts = []
    for first, last in blocks(offsets):
        at = offsets[first : last + 1]
        parts.append(_measure_block(data[at[0] : at[-1]], at - at[0]))
    return [np.concatenate([p[i] for p in parts] or [np.zeros(0)]).astype(np.int64) for i in range(len(MEASURES))]


@F.arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def measurements(text: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(x) for x in measure(text)], names=MEASURES)


def with_ledger(documents: DataFrame, text_col: str = "text", out: str = "ledger") -> DataFrame:
    """``documents`` with a struct of the measurements and the failure bits (``mask``) of all rules."""
    bits = None
    for bit, (_, condition) in enumerate(RULES):
        part = F.when(F.expr(_qualified(condition, f"`{out}`")), F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint")
        bits = part if bits is None else bits.bitwiseOR(part)
    measured = documents.withColumn(out, measurements(F.col(text_col).cast("string")))
    return measured.withColumn(out, F.col(out).withField("mask", bits))


def ledger(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids, measurements and ``mask`` of all rows, stored in the shared folder for any later policy or ablation."""
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return stored(with_ledger(rows).select("doc_id", "ledger.*"), "ledger")


def _qualified(condition: str, cell: str) -> str:
    """The condition over fields of a struct column."""
    return re.sub(r"\b(" + "|".join(MEASURES) + r")\b", rf"{cell}.\1", condition)


def policy_mask(policy: str) -> int:
    bit = {name: 1 << i for i, (name, _) in enumerate(RULES)}
    return sum(bit[name] for name in POLICIES[policy])


def passes(mask: Column, policy: str = "v1") -> Column:
    """Whether a mask has none of the policy's bits."""
    return mask.bitwiseAND(F.lit(policy_mask(policy)).cast("bigint")) == 0


def ablation(ledger: DataFrame, policy: str = "v1", mask_col: str = "mask") -> DataFrame:
    """Per rule of a policy: rows it fails, rows that only it rejects, rows rejected without it, and the bits ``seen_with`` it.

    Rows are first counted by mask (partial sums, one row a mask after the shuffle); each counted mask then
    adds to the rules of the policy, of which there are as many as the policy names.
    """
    whole = policy_mask(policy)
    bits = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("bigint").alias("bit")) for i, (name, _) in enumerate(RULES) if name in POLICIES[policy]])
    counted = ledger.groupBy(F.col(mask_col).bitwiseAND(F.lit(whole).cast("bigint")).alias("hit")).agg(F.count("*").alias("n"))
    per = counted.select("hit", "n", F.explode(bits).alias("r")).select("hit", "n", "r.rule", "r.bit")

    def total(condition: str) -> Column:
        return F.coalesce(F.sum(F.when(F.expr(condition), F.col("n"))), F.lit(0))

    return per.groupBy("rule", "bit").agg(
        total("hit & bit != 0").alias("fails"), total("hit = bit").alias("fails_alone"), total("hit & ~bit != 0").alias("rejected_without"),
        F.coalesce(F.bit_or(F.when(F.expr("hit & bit != 0"), F.col("hit"))), F.lit(0)).alias("seen_with"),
    )


def assess(documents: DataFrame, policy: str = "v1") -> DataFrame:
    """The contract's columns, the rest of the stored ledger, and the policy's verdict ``kept``."""
    rows = ledger(documents)
    base = ~passes(F.col("mask"), "base")
    return rows.withColumn("base_failed", base).withColumn("kept", ~base & passes(F.col("mask"), policy))
