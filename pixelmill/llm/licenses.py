"""License scans: ordered signature rules on normalised words, in DataFrame functions alone.

A text is reduced to its words (0-9, A-Z, a-z and what is beyond ASCII), one space apart. Texts without
any further keyword are done. For the others the set of keywords they hold is taken once, and a rule's
regex runs, once, only if its keyword and one of its further keywords are there. A detection is an interval of words; one that lies
within another of the same or a higher priority is suppressed, and so is the later rule of two equal
intervals of one priority. Base phrases are reported wherever they stand, suppressed or not.

The text pass writes what it found (rule, and the spaces between and in its matches) to the shared folder; positions,
suppression and labels are windows over those few rows, so no text is shuffled.

Defined cases: null text is the empty text (no words, score 0, empty labels, null positions); texts
are scanned whole; repeated rows give equal results each; empty tables give empty results; columns
other than the two named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, text_of
from .signatures import CLASSES

# The base phrases and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]


def rules() -> list[tuple]:
    """(rule, label, priority, confidence, keyword, further keywords, regex, base): base phrases first, then the signatures.

    Every match of a regex holds the keyword and one of the further keywords as words.
    """
    out = [(label, 2, 0.8, phrase.split()[0], ["license"], phrase, True) for phrase, label in BASE]
    out += [(label, priority, confidence, own, further.split("|"), regex, False) for rows, priority, confidence in CLASSES for label, own, further, regex in rows]
    return [(i, *rule) for i, rule in enumerate(out)]


def any_of(words: list[str]) -> str:
    """A regex for one of several words, with what they begin with in common written once, so that few are tried at a place."""
    heads: dict[str, list[str]] = {}
    for word in sorted(set(words)):
        heads.setdefault(word[:1], []).append(word[1:])
    parts = [head + (any_of(tails) if tails != [""] else "") for head, tails in heads.items() if head]
    if not parts:
        return ""
    return (parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})") if "" not in heads else f"(?:{'|'.join(parts)})?"


_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _literal(rows: list[tuple]) -> Column:
    """The rules as one constant."""
    return F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(a).alias("own"), F.array(*map(F.lit, b)).alias("further"), F.lit(f"(?<= )(?:{regex})(?= )").alias("regex")) for i, _, _, _, a, b, regex, _ in rows])


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: list[tuple] | None = None) -> DataFrame:
    """Per row its key, n_words and, for each rule that matched, the spaces before the first match, in it, before the second, and so on."""
    rows = rows or rules()
    further = sorted({word for r in rows for word in r[5]})
    keywords = sorted({r[4] for r in rows} | set(further))
    words = F.trim(F.regexp_replace(text_of(text_col), _BETWEEN, " "))
    base = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), words.alias("words")).withColumn("uid", F.monotonically_increasing_id())
    base = base.withColumn("n_words", F.when(F.col("words") == "", F.lit(0)).otherwise(_spaces(F.col("words")) + 1).cast("bigint"))
    gate = F.col("words").rlike(rf"(?i)\b{any_of(further)}\b")
    base = base.withColumn("norm", F.when(gate, F.concat(F.lit(" "), F.translate("words", _UPPER, _LOWER), F.lit(" "))))
    base = base.withColumn("held", F.array_distinct(F.regexp_extract_all("norm", F.lit(f"(?<= )({any_of(keywords)})(?= )"), F.lit(0))))
    norm, held = F.col("norm"), F.col("held")

    def matched(rule: Column) -> Column:
        # words hold no control characters, so two of them can mark where matches begin and end
        parts = F.split(F.regexp_replace(norm, rule["regex"], F.lit("\u0001$0\u0002")), "[\u0001\u0002]", -1)
        return F.struct(rule["rule"].alias("rule"), F.transform(parts, lambda p: _spaces(p)).alias("spaces"))

    wanted = F.filter(_literal(rows), lambda r: F.array_contains(held, r["own"]) & F.arrays_overlap(held, r["further"]))
    found = F.when(norm.isNotNull(), F.filter(F.transform(wanted, matched), lambda m: F.size(m["spaces"]) > 1))
    return stored(base.select("uid", "doc_id", "n_words", found.alias("found")), "licenses")


def detections(scanned: DataFrame, rows: list[tuple] | None = None) -> DataFrame:
    """(uid, rule, label, first word, last word, priority, confidence, base, suppressed), one row a match."""
    rows = rows or rules()
    spark = scanned.sparkSession
    facts = F.broadcast(spark.createDataFrame([(r[0], r[1], r[2], r[3], r[7]) for r in rows], "rule int, label string, priority int, confidence double, base boolean"))  # the fixed rules
    flat = scanned.select("uid", F.explode("found").alias("f")).select("uid", "f.rule", F.posexplode("f.spaces").alias("k", "n"))
    before = F.sum("n").over(Window.partitionBy("uid", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    hits = flat.withColumn("first", before - 1).where("k % 2 = 1").select("uid", "rule", "first", (F.col("first") + F.col("n")).alias("last")).join(facts, "rule")
    earlier = Window.partitionBy("uid").orderBy("first", F.desc("last"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.lit(None).cast("bigint")
    for level in sorted({r[2] for r in rows}):
        covered = F.when(F.col("priority") == level, F.max(F.when(F.col("priority") >= level, F.col("last"))).over(earlier)).otherwise(covered)
    return hits.withColumn("suppressed", F.coalesce(covered >= F.col("last"), F.lit(False)))


def report(documents: DataFrame) -> DataFrame:
    """The contract's columns for every row of ``documents``; score is the best confidence of what is not suppressed."""
    scanned = scan(documents)
    hits = detections(scanned)
    kept = F.col("base") | ~F.col("suppressed")
    per = hits.groupBy("uid").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).cast("bigint").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).cast("bigint").alias("last_word"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label"))))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(kept, F.col("label"))))).alias("labels"),
        F.max(F.when(kept, F.col("confidence"))).alias("score"),
    )
    rows = scanned.select("uid", "doc_id", "n_words").join(per, "uid", "left")
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
