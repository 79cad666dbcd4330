"""Secret scans by a trigram inverted index, in DataFrame functions alone.

Each rule's regex is taken apart once, on the driver, into a Boolean query: alternatives, each the set
of trigrams that any text it matches must hold. The index has, for every trigram that a query
asks for, the keys of the texts that hold it, in blocks of some thousand texts so that the postings of a
common trigram are many short lists. Candidates of an alternative are the intersection of its lists,
block by block. Only candidates are searched with the regex; a rule without mandatory trigrams
searches every text. A text's key is its hash: copies share their postings, and two texts with one
hash would only be candidates for each other's rules.

Defined cases: null text is the empty text (no spans); texts are indexed and searched whole; repeated
rows give equal results each; places count code points, ends are exclusive; empty tables give empty
results; columns other than the two named are not read.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, text_of

# Kind, regex (Java and Python read it alike), group whose length counts, least length.
RULES = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("gitlab", r"glpat-[A-Za-z0-9_-]{20,}", 0, 26),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}", 0, 24),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    ("npm", r"npm_[A-Za-z0-9]{36}", 0, 40),
    ("sendgrid", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", 0, 36),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
]
BASE_KINDS = 3
BLOCK_TEXTS = 2000
#: Tasks over which the copies of a text are dealt where they meet their candidates.
SALTS = 16
#: Alternatives of a query; one that would have more is weakened to what is certain so far.
MOST_ALTERNATIVES = 64

Literals = list[list[str]]  # alternatives, each the literal runs that must be in the text; the last run may grow


def _product(left: Literals, right: Literals, joined: bool) -> Literals:
    out = []
    for a, b in itertools.product(left, right):
        out.append([*a[:-1], a[-1] + b[0], *b[1:]] if joined else [*a, *b])
    return out


def _literals(tree) -> Literals:
    """Alternatives of a parsed regex. Each begins and ends with the runs that touch its edges ("" if none does)."""
    out: Literals = [[""]]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            part = [[chr(arg)]]
        elif name == "SUBPATTERN":
            part = _literals(arg[-1])
        elif name == "BRANCH":
            part = [alternative for branch in arg[1] for alternative in _literals(branch)]
        elif name == "IN" and len(arg) <= 8 and all(str(kind) == "LITERAL" for kind, _ in arg):
            part = [[chr(value)] for _, value in arg]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = arg
            once = _literals(inner)
            if (least, most) == (0, 1):
                part = [[""], *once]
            elif least == most == 1:
                part = once
            elif least:  # its first turn is certain, then anything may come
                part = [[*alternative, ""] for alternative in once]
            else:
                part = [["", ""]]
        elif name in ("ASSERT", "ASSERT_NOT", "AT"):
            continue
        else:
            part = [["", ""]]  # any character: what follows begins a new run
        if len(out) * len(part) > MOST_ALTERNATIVES:
            part = [["", ""]]
        out = _product(out, part, True)
    return out


def trigram_query(regex: str) -> list[frozenset[str]]:
    """Alternatives of trigrams (lower case) that a text must hold all of; an empty one means: search every text."""
    tree = re._parser.parse(regex)
    found = {frozenset(run[i : i + 3].lower() for run in runs for i in range(len(run) - 2)) for runs in _literals(tree)}
    # an alternative that asks for more than another is covered by it
    return sorted((a for a in found if not any(b < a for b in found)), key=lambda a: sorted(a))


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("text"))


def build_index(texts: DataFrame, trigrams: list[str], n_rows: int) -> DataFrame:
    """(trigram, block, keys): which texts hold the trigrams, lower-cased, in the shared folder."""
    low = texts.select("key", F.lower("text").alias("low"))
    held = low.select("key", F.explode(F.filter(F.lit(trigrams), lambda t: F.contains(F.col("low"), t))).alias("trigram"))
    blocks = max(1, -(-n_rows // BLOCK_TEXTS))
    postings = held.groupBy("trigram", F.pmod("key", F.lit(blocks)).alias("block")).agg(F.array_sort(F.collect_set("key")).alias("keys"))
    return stored(postings, "postings")


def candidates(index: DataFrame, queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """(key, rules): the rules whose query each text meets. Rules with an empty alternative are not listed."""
    spark = index.sparkSession
    rows, alternative = [], 0
    for rule, query in queries.items():
        if frozenset() in query:
            continue
        for part in query:
            rows += [(rule, alternative, t, len(part)) for t in part]
            alternative += 1
    asked = F.broadcast(spark.createDataFrame(rows, "rule int, alternative int, trigram string, needed int"))  # the fixed rules' trigrams
    lists = index.join(asked, "trigram").groupBy("rule", "alternative", "block").agg(F.collect_list(F.struct(F.size("keys").alias("n"), "keys")).alias("lists"), F.max("needed").alias("needed"))
    ordered = F.transform(F.array_sort("lists"), lambda x: x["keys"])  # shortest first
    met = lists.where(F.size("lists") == F.col("needed")).select("rule", F.explode(F.aggregate(F.slice(ordered, 2, 1000), ordered[0], lambda a, b: F.array_intersect(a, b))).alias("key"))
    return met.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[tuple] | None = None) -> DataFrame:
    """(uid, doc_id, spans): every row's spans as structs of start, kind number, end and the counted length."""
    rules = rules or RULES
    queries = {i: trigram_query(rule[1]) for i, rule in enumerate(rules)}
    full = [i for i, query in queries.items() if frozenset() in query]
    trigrams = sorted({t for query in queries.values() for part in query for t in part})
    rows = _keyed(documents, id_col, text_col)
    index = build_index(rows, trigrams, documents.count())
    wanted = stored(candidates(index, queries), "candidates")
    # copies of one text have one key: they are dealt over SALTS tasks, each with a copy of the candidates' ids and rules
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "salt"], "left")
    text, named = F.col("text"), F.coalesce("rules", F.array().cast("array<int>"))

    def run(i: int) -> Column:
        regex, group = F.lit(rules[i][1]), rules[i][2]
        lengths = [F.transform(F.split(text, regex, -1), lambda p: F.length(p)), *(F.transform(F.regexp_extract_all(text, regex, F.lit(g)), lambda m: F.length(m)) for g in (0, group))]
        asked = text.rlike(rules[i][1]) if i in full else F.array_contains(named, i)
        return F.when(asked, F.struct(F.lit(i).alias("kind"), lengths[0].alias("gaps"), lengths[1].alias("sizes"), lengths[2].alias("counted")))

    found = joined.select("doc_id", F.array_compact(F.array(*[run(i) for i in range(len(rules))])).alias("found")).withColumn("uid", F.monotonically_increasing_id())
    return stored(found, "secrets")


def spans(scanned: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """(uid, start, kind, end), one row a span that is long enough."""
    rules = rules or RULES
    flat = scanned.select("uid", F.explode("found").alias("f")).select("uid", "f.kind", F.posexplode(F.arrays_zip("f.gaps", "f.sizes", "f.counted")).alias("k", "m")).where("m.sizes IS NOT NULL")
    run = Window.partitionBy("uid", "kind").orderBy("k")
    end = (F.sum("m.gaps").over(run) + F.sum("m.sizes").over(run)).cast("bigint")
    least = F.array(*[F.lit(rule[3]) for rule in rules])
    placed = flat.select("uid", "kind", "m.counted", "m.sizes", end.alias("end")).where(F.col("counted") >= least[F.col("kind")])
    return placed.select("uid", (F.col("end") - F.col("sizes")).alias("start"), "kind", "end")


def report(documents: DataFrame) -> DataFrame:
    """The contract's columns for every row of ``documents``."""
    scanned = scan(documents)
    per = spans(scanned).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("all"))
    rows = scanned.select("uid", "doc_id").join(per, "uid", "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))
    kinds = F.array(*[F.lit(rule[0]) for rule in RULES])

    def named(cells: Column) -> Column:
        return F.concat_ws(",", F.transform(cells, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])))

    found = F.transform("all", lambda s: s["kind"])
    counts = [(F.size("all") - F.size(F.array_remove(found, i))).cast("bigint").alias(f"n_{RULES[i][0]}") for i in range(BASE_KINDS)]
    base = F.filter("all", lambda s: s["kind"] < BASE_KINDS)
    return rows.select("doc_id", *counts, F.sha2(named(base), 256).alias("base_sha256"), named(F.col("all")).alias("spans"))
