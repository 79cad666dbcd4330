"""Personal data: fixed forms, and bootstrapped extraction from the words around them.

The fixed forms (e-mail, ip, card, phone) give the seeds. Each mention, a seed or another string shaped
like an identifier, stands in lexical patterns: the words left and right of it, whole or as far as the mention leaves
them (one of over ``LONG`` characters by a keyed digest, so that no pattern is long and no two different words meet).
A text is cut into words once and a long word is read once, however many mentions stand in it. Patterns and instances
form a bipartite graph that Spark scores in rounds: a pattern's confidence for a kind is the share of
its known instances that are of the kind, an unseen instance's score is the noisy-or of the confident
patterns that it stands in. Unseen instances count by their score, those without one do not count, so scores only
grow; rounds end when no score changes. Instances that reach ``ACCEPT`` become spans of the kind. A pattern
needs ``SUPPORT`` different seeds, and a candidate must have the kind's shape.

Defined cases: null text is the empty text (no spans); texts are searched whole; repeated rows give
equal results each; places count code points, ends are exclusive; empty tables give empty results;
input columns other than the two named are not read, and helper columns get names that the table does not have.
"""

from __future__ import annotations

import itertools
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import content_key, fresh, scratch, stored
from .words import new_key

KINDS = ["email", "ip", "card", "phone"]
SUPPORT = 3
CONFIDENT = 0.8
ACCEPT = 0.8
#: A score that grows by less has settled.
SETTLED = 1e-6
#: Characters of a word that a pattern spells out.
LONG = 40
#: Rows and spans that may be broadcast for redaction: some MB.
FEW_ROWS, FEW_SPANS = 50_000, 200_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can only begin where a run of digits does, which keeps long runs from being tried at every digit.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_MARK = re.compile(r"[0-9@]+")
_DIGITS = re.compile(r"[0-9]")
#: Groups of digits joined by single spaces, brackets, dots or hyphens.
_RUN = re.compile(r"(?<![\w@])\(?[0-9]++(?:[().-]{0,2} ?[().-]{0,2}[0-9]++)*+")
_GROUP = re.compile(r"[^ ]+")
_WORD = re.compile(r"\w+")

_SPAN = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("kind", pa.int32())])
_MENTION = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("kind", pa.int32()), ("instance", pa.string()), ("shapes", pa.int32()), ("patterns", pa.list_(pa.string()))])
SCHEMA = "uid bigint, doc_id {id}, base array<struct<first:int,last:int,kind:int>>, mentions array<struct<first:int,last:int,kind:int,instance:string,shapes:int,patterns:array<string>>>"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def find_base(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed forms, leftmost and non-overlapping in each kind."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        first = at
        while first > free and text[first - 1] in _LOCAL:
            first -= 1
        tail = _DOMAIN.match(text, at + 1) if first < at else None
        if tail:
            found.append((first, tail.end(), 0))
            free = tail.end()
        else:
            free = at + 1
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.findall(m[0])) <= 15:
            found.append((m.start(), m.end(), 3))
    return sorted(found)


def _shapes(word: str) -> int:
    """Bits of the kinds that a string could be of."""
    digits = len(_DIGITS.findall(word))
    out = 0
    if re.fullmatch(r"[^\s@]+@[A-Za-z0-9.-]+", word):
        out |= 1
    if re.fullmatch(r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}", word) or re.fullmatch(r"[0-9]{1,3}(?:\[?\.\]?[0-9]{1,3}){3}", word):
        out |= 2
    if 12 <= digits <= 19 and re.fullmatch(r"[0-9 ./_-]+", word):
        out |= 4
    if 7 <= digits <= 15 and re.fullmatch(r"[0-9 ().-]+", word):
        out |= 8
    return out


def _candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, shapes) of further strings that could be identifiers, outside of the base spans."""
    out, after, taken, i = [], 0, base, 0
    for m in _MARK.finditer(text):
        if m.start() < after:
            continue
        first = m.start()
        while first > after and not text[first - 1].isspace():
            first -= 1
        last = m.end()
        while last < len(text) and not text[last].isspace():
            last += 1
        after = last
        while first < last and not (text[first].isalnum() or text[first] in "(:"):
            first += 1
        while last > first and not text[last - 1].isalnum():
            last -= 1
        while i < len(taken) and taken[i][1] <= first:
            i += 1
        if last <= first or (i < len(taken) and taken[i][0] < last):
            continue
        if shapes := _shapes(text[first:last]):
            out.append((first, last, shapes))
    return out + _runs(text, base)


def _runs(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, shapes) of groups of digits with single spaces between, outside of the base spans.

    Any neighbouring groups may be an identifier; a start has few ends, as no shape has over 19 digits.
    """
    out, i = [], 0
    for m in _RUN.finditer(text):
        groups = [(m.start() + g.start(), m.start() + g.end(), len(_DIGITS.findall(g[0]))) for g in _GROUP.finditer(m[0])]
        if m.end() < len(text) and (text[m.end()].isalnum() or text[m.end()] in "_@"):
            groups.pop()
        for k, (first, _, digits) in enumerate(groups):
            while text[first] in ").-":
                first += 1
            while i < len(base) and base[i][1] <= first:
                i += 1
            for _, last, more in itertools.islice(groups, k + 1, k + 20):
                digits += more
                if digits > 19 or (i < len(base) and base[i][0] < last):
                    break
                while text[last - 1] in "().-":
                    last -= 1
                if shapes := _shapes(text[first:last]):
                    out.append((first, last, shapes))
    return out


class _Contexts:
    """The words of one text, and the lexical patterns of places in it."""

    PRIME = (1 << 127) - 1

    def __init__(self, text: str, places: list[tuple[int, int]], key: int):
        self.text, self.base = text, (key << 60) | 3
        self.starts, self.ends = array("q"), array("q")
        for m in _WORD.finditer(text):
            self.starts.append(m.start())
            self.ends.append(m.end())
        self.sums: dict[int, int] = {}
        cuts = sorted({x for place in places for x in place})
        done = -1
        for x in cuts:  # running sums of the long words that a place touches or stands beside
            for k in (bisect_left(self.starts, x) - 2, bisect_left(self.starts, x) - 1, bisect_right(self.ends, x)):
                if done < k < len(self.starts) and self.ends[k] - self.starts[k] > LONG:
                    self._sum(self.starts[k], self.ends[k], cuts)
                    done = k

    def _sum(self, start: int, end: int, cuts: list[int]) -> None:
        value, at, prime, base = 0, start, self.PRIME, self.base
        for cut in [start, *cuts[bisect_right(cuts, start) : bisect_left(cuts, end)], end]:
            for c in self.text[at:cut]:
                value = (value * base + (48 if "0" <= c <= "9" else ord(c.lower()[0]))) % prime
            self.sums[cut], at = value, cut

    def word(self, start: int, end: int) -> str:
        """A word or a part of one: lower-cased, digits as 0; if long, by its digest."""
        if end - start <= LONG:
            return _DIGITS.sub("0", self.text[start:end].lower())
        return f"#{end - start}.{(self.sums[end] - self.sums[start] * pow(self.base, end - start, self.PRIME)) % self.PRIME:x}"

    def patterns(self, first: int, last: int) -> list[str]:
        k = bisect_left(self.starts, first) - 1
        if k < 0:
            return []
        near = self.word(self.starts[k], min(self.ends[k], first))
        out = [f"{near} _"]
        if k:
            out.append(f"{self.word(self.starts[k - 1], self.ends[k - 1])} {near} _")
        after = bisect_right(self.ends, last)
        if after < len(self.ends):
            out.append(f"{near} _ {self.word(max(self.starts[after], last), self.ends[after])}")
        return out


def _patterns(text: str, first: int, last: int, key: int = 0) -> list[str]:
    """The lexical patterns of one place."""
    return _Contexts(text, [(first, last)], key).patterns(first, last)


def _scan(key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            base_col, mention_col = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                if not _HINT.search(text):
                    base_col.append([])
                    mention_col.append([])
                    continue
                base = find_base(text)
                rows = [(a, b, k, 0) for a, b, k in base] + [(a, b, -1, s) for a, b, s in _candidates(text, base)]
                words = _Contexts(text, [r[:2] for r in rows], key) if rows else None
                base_col.append([{"first": a, "last": b, "kind": k} for a, b, k in base])
                mention_col.append([{"first": a, "last": b, "kind": k, "instance": text[a:b].lower(), "shapes": s, "patterns": words.patterns(a, b)} for a, b, k, s in rows])
            n = batch.num_rows
            yield pa.record_batch([pa.array(range(uid, uid + n), pa.int64()), batch.column(0), pa.array(base_col, pa.list_(_SPAN)), pa.array(mention_col, pa.list_(_MENTION))], names=["uid", "doc_id", "base", "mentions"])
            uid += n

    return run


def scan(documents: DataFrame, id_col: str | Column = "doc_id", text_col: str = "text", keep=stored) -> DataFrame:
    """Base spans and mentions of every text, written to the shared folder; ids may be of any type."""
    key = F.col(id_col).cast("bigint") if isinstance(id_col, str) else id_col
    rows = documents.select(key.alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return keep(rows.mapInArrow(_scan(new_key()), SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString())), "mentions")


def bootstrap(scanned: DataFrame, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """The pattern-instance graph, scored: (accepted instances by kind, patterns by kind with confidence)."""
    mentions = scanned.select(F.explode("mentions").alias("m")).select("m.*")
    with scratch(scanned.sparkSession, "bootstrap") as keep:
        edges = mentions.select("instance", "kind", "shapes", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance", "kind").agg(F.max("shapes").alias("shapes"))
        edges = keep(edges, "edges")
        seeded = edges.where("kind >= 0").groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= support)
        graph = edges.withColumnRenamed("kind", "own").join(seeded, "pattern").where("own >= 0 OR (shapes & shiftleft(1, kind)) != 0")
        graph = keep(graph.select("pattern", "kind", "instance", "own", F.when(F.col("own") >= 0, (F.col("own") == F.col("kind")).cast("double")).otherwise(F.lit(0.0)).alias("score")), "graph")
        weight = F.when(F.col("own") >= 0, F.lit(1.0)).otherwise(F.col("score"))
        grew = True
        while grew:
            # one half is added to the count: a pattern seen a few times is never certain
            patterns = graph.groupBy("pattern", "kind").agg((F.sum("score") / (F.sum(weight) + 0.5)).alias("confidence"))
            strong = patterns.where(F.col("confidence") >= CONFIDENT)
            unseen = graph.where("own < 0").drop("score").join(strong, ["pattern", "kind"])
            scores = unseen.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("found"))
            joined = graph.join(scores, ["instance", "kind"], "left")
            score = F.when(F.col("own") < 0, F.coalesce("found", F.lit(0.0))).otherwise(F.col("score"))
            scored = keep(joined.select("pattern", "kind", "instance", "own", score.alias("score"), (score > F.col("score") + SETTLED).alias("grew")), "graph")
            graph, grew = scored.drop("grew"), not scored.where("grew").isEmpty()
        accepted = graph.where((F.col("own") < 0) & (F.col("score") >= ACCEPT)).groupBy("instance", "kind").agg(F.max("score").alias("score"))
        return stored(accepted, "accepted"), stored(patterns, "patterns")


def _named(spans: Column) -> Column:
    """kind:start:end, by start and then kind, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["first"].alias("first"), s["kind"].alias("kind"), s["last"].alias("last"))))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(ordered, lambda s: F.concat_ws(":", kinds[s["kind"]], s["first"], s["last"])))


def find(documents: DataFrame, id_col: str | Column = "doc_id", text_col: str = "text", keep=stored) -> DataFrame:
    """Every row's base spans and all spans (``all``), each by start."""
    scanned = scan(documents, id_col, text_col, keep)
    accepted, _ = bootstrap(scanned)
    open_ = scanned.select("uid", F.explode("mentions").alias("m")).where("m.kind < 0").select("uid", "m.first", "m.last", "m.instance", "m.shapes")
    added = open_.join(accepted, "instance").where("(shapes & shiftleft(1, kind)) != 0")
    # of spans of a kind that lie within each other the longest stays
    wider = Window.partitionBy("uid", "kind").orderBy("first", F.desc("last")).rowsBetween(Window.unboundedPreceding, -1)
    added = added.withColumn("reach", F.max("last").over(wider)).where("reach IS NULL OR reach < last")
    added = added.groupBy("uid").agg(F.collect_list(F.struct("first", "last", "kind")).alias("more"))
    rows = scanned.select("uid", "doc_id", "base").join(added, "uid", "left")
    return rows.select("doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more")).alias("all"))


def report(documents: DataFrame) -> DataFrame:
    """The contract's columns for every row of ``documents``."""
    found = find(documents)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_named(F.col("base")), 256).alias("base_sha256"), _named(F.col("all")).alias("spans"))


@F.arrow_udf(T.StringType())
def _redacted(text: pa.Array, spans: pa.Array) -> pa.Array:
    texts = []
    for value, cell in zip(text, spans, strict=True):
        whole, parts, at = value.as_py(), [], 0
        if whole is None:
            texts.append(None)
            continue
        for s in sorted(cell.as_py(), key=lambda s: (s["first"], s["kind"], s["last"])):
            if s["first"] >= at:
                parts += [whole[at : s["first"]], f"[{KINDS[s['kind']].upper()}]"]
            at = max(at, s["last"])
        texts.append("".join([*parts, whole[at:]]))
    return pa.array(texts, pa.string())


def redact(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """``documents`` with each span replaced by its kind in brackets; all rows and columns stay.

    Spans depend on the text and the corpus alone, so they are looked up by what names the text.
    """
    key, spans = fresh(documents, "key", "spans")
    with scratch(documents.sparkSession, "redact") as keep:
        found = find(documents, content_key(text_col), text_col, keep).where(F.size("all") > 0)
        found = stored(found.groupBy(F.col("doc_id").alias(key)).agg(F.first("all").alias(spans)), "spans")
    size = found.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size(spans)), F.lit(0)).alias("spans")).first()
    few = size["rows"] <= FEW_ROWS and size["spans"] <= FEW_SPANS
    marked = documents.withColumn(key, content_key(text_col)).join(F.broadcast(found) if few else found, key, "left")
    # only texts with spans are sent to Python; the others pass as null
    changed = _redacted(F.when(F.col(spans).isNotNull(), F.col(text_col)), F.col(spans))
    return marked.withColumn(text_col, F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(changed)).select(*documents.columns)
