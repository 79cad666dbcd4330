"""The trie of conversation prefixes against plain dictionaries."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import pytest

from pixelmill.llm import prefixes, sql

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        whole[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members = collections.defaultdict(list)
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = collections.Counter(n[:-1] for n in members if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            saved[n[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
    out = []
    for n, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(n))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def made(n, seed=1, most=6):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), 1000, 1001, 1021, -5, -20, 10**12]:
        for t in range(rng.randint(0, most)):
            rows.append((c, rng.choice([t, t, None, 1]), rng.choice(["user", "assistant", None]), rng.choice(["hi there", "", None, "a b  c", "wörd\t日本"])))
    rng.shuffle(rows)
    return [*rows, *rows[:9], (None, 1, "user", "lost"), (40, 0, "user", "hi there"), (40, 0, "user", "hi there")]


def got(spark, rows, **more):
    found = prefixes.trie(prefixes.rebuilt(prefixes.turns(spark.createDataFrame(rows, SCHEMA))), **more).select(*COLUMNS)
    return sorted(str(tuple(r)) for r in found.collect())


@pytest.mark.parametrize(("shard", "long"), [(4096, 1 << 16), (3, 1 << 16), (1, 2)])
def test_nodes(spark, shard, long):
    rows = made(130)
    assert got(spark, rows, shard=shard, long=long) == plain(rows)


def test_one_opening_for_all_and_one_very_long_conversation(spark):
    rows = [(c, 0, "user", "hello") for c in range(0, 900, 20)] + [(c, 1, "user", f"q {c % 3}") for c in range(900)] + [(7, t, "user", f"t{t % 4}") for t in range(90)]
    assert got(spark, rows, shard=64, long=20) == plain(rows)


def test_empty_and_extra_columns(spark):
    assert prefixes.report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefixes.report(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(1, 0, "u", "x", "n", 5), (21, 0, "u", "x", "n", 6)], SCHEMA + ", node string, words int")
    assert prefixes.report(rows).columns == COLUMNS and prefixes.report(rows).where("depth = 0").first().n_convs == 2


def test_turnless_conversations_are_members_of_the_root(spark):
    rows = [(c, 0, "u", "only turn") for c in range(1, 20)]  # no first conversation to take turns from
    assert got(spark, rows) == plain(rows)
    assert prefixes.report(spark.createDataFrame([(2, 0, "u", "x")], SCHEMA)).first().ends_sha256 == (hashlib.sha256(b"2").hexdigest() if zlib.crc32(b"2") % 4 else hashlib.sha256(b"").hexdigest())


def test_children_are_what_postings_leave():
    paths = []
    for conv, turns in ((5, b"ab"), (3, b"ab"), (9, b"ac"), (4, b"")):
        path = prefixes._Path(conv)
        path.turns, path.words = [bytes([x]) for x in turns], [1] * len(turns)
        paths.append(path)
    nodes = {n[2]: [] for n in prefixes.walk(paths)}
    for n in prefixes.walk(paths):
        nodes[n[2]].append((n[4], n[5], sorted(n[6].tolist()), sorted(n[7].tolist())))
    assert nodes[0] == [(4, 3, [], [4])] and nodes[1] == [(3, 3, [3, 5, 9], [])] and sorted(nodes[2]) == [(1, 9, [9], [9]), (2, 3, [3, 5], [3, 5])]


def test_duckdb_agrees(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = sorted(str(tuple(r)) for r in con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({sql.PREFIXES})").fetchall())
    assert sorted(str(tuple(r)) for r in prefixes.report(spark.read.parquet(f"{sf}/conversations.parquet")).select(*COLUMNS).collect()) == want
