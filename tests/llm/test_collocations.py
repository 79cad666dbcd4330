"""Collocations against plain counters, and double arrays against dictionaries."""

import collections
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.llm import collocations, doublearray, sql

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least=10, top=2000):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        longer = collections.Counter()
        for p, a in f.items():
            if len(p) == 3 and a >= least:
                for part in (p[:2], p[1:]):
                    longer[part] = max(longer[part], a)
        found = []
        for p, a in f.items():
            if len(p) > 1 and a >= least and not (len(p) == 2 and longer[p] and 100 * longer[p] >= 50 * a):
                cut = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-cut[0], -a, " ".join(p).encode(), f[p[: cut[1]]], f[p[cut[1] :]]))
        out += [(lang, i, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def made(n, seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "é", "日本", "x-1", "und", "zq", "w" * 70]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", " !", ""]) for _ in range(rng.randint(0, 60)))
    return [(rng.choice(["en", "de", None, "und", ""]), text()) for _ in range(n)] + [("en", None), ("fr", "solo word"), (None, ""), ("en", "the of a " * 40)] + [("es", "uno dos tres cuatro")] * 10


@pytest.mark.parametrize(("shard", "positions", "bits"), [(1 << 20, 1 << 21, 27), (7, 50, 27), (40, 1 << 21, 16)])
def test_phrases(spark, monkeypatch, shard, positions, bits):
    monkeypatch.setattr(collocations, "POSITIONS", positions)
    monkeypatch.setattr(collocations, "BITS", bits)
    rows = made(250, 3)
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("print", F.lit(1)).withColumn("n", F.lit("n"))
    want = plain(rows)
    assert sorted(tuple(r) for r in collocations.collocations(docs, shard=shard).select(*COLUMNS).collect()) == want and len(want) > 60


def test_top_and_empty(spark):
    rows = made(250, 4)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in collocations.collocations(docs, least=3, top=9).select(*COLUMNS).collect()) == plain(rows, 3, 9)
    assert collocations.collocations(docs.limit(0)).count() == 0 and collocations.collocations(docs.where("lang = 'fr'")).count() == 0


def test_scores_are_exact(spark):
    rng = random.Random(1)
    rows = [(a, a + rng.randint(0, a), a + rng.randint(0, a)) for a in (10, 999, 10**6 + 7, 3 * 10**9 + 1, 10**13 + 3) for _ in range(20)]
    got = spark.createDataFrame(rows, "a bigint, l bigint, r bigint").withColumn("s", collocations.score(F.col("a"), F.col("l"), F.col("r"))).collect()
    assert [r.s for r in got] == [1000000 * a * a // (x * y) for a, x, y in rows]


@pytest.mark.parametrize(("n", "alphabet"), [(1, 1), (60, 5), (4000, 90), (30_000, 9000)])
def test_double_arrays(n, alphabet):
    rng = np.random.default_rng(n)
    lengths = rng.integers(1, 5, n)
    codes = np.unique(np.where(np.arange(4) < lengths[:, None], rng.zipf(1.3, (n, 4)) % alphabet, -1), axis=0)
    lengths = (codes >= 0).sum(axis=1)
    trie = doublearray.build(codes, lengths)
    known = {tuple(c[c >= 0]): i for i, c in enumerate(codes.tolist()) for c in [np.array(c)]}
    for k in range(1, 5):
        asked = np.concatenate([codes[lengths == k][:, :k], rng.integers(-1, alphabet + 2, (500, k))])
        assert sorted(doublearray.walk(trie, asked).tolist()) == sorted(known[tuple(q)] for q in asked.tolist() if tuple(q) in known)


def test_duckdb_agrees(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({sql.COLLOCATIONS})").fetchall())
    assert sorted(tuple(r) for r in collocations.collocations(spark.read.parquet(f"{sf}/documents.parquet")).select(*COLUMNS).collect()) == want and want


def test_fingerprints_can_be_undone():
    from pixelmill.llm.words import mix

    x = np.random.default_rng(1).integers(0, 1 << 64, 10_000, dtype=np.uint64)
    assert (collocations._unmixed(mix(x)) == x).all() and (mix(collocations._unmixed(x)) == x).all()
