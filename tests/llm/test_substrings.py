"""Substring dedup against plain loops over all windows."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from pixelmill.llm import sql, substrings


def plain(rows, window=substrings.WINDOW):
    """(n_words, kept words) of each (id, text); a null id comes first."""
    words = [(d if d is not None else -(2**63), re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least, out = {}, []
    for d, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, (d + 1, 0)), (d, i))
    for d, w in words:
        gone, mine = [False] * len(w), set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if least[key][0] < d or key in mine:
                gone[i : i + window] = [True] * window
            mine.add(key)
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return out


def same(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substrings.repeats(docs, **more).collect())
    assert got == sorted((str(d), *x) for (d, _), x in zip(rows, plain(rows, **more), strict=True))


def test_planted_passages(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 3)))
    passages = [[word() for _ in range(n)] for n in (19, 20, 21, 39, 40, 55, 90, 300)]
    rows = []
    for d in range(120):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            parts += p[a : rng.randint(a, len(p))] + [word() for _ in range(rng.randint(0, 30))]
        rows.append((rng.randint(0, 10**6) if d % 3 else -d, " \n".join(parts) + rng.choice(["", " ", "\t"])))
    same(spark, rows)


def test_few_words_repeat_all_the_time(spark):
    rng = random.Random(6)
    same(spark, [(d, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 200)))) for d in range(60)] + [(100, "x " * 500), (101, "x " * 20), (102, "x " * 19)])


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    copy = " ".join(f"w{i}" for i in range(50))
    rows += [(7, copy), (7, copy), (None, copy + " more"), (3, "y " + copy), (50, "z" * 30_000 + " " + copy)]
    same(spark, rows)
    assert substrings.repeats(none).count() == 0


@pytest.mark.parametrize(("window", "gram"), [(8, 3), (20, 2), (200, 6)])
def test_other_windows(spark, window, gram, monkeypatch):
    rng = random.Random(window)
    text = [str(rng.randint(0, 9)) for _ in range(400)]
    rows = [(d, " ".join(text[d * 7 : d * 7 + rng.randint(0, 300)])) for d in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = lambda df, _: df
    if gram * 2 < window:
        got = substrings.parse(substrings._keyed(docs, "doc_id", "text", kept), lambda df, name: substrings.stored(df, name), window, gram)
        assert sorted((r.doc, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == sorted((d, *x) for (d, _), x in zip(rows, plain(rows, window), strict=True))


def test_factors_name_their_source(spark):
    copy = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(copy[:30])), (2, " ".join(copy[20:])), (3, "a b " + " ".join(copy) + " c"), (4, "q " * 5 + " ".join(copy[5:28]))]
    found = {r.doc_id: [(f["first"], f["last"], f["source"]) for f in r.factors] for r in substrings.repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[1] == found[2] == [] and found[4] == [(5, 28, 1)] and found[3][0][0] == 2 and found[3][-1][1:] == (62, 2) and {s for *_, s in found[3]} >= {1, 2}


def test_columns_pass_and_texts_are_cut(spark, odd):
    copy = " ".join(f"w{i}" for i in range(30))
    rows = odd.unionByName(spark.createDataFrame([(70, copy, "en", "s", 1, "k"), (71, f"a  {copy}\nb", "en", "s", 1, "k")], odd.schema))
    left = substrings.deduplicated(rows.withColumnRenamed("ledger", "key"))
    assert left.columns == rows.withColumnRenamed("ledger", "key").columns and left.count() == rows.count()
    found = {r.doc_id: r.text for r in left.collect()}
    assert found[70] == copy and found[71] == "a b" and found[0] is None and found[2] == " \n\t"


def test_leftmost_least():
    rng = np.random.default_rng(3)
    for width in (1, 2, 3, 7, 15):
        values = rng.integers(0, 5, 100)
        want = [i + int(np.argmin(values[i : i + width])) for i in range(101 - width)]
        assert substrings._leftmost_least(values, width).tolist() == want
    assert len(substrings._leftmost_least(np.arange(3), 5)) == 0


def test_duckdb_agrees(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(sql.SUBSTRINGS).fetchall())
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.repeats(docs).collect()) == want and sum(w[2] for w in want) > 0
