"""The operators against brute force, DuckDB, round trips and held-out labels."""

import base64
import collections
import hashlib
import itertools
import re
import struct

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from pixelmill.llm import components as cc
from pixelmill.llm import decontamination as dc
from pixelmill.llm import licenses, milclassifier, minhash, pieces, pii, quality, registry, secrets, urls, warc
from pixelmill.llm.words import ALNUM, LOWER, fingerprints, texts_of

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TABLES = "documents pages benchmark labels".split()


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def plain(value):
    if value is None or (isinstance(value, float) and value != value) or type(value).__name__ == "NAType":
        return None
    return value.item() if hasattr(value, "item") else value


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_duckdb(spark, sf, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    ours, theirs = registry.QUERIES[name](spark, sf).toPandas(), c.execute(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and rows_of(ours) == rows_of(theirs)


def test_fingerprints_tell_words_apart():
    texts = ["Ab cd", None, "", "ab  CD é", "cd ab"]
    data, offsets = texts_of(pa.array(texts))
    _, _, found, counts = fingerprints(data, offsets, ALNUM, LOWER)
    assert counts.tolist() == [2, 0, 0, 3, 2]
    a, b, c, d, e, f, g = found.tolist()
    assert a == c == g and b == d == f and len({a, b, e}) == 3


# --- WARC


def test_warc_roles_and_digests(spark, tmp_path):
    rows = [(1, "http://a/%\r\n", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 300_000), (5, "u", "x" * 300_000), (None, "u", "same"), (6, "é", "日本")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))
    found = warc.round_trip(pages).toPandas()
    assert found.error.isna().all() and len(found) == len(rows)
    got = {(plain(r.page_id), r.payload_bytes): r for r in found.itertuples()}
    assert got[2, 4].record_type == "response" and got[1, 4].record_type == "revisit" and got[1, 4].refers_to == 2
    assert got[1, 4].target_uri == "http://a/%\r\n" and got[2, 4].target_uri is None
    assert got[3, 0].refers_to == 4 and (None, 4) in got
    assert (found[found.page_id == 5].record_type == "response").all()
    assert got[6, 6].payload_digest == base64.b32encode(hashlib.sha1("日本".encode()).digest()).decode()
    warc.write(pages, str(tmp_path / "w"))
    back = warc.read(spark, str(tmp_path / "w")).where("page_id = 6").first()
    assert bytes(back.payload).decode() == "日本"
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id bigint, url string, html string")
    kinds = {r.page_id: r.record_type for r in warc.roles(pages, least_bytes=3).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_warc_roles_by_page_are_those_of_the_broadcast(spark, monkeypatch):
    rows = [(i, "u", "boilerplate") for i in range(200)] + [(None, f"u{i}", "boilerplate") for i in range(20)] + [(None, None, None)] * 3
    rows += [(5, "u", "other"), (300, None, "other"), (300, None, "other"), (7, "v", ""), (9, "w", "alone")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    names = ["page_id", "url", "html", "record_type", "refers_to"]
    want = rows_of(warc.roles(pages).select(*names).toPandas())
    monkeypatch.setattr(warc, "SMALL", 0)
    found = warc.roles(pages)
    assert rows_of(found.select(*names).toPandas()) == want and len(want) == len(rows)
    assert found.where("record_type = 'response'").count() == 5  # 199, both rows of 300, the largest id of the empty payload, the one alone


def test_warc_reader_loads_dictionaries_and_refuses_damage():
    payloads = [f"<html><body>page {i} of the same site, with the same words</body></html>".encode() * 3 for i in range(300)]
    trained = zstandard.train_dictionary(4096, payloads)
    record = warc._record(7, "http://x/", payloads[0], hashlib.sha1(payloads[0]).digest(), "response", None)
    frame = zstandard.ZstdCompressor(dict_data=trained, write_checksum=True).compress(record)
    for raw in (trained.as_bytes(), zstandard.compress(trained.as_bytes())):
        archive = struct.pack("<II", warc.DICTIONARY_MAGIC, len(raw)) + raw + frame + warc.SEPARATOR.encode() + frame
        found = list(warc.records(archive))
        assert [e for _, e in found] == [None, None] and warc.parse(found[1][0])["page_id"] == 7
    assert list(warc.records(frame))[0][1]  # without its dictionary
    assert list(warc.records(archive[:-3]))[-1][1]
    with pytest.raises(ValueError):
        warc.parse(record.replace(b"page 0", b"page 9"))
    with pytest.raises(ValueError):
        warc.parse(record[:-6] + b"\r\n\r\n")


# --- personal data


def brute_pii(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), m.end(), 0))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), m.end(), 2))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out)


def test_pii_base_equals_plain_regexes(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rng = np.random.default_rng(4)
    parts = ["a@b.c", "@", "x.y@z", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "4111111111111111", "4111-1111 1111 1111", "+1 (234) 567-8901", "+12", " ", "-", ".", "é", "9" * 25, "..@..", "a@b@c.d.e", "%+-@a-b.c-d", "0001.2.3.004"]
    texts += ["".join(rng.choice(parts, rng.integers(1, 12))) for _ in range(3000)]
    for text in texts:
        assert pii.find_base(text) == brute_pii(text), text


def test_pii_counts_and_digests(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.report(docs).collect():
        base = brute_pii(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, _, k in base) for i in range(4)]
        named = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in sorted(base, key=lambda s: (s[0], s[2])))
        assert r.base_sha256 == hashlib.sha256(named.encode()).hexdigest() and set(named.split(",")) <= set(r.spans.split(","))


def test_pii_learns_contexts(spark):
    seeds = [(i, f"dear all reach my desk phone +1 (201) 555-{1000 + 37 * i} thanks and regards number {i}") for i in range(12)]
    rows = [*seeds, (50, "dear all reach my desk phone 555-867-5309 thanks and regards"), (51, "the part number 555-867-5310 is in stock"), (52, None)]
    found = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[0].spans.startswith("phone:") and found[0].n_phone == 1
    at = rows[12][1].index("555")
    assert found[50].n_phone == 0 and found[50].spans == f"phone:{at}:{at + 12}"
    assert found[51].spans == "" and found[52].spans == ""
    assert found[50].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_pii_learns_contexts_with_more_unseen_than_seeds(spark):
    rows = [(i, f"dear all reach my desk phone +1 (201) 555-{1000 + 37 * i} thanks and regards") for i in range(12)]
    rows += [(100 + i, f"dear all reach my desk phone 555-867-{5000 + i} thanks and regards") for i in range(40)]
    # a context of several kinds teaches nothing
    rows += [(300 + i, f"mixed field {x} follows") for i, x in enumerate(["+1 (201) 555-1000", "+1 (201) 555-1037", "+1 (201) 555-1074", "a@b.cd", "10.0.0.1", "c@d.ef", "555-867-9999"])]
    found = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    at = rows[12][1].index("555")
    assert {found[100 + i] for i in range(40)} == {f"phone:{at}:{at + 12}"} and found[306] == ""


def test_pii_candidates_of_several_groups():
    def named(text):
        return {text[a:b] for a, b, _ in pii._candidates(text, pii.find_base(text))}

    for one in ["(201) 555-1000", "020 7946 0958", "4111 1111 1111 1112", "201.555 1000", "555 (201)-1000"]:
        assert one in named(f"call {one}, or write") and one in named(one) and one in named(f"1234567890123456789 {one} 1234567890123456789")
    assert named("a 12 34 b, 555  1000, x555 1000y, 1 2 3 4 5 6") == set()
    assert not any(" " in x for x in named("+1 (201) 555-1000")) and named("a" * 80 + "@host") == {"a" * 80 + "@host"}


def test_pii_learns_identifiers_of_several_groups(spark):
    rows = [(i, f"dear all reach my desk phone +1 (201) 555-{1000 + 37 * i} thanks and regards") for i in range(12)]
    rows += [(100, "reach my desk phone (201) 555-1000 thanks"), (101, "reach my desk phone 020 7946 0958 thanks"), (102, "the parts 020 7946 0958 are here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert found[100] == "phone:20:34" and found[101] == "phone:20:33"
    texts = {r.doc_id: r.text for r in pii.redact(docs.where("doc_id <> 102")).collect()}
    assert texts[100] == texts[101] == "reach my desk phone [PHONE] thanks"


def test_pii_redaction_keeps_rows_and_columns(spark, odd, none):
    rows = odd.unionByName(spark.createDataFrame([(90, "mail me at a.b@c.de or 10.0.0.1 now", "en", "s", 1, "k")], odd.schema))
    out = pii.redact(rows)
    assert out.columns == rows.columns and out.count() == rows.count()
    assert out.where("doc_id = 90").first().text == "mail me at [EMAIL] or [IP] now"
    assert pii.report(none).count() == 0 and pii.redact(none).count() == 0


# --- near duplicates


def shingles(text):
    w = words(text)
    n = min(5, len(w))
    return collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else None


def probability_jaccard(a, b):
    every = set(a) | set(b)
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in every) for d in a if d in b)


def test_similarity_is_probability_jaccard():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = ({int(k): int(v) for k, v in zip(rng.choice(30, 12, False), rng.integers(1, 5, 12), strict=True)} for _ in range(2))
        packed = [(np.array(sorted(x), dtype=np.uint64), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        assert minhash.similarity(*packed) == pytest.approx(probability_jaccard(a, b))


def test_signatures_agree_as_often_as_they_should():
    rng = np.random.default_rng(6)
    elements = rng.integers(0, 2**63, 60).astype(np.uint64)
    wa, wb = np.ones(60), np.ones(60)
    wa[:10], wb[50:] = 0, 0
    wa[20:25], wb[20:25] = 4, 2
    a, b = wa > 0, wb > 0
    row = np.concatenate([np.zeros(a.sum(), int), np.ones(b.sum(), int)])
    found = minhash.signatures(row, np.concatenate([elements[a], elements[b]]), np.concatenate([wa[a], wb[b]]), 2, 4096)
    want = probability_jaccard({i: w for i, w in enumerate(wa) if w}, {i: w for i, w in enumerate(wb) if w})
    assert abs((found[0] == found[1]).mean() - want) < 0.04


def brute_groups(texts):
    every = {d: shingles(t) for d, t in texts.items()}
    boss = {d: d for d in texts}

    def top(d):
        while boss[d] != d:
            d = boss[d]
        return d

    for a, b in itertools.combinations(texts, 2):
        x, y = every[a], every[b]
        alike = (texts[a] or "") == (texts[b] or "") if x is None or y is None else len(set(x) & set(y)) * 2 > min(len(x), len(y)) and probability_jaccard(x, y) >= 0.8
        if alike:
            boss[max(top(a), top(b))] = min(top(a), top(b))
    return {d: top(d) for d in texts}


def near_copies(seed, groups, copies, edits):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(4000)]
    texts = []
    for _ in range(groups):
        base = list(rng.choice(vocabulary, 120))
        for _ in range(copies):
            own = list(base)
            for at in rng.choice(120, rng.integers(0, edits + 1), False):
                own[at] = str(rng.choice(vocabulary))
            texts.append(" ".join(own))
    return dict(enumerate(texts))


@pytest.mark.parametrize("block", [512, 7])
def test_groups_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = near_copies(7, 3, 30, 5) | {200: None, 201: "", 202: "!!", 203: "!!", 204: "a b", 205: "A, b.", 206: "a b c"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumn("keys", F.lit("clash"))
    found = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert found == brute_groups(texts)


def test_near_duplicates_of_odd_rows(spark, odd, none):
    found = minhash.near_duplicates(odd)
    assert found.count() == odd.count() and found.where("keep").groupBy("class_id", "class_size").count().agg(F.max("count")).first()[0] <= 2
    kept = minhash.deduplicated(odd)
    assert kept.columns == odd.columns and kept.count() == found.where("keep").count()
    assert kept.where("text = 'word'").count() == 1 and kept.where("text is null or text = ''").count() == 1
    assert minhash.near_duplicates(none).count() == 0 and minhash.deduplicated(none).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101 + i) for i in range(30)] + [(7, 7), (None, 3), (200, 201)]
    found = {r.id: r.component for r in cc.components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert {found[i] for i in range(61)} == {0} and {found[100 + i] for i in range(31)} == {100} and found[201] == 200 and len(found) == 94


def test_components_of_long_chains_in_random_order(spark):
    names = np.random.default_rng(11).permutation(100_000)[:6000].reshape(3, 2000)
    edges = [(int(a), int(b)) for chain in names for a, b in itertools.pairwise(chain)]
    want = {int(i): int(chain.min()) for chain in names for i in chain}
    assert {r.id: r.component for r in cc.components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()} == want
    names = [f"{i:04d}" for i in range(500)]
    found = cc.components(spark.createDataFrame(list(itertools.pairwise(names)), "src string, dst string"))
    assert found.count() == 500 and {r.component for r in found.collect()} == {"0000"}


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(12)
    edges = [(a, b) for a, b in rng.integers(0, 900, (600, 2)).tolist()]
    boss = {x: x for e in edges for x in e}
    for _ in range(900):
        for a, b in edges:
            boss[a] = boss[b] = min(boss[a], boss[b])
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    frame = spark.createDataFrame(edges, "src bigint, dst bigint")
    assert {r.id: r.component for r in cc.components(frame).collect()} == {x: boss[x] for x in nodes}
    assert cc.components(frame.limit(0)).collect() == []


# --- quality


def test_ledger_of_odd_rows(spark, odd, none):
    out = quality.with_ledger(odd, out="ledger2")
    assert out.columns == [*odd.columns, "ledger2"] and out.count() == odd.count()
    got = {r.text: r.ledger2 for r in out.where("text is not null").collect()}
    assert got["!!! ###"].n_symbols == 3 and got["long " * 30_000].n_repeat_words == 30_000 and got["word"].n_words == 1
    assert quality.assess(none).count() == 0


def test_ablation_counts_bits(spark):
    masks = [0, 1, 1, 2, 3, 4, 6, 0]
    found = {r.rule: (r.fails, r.fails_alone, r.rejected_without) for r in quality.ablation(spark.createDataFrame([(m,) for m in masks], "mask bigint"), "base").collect()}
    assert found == {"too_short": (3, 2, 3), "repeats_itself": (3, 2, 3)}


# --- licenses


def brute_licenses(text, rules):
    norm = f" {' '.join(words(text))} "
    hits = []
    for i, label, priority, confidence, _, _, regex, base in rules:
        for m in re.finditer(f"(?<= )(?:{regex})(?= )", norm):
            first = norm[: m.start()].count(" ") - 1
            hits.append((first, -(first + m[0].count(" ")), -priority, i, label, base, confidence))
    hits.sort()
    kept = [h for k, h in enumerate(hits) if h[5] or not any(g[2] <= h[2] and -g[1] >= -h[1] for g in hits[:k])]
    base = [h for h in hits if h[5]]
    return (
        len(words(text)), len(base), min((h[0] for h in base), default=None), max((h[0] for h in base), default=None), ",".join(sorted({h[4] for h in base})),
        ",".join(sorted({h[4] for h in kept})), max((h[6] for h in kept), default=0.0),
    )


def test_licenses_equal_brute_force(spark, sf, odd, none):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["MIT License, mit-license MIT LICENSE", "licensed under the MIT license", "SPDX-License-Identifier: GPL-2.0-or-later", "Released under the Apache License, Version 2.0.", "GNU General Public License v3 license"]
    texts += [r.text for r in odd.collect()] + ["mit license " * 400]
    rules = licenses.rules()
    assert len(rules) > 200
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("words", F.lit(1))
    for r in licenses.report(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute_licenses(texts[r.doc_id], rules), texts[r.doc_id][:80]
    assert licenses.report(none).count() == 0


def matches_of(tree):
    """All strings of a parsed regex of literals, groups, options, alternatives and small sets."""
    out = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "IN":
            more = [chr(x) for _, x in arg]
        elif name == "BRANCH":
            more = [m for t in arg[1] for m in matches_of(t)]
        elif name == "MAX_REPEAT":
            assert arg[:2] == (0, 1)
            more = ["", *matches_of(arg[2])]
        else:
            assert name == "SUBPATTERN"
            more = matches_of(arg[-1])
        out = [a + b for a in out for b in more]
    return out


def test_every_match_of_a_license_rule_holds_its_keywords():
    for _, _, _, _, own, further, regex, _ in licenses.rules():
        for match in matches_of(re._parser.parse(regex)):
            assert own in match.split(" ") and set(further) & set(match.split(" ")), (regex, match)


def test_keyword_regexes_find_the_same_words():
    every = sorted({w for r in licenses.rules() for w in [r[4], *r[5]]})
    for word in [*every, "mi", "mitt", "license2", "", "gplv", "licens"]:
        assert (re.fullmatch(licenses.any_of(every), word) is not None) == (word in every), word


def test_licenses_equal_brute_force_without_keywords(spark):
    rules = licenses.rules()
    want = {
        "Released under the FreeBSD license.": "bsd-2-clause", "licensed under the European Union Public License v1.2": "eupl-1.2", "a GPLv1 license": "gpl-1.0", "GPLv2 license": "gpl-2.0", "licensed under GPLv3": "gpl-3.0",
        "under the LGPLv3 license": "lgpl-3.0", "released under the AGPLv3": "agpl-3.0", "LGPLv2.1 license": "lgpl-2.1", "licensed under the SIL Open Font 1.1 license": "ofl-1.1",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit", "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    }
    frame = spark.createDataFrame([(i, text) for i, text in enumerate(want)], "doc_id bigint, text string")
    for r in licenses.report(frame).collect():
        text = list(want)[r.doc_id]
        norm = f" {' '.join(words(text))} "
        ungated = {label for _, label, _, _, _, _, regex, _ in rules if re.search(f"(?<= )(?:{regex})(?= )", norm)}
        assert want[text] in r.labels.split(",") and want[text] in ungated and set(r.labels.split(",")) <= ungated, (text, r.labels)


# --- URLs


def test_aliases_share_decisions(spark):
    def canonical(u):
        return f'<html><LINK href="{u}" REL=canonical></html>'

    rows = [
        (1, "http://b.example.org/es/1", None), (2, "http://x.net/p", canonical("http://b.example.org/es/1#top")), (3, "https://y.net/q?a=1&b=2", '<meta http-equiv="refresh" content="0; url=http://x.net/p">'),
        (4, "http://z.net/", canonical("https://y.net/q?a=1&amp;b=2")), (5, "http://w.net/a/b", canonical("c")), (6, "http://w.net/a/c", canonical("/d")), (7, "http://w.net/d", canonical("http://ok.org/x")),
        (8, None, canonical("http://b.example.org/es/1")), (9, "nothing", None), (10, "http://q.com/de/1", canonical("http://ok.org/x")), (11, "HTTP://EXAMPLE.ORG/en/12?x#y", ""), (1, "http://b.example.org/es/1", None),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("clash"))
    found = {r.page_id: (r.rule, r.verdict) for r in urls.report(pages).collect()}
    assert found[1] == ("example.org/es/", "block") and found[2] == (None, "block") and found[3][1] == "block" and found[4][1] == "block"
    assert [found[i][1] for i in (5, 6, 7)] == ["allow"] * 3 and found[10] == ("com/de/", "block")
    assert found[8] == (None, "allow") and found[9] == (None, "allow") and found[11] == ("example.org/en/1", "block")
    assert urls.report(pages.limit(0)).count() == 0 and urls.report(pages).count() == len(rows)


def test_resolution_and_verdicts_equal_duckdb(spark):
    targets = ["/p?ref=http://b.example.org/es/1", "?page=2", "../f", "../../../es/1", "./g/./h/..", "mailto:a@b.c", "javascript:go()", "data:x", "http:relative", "HTTPS://b.example.org/es/1?q#f", "//b.example.org/es/1", "c", "/d/../es/9", "#top", "http://b.example.org/a/../es/1", "..", "a//b", "x:y"]
    rows = [(i, f"http://n{i}.net/a/b/c{i}?k={i}", f'<link rel="canonical" href="{t}">') for i, t in enumerate(targets)]
    rows += [(50 + i, f"http://m{i}.net", f'<meta http-equiv=refresh content="0;url={t}">') for i, t in enumerate(targets)]
    rows += [(90, "http://site.net/a", '<link rel=canonical href="/p?ref=http://b.example.org/es/1">'), (91, "http://b.example.org/es/1", ""), (92, "http://b.example.org/es/1?q", None), (93, "http://n2.net/a/f", '<link rel=canonical href="//b.example.org/es/7">')]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    c = duckdb.connect()
    c.register("pages", pages.toPandas())
    ours, theirs = urls.report(pages).toPandas(), c.execute(registry.ORACLES["op6_url_filter"]).df()
    assert rows_of(ours) == rows_of(theirs)
    found = dict(zip(ours.page_id, ours.verdict, strict=True))
    blocked = {i for i, v in found.items() if v == "block"}
    assert blocked == {2, 93, 91, 92, 9, 59, 10, 60, 14, 64}
    at = pages.where("page_id < 50").select("page_id", urls.resolved(F.col("url"), urls.link_targets(F.col("html"))[0]).alias("t")).collect()
    got = {targets[r.page_id]: r.t for r in at}
    assert got["../f"] == "http://n2.net/a/f" and got["./g/./h/.."] == "http://n4.net/a/b/g/" and got["?page=2"] == "http://n1.net/a/b/c1?page=2" and got["mailto:a@b.c"] is None and got["http:relative"] is None
    assert got["../../../es/1"] == "http://n3.net/es/1" and got[".."] == "http://n15.net/a/" and got["a//b"] == "http://n16.net/a/b/a//b"


def test_rule_edges(spark):
    rows = [(1, "http://org/", ""), (2, "http://notorg/", ""), (3, "http://a.org", ""), (4, "://example.org/es/", ""), (5, "x://Example.ORG:80/es/", "")]
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.report(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert found[1] == ("org", "/", "org/", "allow") and found[2][2] is None and found[3] == ("a.org", "", None, "allow")
    assert found[4][2] == "example.org/es/" and found[5] == ("example.org:80", "/es/", None, "allow")


# --- quality classifier


def test_gradients_are_right():
    rng = np.random.default_rng(8)
    x, number, y = rng.normal(size=(9, milclassifier.FEATURES)), np.array([2, 1, 4, 2]), np.array([1.0, 0, 1, 0])
    model = milclassifier.fit(x, number, y, epochs=1)
    cost = np.ones(4)

    def loss(m):
        s = milclassifier._forward(m, x, number)["score"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    grads = milclassifier._gradients(model, milclassifier._forward(model, x, number), y, cost)
    for name in ("W", "V", "U", "w", "c", "b"):
        at = tuple(0 for _ in model[name].shape)
        moved = dict(model)
        moved[name] = model[name].copy()
        moved[name][at] += 1e-6
        assert (loss(moved) - loss(model)) / 1e-6 == pytest.approx(grads[name][at], abs=1e-4)


def test_scores_equal_a_plain_computation(spark, odd):
    """Attention and pooling, passage by passage and number by number."""
    rng = np.random.default_rng(14)
    texts = [" ".join(rng.choice(["alpha", "beta", "Gamma!", "#|", "12"], n)) for n in (1, 30, 64, 65, 700)] + [r.text for r in odd.collect()]
    x, number = milclassifier.encode(pa.array(texts))
    assert number.tolist() == [max(1, -(-len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) // 64)) for t in texts]
    model = milclassifier.fit(x.astype(float), number, np.arange(len(texts)) % 2 * 1.0, epochs=2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in milclassifier.score(docs, model).collect()}
    at = 0
    for i, n in enumerate(number):
        hidden, energy = [], []
        for passage in x[at : at + n]:
            z = [(v - m) / s for v, m, s in zip(passage, model["mean"], model["scale"], strict=True)]
            h = [np.tanh(sum(z[k] * model["W"][k, j] for k in range(len(z))) + model["b"][j]) for j in range(milclassifier.HIDDEN)]
            gate = [np.tanh(sum(h[k] * model["V"][k, j] for k in range(len(h)))) / (1 + np.exp(-sum(h[k] * model["U"][k, j] for k in range(len(h))))) for j in range(milclassifier.ATTENTION)]
            hidden.append(h)
            energy.append(sum(g * w for g, w in zip(gate, model["w"], strict=True)))
        at += n
        weight = [np.exp(e - max(energy)) for e in energy]
        pooled = [sum(w * h[j] for w, h in zip(weight, hidden, strict=True)) / sum(weight) for j in range(milclassifier.HIDDEN)]
        want = 1 / (1 + np.exp(-(sum(p * c for p, c in zip(pooled, model["c"], strict=True)) + model["d"])))
        assert got[i].score == pytest.approx(want, abs=1e-3)
        assert weight[got[i].attention] == pytest.approx(max(weight), rel=1e-3)


def test_the_training_sample_is_bounded_by_whole_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(milclassifier, "fit", lambda x, number, y: seen.append(number.tolist()))
    docs = spark.createDataFrame([(i, "word " * (64 * (1 + i % 5))) for i in range(200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, quality int")
    milclassifier.train(docs, labels)
    milclassifier.train(docs, labels, passages=100)
    assert len(seen[0]) > 100 and 95 < sum(seen[1]) <= 100 and max(seen[1]) == 5


def test_held_out_labels_are_predicted(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    found = milclassifier.report(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (found.predicted == found.quality).mean() > 0.9


def test_scores_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(12)] + [(3, None, 1), (3, 1, 1), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    found = milclassifier.report(odd, labels).toPandas()
    assert len(found) == odd.count() and found.score.between(0, 1).all()
    assert milclassifier.report(none, labels.limit(0)).count() == 0
    assert (milclassifier.report(odd, labels.limit(0)).toPandas().score == 0.5).all()


def test_the_label_of_a_held_out_row_is_never_used(spark):
    import zlib

    docs = spark.createDataFrame([(i, f"text {i} " * 20) for i in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    turned = labels.withColumn("quality", F.when(milclassifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (milclassifier.report(docs, x).orderBy("doc_id").toPandas() for x in (labels, turned))
    assert (a.score == b.score).all() and a.held_out.tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(60)]


# --- secrets


def test_secrets_equal_brute_force(spark, sf, odd, none):
    rng = np.random.default_rng(9)
    parts = ["password", "Token", "api_key", "APIKEY", " = ", ":", '"', "'", "abcdefgh", "AKIA", "ABCDEF0123456789", "0123456789abcdef", " ", "é", "ghp_", "a1" * 20, "secret", "eyJ", ".", "-----BEGIN RSA PRIVATE KEY-----", "xoxb-1234567890"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 14))) for _ in range(600)] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [r.text for r in odd.collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("key", F.lit(1))
    for r in secrets.report(docs).collect():
        want = sorted((m.start(), i, m.end()) for i, (kind, regex, group, least) in enumerate(secrets.RULES) for m in re.finditer(regex if kind != "hex" else "[0-9a-f]+", texts[r.doc_id] or "") if len(m[group]) >= least)
        assert r.spans == ",".join(f"{secrets.RULES[i][0]}:{a}:{b}" for a, i, b in want), texts[r.doc_id][:80]
        base = ",".join(f"{secrets.RULES[i][0]}:{a}:{b}" for a, i, b in want if i < 3)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and [r.n_assign, r.n_access, r.n_hex] == [sum(i == k for _, i, _ in want) for k in range(3)]
    assert secrets.report(none).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query("abc") == [frozenset({"abc"})]
    assert secrets.trigram_query("(abc|xyz)d") == [frozenset({"abc", "bcd"}), frozenset({"xyz", "yzd"})]
    assert secrets.trigram_query("ab?cd") == [frozenset({"abc", "bcd"}), frozenset({"acd"})]
    assert secrets.trigram_query("[0-9a-f]{32,}") == [frozenset()] and secrets.trigram_query("ab.cd") == [frozenset()]
    assert secrets.trigram_query("AK(IA)+x") == [frozenset({"aki", "kia"})]


# --- decontamination


def test_decontamination_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "word"), (2, None), (3, ""), (10, " ".join(f"w{i}" for i in range(20))), (None, "the end"), (11, "a B, c d"), (12, "word")], "item_id bigint, text string")
    rows = odd.unionByName(spark.createDataFrame([(70, "x " * 5 + " ".join(f"W{i}" for i in range(3, 17)) + " y", "en", "s", 1, "k")], odd.schema))
    found = {r.doc_id: r for r in dc.decontaminate(rows, items).collect()}
    assert found[4].items == [1, 12] and found[4].contaminated and found[7].items == [11]
    assert found[70].n_hit == 14 and found[70].items == [10] and found[70].spans[0].first == 5
    assert found[0].n_words == 0 and not found[0].contaminated and found[11].n_hit == 6 and found[11].items == []
    assert found[4].items_sha256 == hashlib.sha256(b"1,12").hexdigest()
    assert dc.decontaminate(none, items).count() == 0 and dc.decontaminate(rows, items.limit(0)).where("contaminated").count() == 0
    left = dc.clean(rows, items)
    assert left.columns == rows.columns and left.where("text = 'word'").count() == 0 and left.where("text is null").count() == 1


def test_blocks_of_the_benchmark_give_the_same(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    index = dc.build_index(docs)
    one, many = (dc.judge(dc.search(index, items, block_chars=n)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256") for n in (4_000_000, 1500))
    assert one.exceptAll(many).count() == 0 == many.exceptAll(one).count() and one.where("n_hit > 0").count() > 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha so beta gamma delta"), (3, "alpha one two three beta gamma delta")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id bigint, text string")
    index = dc.build_index(docs)
    assert {r.doc_id for r in dc.search(index, items).where("size(items) > 0").collect()} == {1}
    assert {r.doc_id for r in dc.search(index, items, slop=1).where("size(items) > 0").collect()} == {1, 2}


# --- pieces


@pytest.fixture(scope="module")
def trellis():
    return pieces.Trellis(pieces.vocabulary())


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL)


def test_ids_equal_the_library(spark, sf, trellis, library):
    rng = np.random.default_rng(10)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    parts = ["the", "ing", " ", "  ", "\n", "é", "日", "▁", "er", "a", "1", "9.5", "!", "😀", "\x00", "Ab"]
    texts += ["".join(rng.choice(parts, rng.integers(0, 60))) for _ in range(1500)] + ["x" * 2000, " " * 300, "thethe" * 400]
    column = pa.array(texts)
    ids, cuts = trellis.encode(column)
    assert trellis.decodes(column, ids, cuts).all()
    for text, a, b in zip(texts, cuts[:-1], cuts[1:], strict=True):
        assert ids[a:b].tolist() == library.encode(text or ""), text[:60]
        assert trellis.decode(ids[a:b]) == (text or "").replace("▁", " ")


def test_streaming_holds_a_bounded_window(trellis, library, monkeypatch):
    text = "unbrokenstreamofletters" * 300 + " and words, 日本語 " * 50 + "x" * 3000
    for size in (1, 37, 5000):
        if size == 1:
            text, whole = text[:3000], text
        ids, held = [], []
        for part in trellis.stream(text[i : i + size] for i in range(0, len(text), size)):
            ids += part.tolist()
            held.append(trellis.held)
        assert ids == library.encode(text) and max(held) <= 8 * trellis.longest
        text = whole
    monkeypatch.setattr(pieces, "BLOCK_BYTES", 1000)
    for t in (text, " " + text, "é" * 5001, "a▁b" * 900, "日本語" * 700):
        found, ok = trellis.encode_long(np.frombuffer(t.encode(), np.uint8))
        assert ok and found.tolist() == library.encode(t)


def test_a_very_long_text_needs_no_memory_in_proportion(trellis):
    import resource

    data = np.frombuffer(b"the quick brown fox, number 12, jumps over one lazy dog again and again\n" * 1_400_000, np.uint8)
    assert len(data) > 100_000_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    n = sum(len(ids) for ids in trellis.stream(data[i : i + pieces.BLOCK_BYTES].tobytes().decode() for i in range(0, len(data), pieces.BLOCK_BYTES)))
    assert n > 20_000_000 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700_000  # KB


def test_models_with_other_rules_are_refused(monkeypatch):
    import sentencepiece

    class Folding(sentencepiece.SentencePieceProcessor):
        def encode(self, texts, **options):
            return super().encode([t.lower() for t in texts], **options)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Folding)
    with pytest.raises(ValueError, match="own rules"):
        pieces.vocabulary()


def test_unigram_objective_equals_brute_force():
    rng = np.random.default_rng(11)
    names = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "ca", "cab"]
    words_ = {"pieces": ["<unk>", *names], "scores": [0.0, *(-rng.random(len(names)) * 5)], "kinds": ["special"] + ["piece"] * len(names), "unknown": 0}
    t = pieces.Trellis(words_, "unigram")
    score = dict(zip(words_["pieces"], words_["scores"], strict=True))
    for _ in range(200):
        text = "".join(rng.choice(list("abc"), rng.integers(1, 30)))
        line, best = "▁" + text, {0: 0.0}
        for end in range(1, len(line) + 1):
            best[end] = max(best[s] + score[line[s:end]] for s in range(end) if line[s:end] in score and s in best)
        for got in (np.concatenate(list(t.stream([text[:5], text[5:]]))), t.encode_all(pa.array([text]))[0]):
            assert sum(score[words_["pieces"][i]] for i in got) == pytest.approx(best[len(line)])
            assert "".join(words_["pieces"][i] for i in got) == line


def test_piece_columns(spark, odd, none):
    out = pieces.with_ids(odd, ids_col="ledger_ids")
    assert out.columns == [*odd.columns, "ledger_ids", "round_trip"] and out.where("not round_trip").count() == 0
    back = pieces.decoded(out, "ledger_ids").where("text is not null").collect()
    assert all(r.decoded == r.text.replace("▁", " ") for r in back)
    assert pieces.report(none).count() == 0
