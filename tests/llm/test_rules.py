import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from stellarate.llm import license, oracles, quality_rules, url_rules
from stellarate.llm.cluster import Scratch
from stellarate.llm.words import NOT_ALPHANUMERIC, WHITE, Words, word_hash
from tests.llm import common

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- words ----


@pytest.mark.parametrize("section", [1 << 20, 64])
def test_words(monkeypatch, section):
    from stellarate.llm import words as module

    monkeypatch.setattr(module, "SECTION", section)
    texts = ["One two  THREE", "", "x", "end", "é À\tb\x0bc", "long" * 100, "", *["ab cd"] * 30]
    blob = "".join(texts).encode()
    offsets = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    for between, pattern in (
        (WHITE, rb"[^\x20\x09-\x0D]+"),
        (NOT_ALPHANUMERIC, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"),
    ):
        got = Words(np.frombuffer(blob, np.uint8), offsets, between, lower=True)
        expected = [re.findall(pattern, t.encode().lower()) for t in texts]
        assert got.counts.tolist() == [len(e) for e in expected]
        assert got.hashes.tolist() == [word_hash(w) for own in expected for w in own]


# ---- quality rules ----


def rule_rows():
    rows = common.awkward()
    line = common.prose(3, 12)
    rows += [(30, "\n".join([line] * 4)), (31, f"{common.prose(4, 200)} {line} {line}"), (32, "# *" * 50)]
    return rows


def base(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    lines = [own for own in text.split("\n") if WORD.search(own)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    n = len(words)
    failed = n < 20 or 100 * len(covered) > 30 * n
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return (n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed)


def buckets(text: str | None) -> list[int]:
    words = [w.encode() for w in WORD.findall(text or "")]
    hashes = np.array([word_hash(w) for w in words], np.uint64)
    pairs = quality_rules.shingle_hashes(hashes, 2)
    return [int(h) >> 48 for h in [*hashes.tolist(), *pairs.tolist()]]


@pytest.mark.parametrize("most_broadcast", [10, 0])
def test_quality_rules(spark, monkeypatch, most_broadcast):
    rows = rule_rows()
    docs = common.docs_of(spark, rows)
    trusted = spark.createDataFrame([(5,), (7,), (7,), (None,), (999,)], "doc_id long")
    ratios = quality_rules.log_ratios(docs, trusted, most_broadcast)
    raw, target = np.ones(1 << 16), np.ones(1 << 16)
    for d, t in rows:
        for b in buckets(t):
            raw[b] += 1
            target[b] += d in (5, 7)
    assert np.allclose(ratios, np.log(target / target.sum()) - np.log(raw / raw.sum()))
    expected = []
    for d, t in rows:
        own = [ratios[b] for b in buckets(t)]
        score = sum(own) / max(len(own), 1)
        counts = base(t)
        expected.append((d, *counts, not counts[-1] and score >= quality_rules.THRESHOLD))
    common.same(quality_rules.judge(docs, trusted).drop("score").collect(), expected)


def test_quality_rules_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert quality_rules.judge(common.docs_of(spark, []), none).collect() == []
    some = quality_rules.judge(common.docs_of(spark, [(1, common.prose(1, 30))]), none).first()
    assert some.kept and some.score == 0


# ---- licences ----


def licence_rows():
    mit = license.PASSAGES[0][1].split()
    return [
        *common.awkward(),
        (40, "Released under the MIT License.\nAPACHE-License: version 2.0"),
        (41, "cc by nc cc-by-nc; CC\nBY NC"),
        (42, "Licensed under the GNU General Public License, version 3."),
        (43, "licensed under the GNU\nGeneral Public License, version 3"),
        (44, "\n".join([" ".join(mit[:9]).title(), " ".join(mit[9:])]) + "\n \nmore"),
        (45, " ".join(mit[:9]) + "\n \n" + " ".join(mit[9:])),
        (46, " ".join(mit[2:]) + " noise " * 20),
        (47, "released under the license of mit, the mit license under which it was released"),
        (48, "the isc license licensed under"),
    ]


def test_licences_equal_the_statement(spark):
    rows = licence_rows()
    got = license.scan(common.docs_of(spark, rows)).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    # the statement joins by doc_id, so rows get ids of their own
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, (_, t) in enumerate(rows)])
    expected = con.execute(oracles.OP1).fetchall()
    assert sum(1 for e in expected if e[6]) >= 7
    common.same(got, [(rows[i][0], *rest) for i, *rest in expected])


def test_licences_of_nothing(spark):
    assert license.scan(common.docs_of(spark, [])).collect() == []


# ---- url rules ----

PAGES = [
    (1, "http://a.net/fr/x", None),
    (2, "https://b.org/y?q=1#z", '<link rel="canonical" href="http://a.net/fr/x">'),
    (3, "http://c.org/", "<meta http-equiv='refresh' content='0; url=https://b.org/y?q=1'>"),
    (4, "http://www.example.com/en/1", '<LINK href=http://c.org/ rel="canonical">'),
    (5, "http://d.org/p/q", '<link rel=canonical href="../x"><link rel="stylesheet" href="s">'),
    (6, "http://e.org/p/q", '<link rel="canonical" href="/en/?a=1&amp;b=2">'),
    (7, "http://e.org/en/?a=1&b=2", '<link rel="canonical" href="//Sub.Example.com/en/9">'),
    (8, None, None),
    (9, "no scheme", '<link rel="canonical" href="http://a.net/fr/x">'),
    (10, "http://E.org/p/q", "x"),
    (10, "http://E.org/p/q", "x"),
    (None, "ftp://x.y.com", ""),
    (12, "http://x.Y.com/", ""),
    (13, "http://h.org/k", '<link rel="canonical" href="http://net/es/">'),
    (14, "", ""),
    (15, "http://net/es", ""),
]


def statement(pages):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    if pages:
        con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    return con.execute(oracles.OP6).fetchall()


def test_url_rules_equal_the_statement(spark):
    rows = [(*p, 1, "n") for p in PAGES]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, node int, host string")
    with Scratch(spark) as scratch:
        got = url_rules.judge(pages, scratch).collect()
    common.same(got, statement(PAGES))
    verdict = {r.page_id: r.verdict for r in got}
    assert [verdict[i] for i in (1, 6, 7, 13)] == ["block"] * 4
    # 1, 2, 3 and 4 are one component, which holds an allowed url
    assert [verdict[i] for i in (2, 3, 4, 5, 8)] == ["allow"] * 5


def test_url_rules_of_nothing_and_redirects(spark):
    schema = "page_id long, url string, html string"
    with Scratch(spark) as scratch:
        assert url_rules.judge(spark.createDataFrame([], schema), scratch).collect() == []
        pages = spark.createDataFrame([(1, "http://a.org/1", None), (2, "http://b.org/", None)], schema)
        moved = spark.createDataFrame(
            [("http://a.org/1", "http://x.net/es/2"), (None, "http://b.org/")], "url string, target string"
        )
        got = url_rules.judge(pages, scratch, redirects=moved).collect()
    assert {r.page_id: r.verdict for r in got} == {1: "block", 2: "allow"}
