import hashlib
import re
from collections import Counter
from dataclasses import replace

import pytest
from tessera.llm.secret_scan import RULES, RULES_BEFORE, Ledger, query, scan

KEY = "AKIA" + "ABCDEFGH12345678"
TOKEN = 'token = "' + "0a1b2c3d" * 5 + '"'
GIT = "ghp_" + "a1B2" * 9
SCHEMA = "path string, version long, text string, blob string, n int, todo string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain(versions, rules=RULES):
    out = set()
    for path, version, text, *_ in versions:
        for r in rules:
            for secret, n in Counter(re.findall(r.pattern, text or "")).items():
                out.add((path, version, sha(text), r.rule_id, r.rule_version, sha(secret), n))
    return out


V1 = [
    ("a", 1, f"key {KEY} and {KEY}", "x", 1, None),
    ("a", 2, "nothing", "x", 1, None),
    ("b", 1, f"key {KEY} and {KEY}", "x", 1, None),
    ("b", 1, f"key {KEY} and {KEY}", "x", 1, None),
    (None, None, f"{TOKEN} {GIT}", None, None, None),
    ("c", 1, None, None, None, None),
    ("c", 2, "", None, None, None),
    ("long", 1, "word " * 300_000 + GIT, None, None, None),
]
TWO = [
    # two texts under one path and version, of which one has copies elsewhere, and the same with null versions
    ("p", 1, f"one {KEY}", "x", 1, "t"),
    ("p", 1, f"two {GIT} {GIT}", "x", 1, "t"),
    ("q", None, f"one {KEY}", "x", 1, "t"),
    ("q", None, f"three {TOKEN}", "x", 1, "t"),
    *[(f"copy{i}", i, "clean", None, i, None) for i in range(6)],
    # one version three times, with other values in the columns that don't matter
    *[("r", 5, f"four {GIT} {GIT}", "x", i, str(i)) for i in range(3)],
]
V2 = [*V1, ("d", 9, f"key {KEY} and {KEY}", None, None, None), ("e", 1, f"new {GIT}", None, None, None)]


@pytest.mark.parametrize("limit", [500_000, 1, 0])
def test_findings(spark, limit):
    report, pairs, new = scan(spark.createDataFrame(V1, SCHEMA), broadcast_rows=limit)
    rows = report.collect()
    assert set(map(tuple, rows)) == plain(V1) and len(rows) == len(plain(V1))
    assert pairs.count() == 5 * len(RULES)


@pytest.mark.parametrize("limit", [500_000, 3, 0])
@pytest.mark.parametrize("copies", [6, 0])
def test_texts_that_share_path_and_version(spark, limit, copies):
    rows = [r for r in TWO if copies or not r[0].startswith("copy")]
    got = scan(spark.createDataFrame(rows, SCHEMA), broadcast_rows=limit)[0].collect()
    assert set(map(tuple, got)) == plain(rows) and len(got) == len(plain(rows))
    # half of it known, under older rules
    _, pairs, found = scan(spark.createDataFrame(rows[:3], SCHEMA), RULES_BEFORE, broadcast_rows=limit)
    got = scan(spark.createDataFrame(rows, SCHEMA), RULES, pairs, found, broadcast_rows=limit)[0].collect()
    assert set(map(tuple, got)) == plain(rows) and len(got) == len(plain(rows))


def test_query_against_brute_force(spark, sf):
    rows = [(f"{r.source}/{r.lang}", r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert set(map(tuple, query(spark, sf).select("path", "doc_id", "blob", "rule_id", "rule_version", "secret_sha256", "n").collect())) == plain(rows)


def test_a_long_secret_is_taken_whole(spark):
    one, two = ("token = " + "k" * 200 + x for x in "ab")
    got = scan(spark.createDataFrame([("a", 1, one, "", 1, ""), ("a", 2, two, "", 1, "")], SCHEMA))[0].collect()
    assert len({r.secret_sha256 for r in got}) == 2


def test_ledger(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    assert set(map(tuple, ledger.run(spark.createDataFrame(V1, SCHEMA)).collect())) == plain(V1)
    before = ledger.pairs().count()
    # the copy in d is a blob already met; only e's is new
    assert set(map(tuple, ledger.run(spark.createDataFrame(V2, SCHEMA)).collect())) == plain(V2)
    assert ledger.pairs().count() == before + len(RULES)
    # one rule changes: all blobs are scanned for it again, and for nothing else
    rules = tuple(replace(r, rule_version=9, pattern="(nothing)", needle="") if r.rule_id == "slack-token" else r for r in RULES)
    assert set(map(tuple, ledger.run(spark.createDataFrame(V2, SCHEMA), rules).collect())) == plain(V2, rules)
    assert ledger.pairs().count() == before + len(RULES) + 6


def test_empty(spark):
    report, pairs, _ = scan(spark.createDataFrame([], SCHEMA))
    assert report.collect() == [] and pairs.collect() == []
