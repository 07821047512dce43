import math

import pytest
from pyspark.sql import functions as F
from tessera.llm.lm_score import _parts, gram_costs, gram_counts, lm_score

from tests.llm import cases
from tests.llm.test_ppm import plain_counts, plain_text


def expected(df):
    rows = df.select("doc_id", "text", F.pmod(F.xxhash64("text"), F.lit(2)).alias("half")).collect()
    models = {h: plain_counts([r.text.encode() for r in rows if r.half == h and r.text]) for h in (0, 1)}
    return sorted((r.doc_id or -1, len((r.text or "").encode()), round(plain_text(models[1 - r.half], (r.text or "").encode()), 2)) for r in rows)


@pytest.mark.parametrize("limit", [1 << 27, 150_000])
def test_against_plain_coder(spark, sf, limit):
    df = spark.read.parquet(f"{sf}/documents.parquet").orderBy(F.length("text")).limit(60)
    got = sorted((r.doc_id, r.n_bytes, round(r.bits, 2)) for r in lm_score(df, limit).collect())
    for (a, b, c), (x, y, z) in zip(got, expected(df), strict=True):
        assert (a, b) == (x, y) and math.isclose(c, z, rel_tol=1e-5, abs_tol=0.05)


@pytest.mark.parametrize("limit", [1 << 27, 20_000])
def test_edges(spark, limit):
    df = cases.edges(spark)
    got = lm_score(df, limit).collect()
    assert len(got) == len(cases.EDGES)
    for r in got:
        assert (r.bits_per_byte is None) == (r.n_bytes == 0) and r.bits >= 0
    short = df.where("length(text) < 1000 or text is null")
    for (a, b, c), (x, y, z) in zip(sorted((r.doc_id or -1, r.n_bytes, r.bits) for r in lm_score(short, limit).collect()), expected(short), strict=True):
        assert (a, b) == (x, y) and math.isclose(c, z, rel_tol=1e-4, abs_tol=0.05)


def test_empty_and_single(spark):
    assert lm_score(cases.empty(spark)).collect() == []
    one = spark.createDataFrame(cases.rows(["abc"]), cases.SCHEMA)
    assert lm_score(one).first().bits == 24


def test_counts_cover_every_byte(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert gram_counts(df).agg(F.sum("n")).first()[0] == df.agg(F.sum(F.octet_length("text"))).first()[0]


def test_parts_cover_the_table(spark, sf):
    costs = gram_costs(gram_counts(spark.read.parquet(f"{sf}/documents.parquet").limit(40)))
    parts = _parts(costs, 100_000)
    assert len(parts) > 2 and parts[0][0] == 0 and parts[-1][1] == 65535
    assert all(a[1] + 1 == b[0] for a, b in zip(parts, parts[1:]))
    assert _parts(costs, 1 << 30) == [(0, 65535)]


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("a", "some text", 1), (None, "some text", 2), ("b", None, 3)], "doc_id string, text string, `x.y` int")
    for limit in (1 << 27, 1000):
        assert sorted((r.doc_id or "", r.n_bytes) for r in lm_score(docs, limit).collect()) == [("", 9), ("a", 9), ("b", 0)]
