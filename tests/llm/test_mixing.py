import itertools
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
import pytest

from tessera.llm.mixing import SEED, T, W, fit, mix, rate, tempered
from tessera.llm.tokens import tokenizer

from tests.llm import cases

sizes = st.dictionaries(st.integers(1, 12), st.integers(1, 4), min_size=1, max_size=4)


def most(held, target):
    return max(s for take in itertools.product(*(range(n + 1) for n in held.values())) if (s := sum(k * l for k, l in zip(take, held, strict=True))) <= target)


@settings(max_examples=150, deadline=None)
@given(sizes, st.integers(0, 80), st.sampled_from([0, 3, 1000]))
def test_fit_stays_in_the_budget(held, target, window):
    lengths, counts = np.array(list(held)), np.array(list(held.values()))
    take = fit(lengths, counts, target, window)
    assert (take >= 0).all() and (take <= counts).all() and (take * lengths).sum() <= target
    # the last stretch is the best that what is left allows
    base = counts * target // (lengths * counts).sum() if target < (lengths * counts).sum() else counts
    if window == 1000:
        rest = {l: int(c - b) for l, c, b in zip(held, counts, base, strict=True)}
        assert (take * lengths).sum() == (base * lengths).sum() + most(rest, target - (base * lengths).sum()) if target < (lengths * counts).sum() else (take == counts).all()


def test_fit_hits_large_budgets_exactly():
    rng = np.random.default_rng(0)
    lengths = np.arange(1, 5000, 3)
    counts = rng.integers(1, 50, len(lengths))
    target = int((lengths * counts).sum() * 0.3) + 1
    assert (fit(lengths, counts, target) * lengths).sum() == target


def shares(have, weights, budget):
    """What each source spends, by taking out those that have too little one by one."""
    left, out = dict(have), {}
    while True:
        whole = sum(weights[s] for s in left)
        poor = [s for s, n in left.items() if n <= weights[s] / whole * (budget - sum(out.values()))]
        if not poor:
            return out | {s: int(weights[s] / whole * (budget - sum(out.values())) + 1e-6) for s in left}
        out |= {s: left.pop(s) for s in poor}
        if not left:
            return out


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(1, 1000), st.integers(1, 9)), min_size=1), st.integers(0, 3000))
def test_unspent_budget_goes_to_the_others(spark, held, budget):
    df = spark.createDataFrame([(n, float(w)) for n, w in held.values()], f"{T} long, {W} double")
    at = rate(df, budget)
    got = {s: int(min(n, at * w + 1e-6)) for s, (n, w) in held.items()}
    assert got == shares({s: n for s, (n, _) in held.items()}, {s: w for s, (_, w) in held.items()}, budget)
    whole = sum(n for n, _ in held.values())
    assert min(budget, whole) - len(held) <= sum(got.values()) <= min(budget, whole)


@pytest.mark.parametrize("span", [1 << 16, 5])
def test_mix_meets_its_targets(spark, span):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 300")
    rows, enc = docs.collect(), tokenizer()
    have, size = defaultdict(int), {}
    for r in rows:
        size[r.doc_id] = len(enc.one(r.text))
        have[r.source] += size[r.doc_id]
    weights = {s: (3 if s == "src1" else 1) for s in have}
    budget = sum(have.values()) // 2
    got = mix(docs, weights, budget, span=span).collect()
    assert set(map(tuple, got)) <= set(map(tuple, rows)) and len({r.doc_id for r in got}) == len(got)
    for s, target in shares(have, weights, budget).items():
        assert 0 <= target - sum(size[r.doc_id] for r in got if r.source == s) <= min(size[r.doc_id] for r in rows if r.source == s)
    # of each length the documents of the smallest hashes
    rank = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.lit(SEED), "doc_id").alias("h")).collect()}
    took = {r.doc_id for r in got}
    groups = defaultdict(list)
    for r in rows:
        groups[r.source, size[r.doc_id]].append(r.doc_id)
    for ids in groups.values():
        ids.sort(key=lambda i: (rank[i], i))
        assert [i in took for i in ids] == sorted((i in took for i in ids), reverse=True)
    assert sorted(r.doc_id for r in mix(docs.repartition(3), weights, budget).collect()) == sorted(took)


def test_edges(spark):
    docs = cases.edges(spark)
    every = mix(docs, budget=10**9)
    assert every.columns == docs.columns
    assert Counter(every.collect()) == Counter(r for r in docs.collect() if r.text)
    assert mix(docs, {"a": 1.0}, budget=10**9).where("source <> 'a' or source is null").collect() == []
    assert {r.doc_id for r in mix(docs, {None: 1.0}, budget=10**9).collect()} == {4}
    assert mix(docs, budget=0).collect() == [] == mix(cases.empty(spark)).collect()
    # rows that share source and doc_id stay together
    both = mix(docs.where("source = 'd'"), budget=10).count()
    assert both in (0, 2)


def test_a_hot_length(spark):
    # nine of ten documents have one length: their order is found in spans
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 10 = 0, 'one two', 'one') as text", "'s' as source", "1 as `a.b`")
    one, many = ({r.doc_id for r in mix(docs, share=0.5, span=s).collect()} for s in (1 << 16, 100))
    assert one == many and sum(2 - (i % 10 > 0) for i in one) == 1650


def test_tempered():
    w = tempered({"a": 100, "b": 400, "c": 0}, 0.5)
    assert np.isclose(w["b"], 2 * w["a"]) and np.isclose(sum(w.values()), 1) and "c" not in w
