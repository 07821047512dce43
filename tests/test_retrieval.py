import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.functions.filters import where
from tessera.functions.text import STOP_WORDS
from tessera.operators import context, fusion, retrieval, store, tenancy

CHUNKS = [
    ("1", "Swift programming language is great for building iOS apps"),
    ("2", "Python is popular for data science"),
    ("3", "Programming in general requires logical thinking skills"),
]


def chunks(spark, rows=CHUNKS):
    return spark.createDataFrame(rows, "chunk_id string, content string")


def plain_bm25(rows, query):
    import re

    toks = {i: [w for w in re.split(r"\W+", t.lower()) if len(w) >= 3 and w not in STOP_WORDS] for i, t in rows}
    n, mean = len(rows), max(1, sum(map(len, toks.values())) / max(1, len(rows)))
    out = {}
    for w in [w for w in re.split(r"\W+", query.lower()) if len(w) >= 3 and w not in STOP_WORDS]:
        df = sum(w in t for t in toks.values())
        for i, t in toks.items():
            if tf := t.count(w):
                out[i] = out.get(i, 0) + math.log1p((0.5 + n - df) / (0.5 + df)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
    return out


def test_bm25(spark, tmp_path):
    index = retrieval.BM25.build(chunks(spark))
    for q in ("Swift programming", "programming programming data", "absent", ""):
        got = {r.chunk_id: r.score for r in index.search(q, 10).collect()}
        want = plain_bm25(CHUNKS, q)
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in got)
    assert index.search("Swift programming").first().chunk_id == "1"
    stored = index.write(str(tmp_path))
    for q in ("Swift programming", "programming programming data", "absent", ""):
        got, want = ({r.chunk_id: r.score for r in x.search(q, 10).collect()} for x in (stored, index))
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in got)
    assert stored.search("programming").count() == 2
    assert stored.without(chunks(spark, CHUNKS[:1]).select("chunk_id")).search("programming", 5).count() == 1
    new = retrieval.BM25.build(chunks(spark, [("2", "swift swift")]))
    again = {r.chunk_id: r.score for r in index.replaced(new).search("swift", 5).collect()}
    assert again.keys() == {"1", "2"} and math.isclose(again["2"], plain_bm25([CHUNKS[0], ("2", "swift swift"), CHUNKS[2]], "swift")["2"])
    with pytest.raises(ValueError):
        index.search("x", 0)


@pytest.mark.parametrize("text", ["Café: résumé—naïve x²", "a_b c-d e.f", "中文 字 12ab", "İstanbul the THE", ""])
def test_query_terms_follow_the_tokens(spark, text):
    from tessera.functions.text import tokenize

    for stop in (True, False):
        assert retrieval.query_terms(text, 2, stop) == spark.createDataFrame([(text,)], "t string").select(tokenize(F.col("t"), 2, stop)).first()[0]


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "chunk_id string, vector array<float>")


def test_vector_search(spark):
    df = vectors(spark, [("a", [1, 0]), ("b", [0.9, 0.1]), ("c", [0, 1]), ("d", [1, 0])]).withColumn("source", F.col("chunk_id"))
    assert [r.chunk_id for r in retrieval.vector_topk(df, [1, 0], 3).collect()] == ["a", "d", "b"]
    assert [r.chunk_id for r in retrieval.vector_topk(df, [1, 0], 3, where=where("source", "notEquals", "a")).collect()] == ["d", "b", "c"]
    assert [r.chunk_id for r in retrieval.vector_topk(df, [1, 0], 4, threshold=0.99).collect()] == ["a", "d", "b"]
    with pytest.raises(ValueError):
        retrieval.vector_topk(df, [1, 0], 0)


def test_batch_search_equals_single(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(f"{i:03}", rng.integers(-2, 3, 4)) for i in range(120)] + [("zero", [0, 0, 0, 0])]
    df = vectors(spark, rows).repartition(5)
    asked = df.where("chunk_id < '010'").select(F.col("chunk_id").alias("query_id"), "vector")
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 4)
    got = retrieval.vector_topk_batch(df, asked, 7).orderBy("query_id", "rank").collect()
    assert len(got) == 70
    for q in asked.collect():
        single = retrieval.vector_topk(df, q.vector, 7).collect()
        mine = [r for r in got if r.query_id == q.query_id]
        assert np.allclose([r.score for r in single], [r.score for r in mine])
    assert retrieval.vector_topk_batch(df.limit(0), asked, 3).collect() == [] == retrieval.vector_topk_batch(df, asked.limit(0), 3).collect()


def test_mmr(spark):
    df = vectors(spark, [("A", [1, 0, 0]), ("B", [0.99, 0.01, 0]), ("C", [0, 1, 0])])
    got = retrieval.mmr(df, [1, 0, 0], 3, 0.5).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["A", "B", "C"] and np.allclose([r.score for r in got], [0.5, 0, -0.00505], atol=1e-4)
    assert [r.chunk_id for r in retrieval.mmr(df, [1, 0, 0], 3, 1.0).orderBy("rank").collect()] == ["A", "B", "C"]
    assert [r.chunk_id for r in retrieval.mmr(df, [1, 0, 0], 2, 0.1).orderBy("rank").collect()] == ["A", "C"]
    grouped = df.withColumn("q", F.lit(1)).unionByName(df.withColumn("q", F.lit(2)))
    assert sorted(retrieval.mmr(grouped, [1, 0, 0], 2, group=["q"]).groupBy("q").count().collect()) == [(1, 2), (2, 2)]


def lists(spark, a, b):
    return [spark.createDataFrame(x, "chunk_id string, score double") for x in (a, b)]


A, B = [("x", 0.9), ("y", 0.5), ("z", 0.1)], [("x", 12.0), ("w", 3.0), ("y", 3.0)]


def test_fusion(spark):
    a, b = lists(spark, A, B)
    rrf = {r.chunk_id: r.score for r in fusion.rrf(a, b, 10).collect()}
    assert math.isclose(rrf["x"], 1 / 61) and math.isclose(rrf["w"], 0.3 / 62) and math.isclose(rrf["y"], 0.7 / 62 + 0.3 / 63)
    scaled = {r.chunk_id: r.score for r in fusion.weighted(a, b, 10).collect()}
    assert math.isclose(scaled["x"], 1) and math.isclose(scaled["y"], 0.35) and scaled["z"] == 0
    sa, sb = np.std([0.9, 0.5, 0.1]), np.std([12, 3, 3])
    dist = {r.chunk_id: r.score for r in fusion.distribution(a, b, 10).collect()}
    assert math.isclose(dist["x"], 0.7 * 0.4 / sa + 0.3 * 6 / sb) and math.isclose(dist["z"], -0.7 * 0.4 / sa)
    equal, none = lists(spark, [("p", 2.0), ("q", 2.0)], [])
    assert {r.score for r in fusion.weighted(equal, none, 5).collect()} == {0.7}
    assert {r.score for r in fusion.distribution(equal, none, 5).collect()} == {1.4}
    assert [r.chunk_id for r in fusion.hybrid(a, b, 1).collect()] == ["x"] and fusion.rrf(none, none).collect() == []


def test_merging_and_reranking(spark):
    a, b = lists(spark, A, B)
    assert [(r.chunk_id, r.score) for r in retrieval.merge_queries(a.unionByName(b), 3).collect()] == [("x", 12), ("w", 3), ("y", 3)]
    asked = []
    out = retrieval.multi_query(lambda q: asked.append(q) or (a if q == "one" else b), ["one", " two ", "one", "  "], 2)
    assert asked == ["one", "two"] and out.count() == 2 and retrieval.multi_query(None, [" "], 3) is None
    assert [round(r.score, 6) for r in retrieval.rank_scores(a).orderBy(F.desc("score")).collect()] == [1, 0.9, 0.8]
    assert [r.chunk_id for r in retrieval.rerank(a, -F.col("score"), 2).collect()] == ["z", "y"]
    both = a.withColumn("index", F.lit("a")).unionByName(b.withColumn("index", F.lit("b")))
    assert retrieval.multi_index(both, limit=2).count() == 4 and retrieval.multi_index(both, limit=2, names=["b", "nope"]).count() == 2
    assert retrieval.confidence(a).first().confidence == "low" and retrieval.confidence(a.limit(0)).first().confidence == "low"
    assert retrieval.confidence(a.where("score > 0.6")).first().confidence == "high"


def results(spark):
    rows = [("1", "d1", "alpha " * 20, "s1", 0.9), ("2", "d2", "beta", "s1", 0.8), ("3", "d3", "gamma", None, 0.7), ("4", "d3", "delta", None, 0.6)]
    return spark.createDataFrame(rows, "chunk_id string, document_id string, content string, source string, score double")


def test_context(spark):
    df = results(spark)
    capped = context.source_cap(context.ranked(df), 1).orderBy("rank").collect()
    assert [r.chunk_id for r in capped] == ["1", "3"]
    whole = context.build(df, 1000, scores=True).first()
    assert whole.chunks == 4 and whole.context.startswith("[Source 1] (s1) [score: 0.9000]\nalpha ") and "[Source 3] (Unknown)" in whole.context
    # the budget stops at the first block that is too long
    assert context.build(df, 20).first().chunks == 0
    assert context.build(df, 35, metadata=False).first().chunks == 3
    assert context.build(df.limit(0), 10).first().context == ""
    assert [r["index"] for r in context.structured(df, 1).orderBy("index").collect()] == [1, 2]
    with pytest.raises(ValueError):
        context.build(df, 0)


def test_reductions(spark):
    join = lambda xs: "(" + "+".join(xs) + ")"
    texts = [str(i) for i in range(9)]
    want = "(((0+1+2)+(3+4+5)+(6+7+8)))"
    assert context.tree_reduce(texts, join, 3) == want[1:-1]
    rows = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "position int, content string")
    plan = context.tree_levels(rows, lambda xs: F.concat(F.lit("("), F.array_join(xs, "+"), F.lit(")")), 3)
    assert plan.first()[0] == want[1:-1]
    assert context.refine(["a", "b", "c"], lambda t: t, lambda x, t: f"{x}<{t}") == "a<b<c"
    assert context.tree_reduce([], join) == context.refine([], None, None) == context.EMPTY


def test_store(spark, tmp_path):
    df = vectors(spark, [("a", [1, 0]), ("b", [0, 1])]).withColumn("source", F.col("chunk_id"))
    s = store.ParquetStore(spark, str(tmp_path / "store"))
    assert s.is_empty() and not s.contains("a") and s.read() is None
    s.add(df)
    s.add(vectors(spark, [("b", [5, 5]), ("c", [1, 1])]).withColumn("source", F.lit("new")))
    assert s.count() == 3 and s.contains("b") and s.get("b").first().source == "new"
    s.delete(spark.createDataFrame([("a",), ("nope",)], "chunk_id string"))
    s.delete_where(where("source", "equals", "other"))
    assert s.count() == 2
    for bad in ([("x", [1, 2, 3])], [("x", [math.nan, 1])], [(None, [1, 2])]):
        with pytest.raises(store.InvalidRows):
            s.add(vectors(spark, bad).withColumn("source", F.lit("x")))
    s.delete_where([where("source", "equals", "new")][0])
    s.clear()
    assert s.is_empty() and s.dimensions == 2 and store.check(df.limit(0), 7) == 7
    assert store.orphans(df, df.limit(1)).collect() == [("b", "embedding")]
    assert store.delete_where(df, F.lit(None).cast("boolean")).count() == 2


def test_tenants(spark):
    df = spark.createDataFrame([("1", "d1", "s"), ("2", "d2", "s")], "chunk_id string, document_id string, source string")
    both = tenancy.isolate(df, "acme").unionByName(tenancy.isolate(df, "other", "pre"))
    assert {r.chunk_id for r in both.collect()} == {"acme_1", "acme_2", "pre_1", "pre_2"}
    assert tenancy.of_tenant(both.drop("custom"), "other", where("documentId", "equals", "d2")).collect()[0].chunk_id == "pre_2"
    assert sorted(tenancy.restore(tenancy.of_tenant(both, "acme"), "acme").select(*df.columns).collect()) == sorted(df.collect())
    assert {(r.tenant_id, r.chunks) for r in tenancy.counts(both).collect()} == {("acme", 2), ("other", 2)}
    assert tenancy.tiers(spark).count() == 4


def test_token_bucket(spark):
    rows = [(i, "u", f"2024-01-01 00:00:{s:02}") for i, s in enumerate([0, 0, 0, 1, 10, 10, 10])]
    df = spark.createDataFrame(rows, "event_id long, user string, t string").withColumn("ts", F.to_timestamp("t"))
    got = tenancy.replay_rate_limit(df, "user", "ts", "event_id", 2, 1.0).orderBy("event_id").collect()
    assert [r.allowed for r in got] == [True, True, False, True, True, True, False]


def test_inverted_file(spark, tmp_path):
    from tessera.operators.ann import IVF

    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 16))
    rows = [(f"{i:04}", centers[i % 12] + 0.2 * rng.normal(size=16)) for i in range(900)]
    df = vectors(spark, rows)
    ivf = IVF.build(df, str(tmp_path), lists=12)
    hits = 0
    for i in range(0, 900, 90):
        exact = {r.chunk_id for r in retrieval.vector_topk(df, list(rows[i][1]), 10).collect()}
        hits += len(exact & {r.chunk_id for r in ivf.search(list(rows[i][1]), 10, probes=3).collect()})
    assert hits >= 90 and ivf.search(list(rows[0][1]), 900, probes=12).count() == 900


def test_limits_json_and_memory(spark, tmp_path):
    df = vectors(spark, [("a", [1, 0]), ("b", [0, 1])])
    with pytest.raises(store.InvalidRows):
        store.ParquetStore(spark, str(tmp_path / "small"), most=1).add(df)
    kinds = "chunk_id string, content string", "chunk_id string, vector array<float>"
    texts = chunks(spark, [("a", "x"), ("b", "y")])
    store.save_json(texts, df, str(tmp_path / "json"))
    back = store.load_json(spark, str(tmp_path / "json"), *kinds)
    assert sorted(back[1].collect()) == sorted(df.collect())
    store.save_json(texts, df.limit(1), str(tmp_path / "json"))
    with pytest.raises(store.InvalidRows):
        store.load_json(spark, str(tmp_path / "json"), *kinds)
    s = store.ParquetStore(spark, str(tmp_path / "memory"))
    one, two = store.Memory(s, "one", 3), store.Memory(s, "two")
    assert one.search([1, 0]) is None
    one.add(df)
    two.add(df.limit(1))
    assert (one.count(), two.count()) == (2, 1) and [r.chunk_id for r in one.search([1, 0], 5, 0.5).collect()] == ["a"]
    with pytest.raises(store.InvalidRows):
        one.add(df)
    one.clear()
    assert (one.count(), two.count()) == (0, 1)


def test_metadata(spark):
    from tessera.functions import metadata as M

    assert M.flat({"b": [1, None, "x"], "a": {"k": True}, "c": 1.5}) == "{a: {k: true}, b: 1, , x, c: 1.5}"
    df = spark.createDataFrame([('{"a": [1, 2], "b": null}',), (None,)], "j string")
    assert [r[0] for r in df.select(M.flattened("j")).collect()] == [{"a": "1, 2", "b": ""}, None]
    assert df.select(M.hit_rate(F.lit(1), F.lit(3)), M.hit_rate(F.lit(0), F.lit(0))).first() == (0.25, 0.0)
    assert [r.batch for r in M.batches(spark.range(5), 2, "id").orderBy("id").collect()] == [0, 0, 1, 1, 2]
    with pytest.raises(ValueError):
        M.batches(df, 0, "j")
