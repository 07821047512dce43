from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tessera.llm.toxicity import Machine, _best, toxicity, train, without_toxic

from tests.llm import cases


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_score_is_the_pairwise_sum():
    rng = np.random.default_rng(1)
    m = Machine(3)
    m.known[[5, 9, 11, 40]] = [1, 2, 3, 4]
    m.w, m.bias = rng.normal(size=(5, 4)).astype(np.float32), 0.3
    m.w[0] = 0
    for doc in ([], [5], [5, 9, 77], [5, 9, 11, 40]):
        rows = m.w[m.known[doc]].astype(float) if doc else np.zeros((0, 4))
        want = 0.3 + rows[:, 0].sum() + sum(rows[i, 1:] @ rows[j, 1:] for i in range(len(doc)) for j in range(i))
        assert np.isclose(m.margin(np.array(doc, np.int32), np.array([0, len(doc)]))[0], want, atol=1e-5)


def test_learns_a_pair_that_no_sum_can():
    # toxic only if both or neither of two words are there
    docs, y = [], []
    for i in range(400):
        a, b = i % 2, i // 2 % 2
        docs.append(np.array([1000 + i % 7] + [1] * a + [2] * b, np.int32))
        y.append(int(a == b))
    m = Machine().fit(docs, np.array(y), rate=0.2)
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    assert ((m.score(np.concatenate(docs), bounds) > 0.5) == np.array(y)).mean() > 0.95


def test_learns_a_pair_whose_words_do_not_tell_alone():
    # both words in 600 toxic documents, either in 600 clean ones: each in as many of both classes
    rng = np.random.default_rng(3)
    docs, y = [], []
    for i in range(8000):
        toxic, k = i % 2, i // 2
        own = [1, 2] if toxic and k < 600 else [1] if not toxic and k < 600 else [2] if not toxic and k < 1200 else [3] if toxic else []
        docs.append(np.unique(np.array(own + rng.integers(100, 400, 12).tolist(), np.int32)))
        y.append(toxic)
    m = Machine().fit(docs, np.array(y))
    score = m.score(np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])]))
    pair, one = (np.array([set(d.tolist()) & {1, 2, 3} in kinds for d in docs]) for kinds in ([{1, 2}], [{1}, {2}]))
    assert (score[pair] > 0.5).mean() > 0.9 and (score[one] < 0.5).mean() > 0.9


def test_threshold():
    assert _best(np.array([0.9, 0.8, 0.2, 0.1]), np.array([1, 1, 0, 0])) == 0.5


def test_held_out_accuracy(spark):
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity(docs, known.where("doc_id % 3 <> 0")).drop("score").withColumnRenamed("toxic", "found").join(known.where("doc_id % 3 = 0"), "doc_id")
    tp, fp, fn = got.agg(*[F.sum(F.expr(x).cast("int")) for x in ("found and toxic = 1", "found and toxic = 0", "not found and toxic = 1")]).first()
    assert 2 * tp / (2 * tp + fp + fn) > 0.85


RUDE = ["you utter clown and fool"] * 12 + ["a kind word for you friend"] * 12


def test_edges(spark):
    rows = cases.rows(RUDE)
    base = 100
    docs = cases.edges(spark).unionByName(spark.createDataFrame([(r[0] + base, *r[1:]) for r in rows], cases.SCHEMA))
    known = labels(spark, [(base + i, 1, int(i < 12)) for i in range(24)] + [(None, 1, 1), (base + 1, None, None), (base, 1, 1), (999, 1, 1)])
    got = toxicity(docs, known).collect()
    assert len(got) == docs.count() and {r.doc_id for r in got if r.toxic} == set(range(base, base + 12))
    kept = without_toxic(docs, known)
    assert kept.columns == docs.columns
    assert Counter(kept.collect()) == Counter(r for r in docs.collect() if not (r.doc_id or 0) in range(base, base + 12))


def test_no_labels(spark):
    docs = cases.edges(spark)
    for known in (labels(spark, []), labels(spark, [(5, 1, 1)]), labels(spark, [(5, 1, 0), (6, 0, 0)])):
        assert Counter(without_toxic(docs, known).collect()) == Counter(docs.collect())
    assert toxicity(cases.empty(spark), labels(spark, [(1, 1, 1)])).collect() == []
    assert train(cases.empty(spark), labels(spark, [])).threshold == 0.5
