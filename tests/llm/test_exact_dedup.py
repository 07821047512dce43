from collections import Counter

import pytest
from tessera.llm.exact_dedup import exact_dedup, heavy_digests, misra_gries
import pyarrow as pa

from tests.llm import cases


def plain(rows):
    """Of equal texts the row of the smallest id, nulls last; null texts all stay."""
    best = {}
    for r in rows:
        if r[1] is not None:
            key = (r[0] is None, r[0] or 0)
            if r[1] not in best or key < best[r[1]][0]:
                best[r[1]] = key, r
    return [r for _, r in best.values()] + [r for r in rows if r[1] is None]


def same(df, rows):
    assert Counter(map(tuple, df.collect())) == Counter(plain(rows))


@pytest.mark.parametrize("heavy", [2, 1000])
def test_edges(spark, heavy):
    df = exact_dedup(cases.edges(spark), counters=4, heavy_least=heavy)
    assert df.columns == cases.edges(spark).columns
    same(df, cases.EDGES)


def test_empty(spark):
    assert exact_dedup(cases.empty(spark)).collect() == []


@pytest.mark.parametrize("heavy,counters", [(3, 2), (3, 64), (10_000, 64)])
def test_against_brute_force(spark, heavy, counters):
    texts = [f"text {i % 97}" for i in range(400)] + ["hot"] * 300 + ["warm"] * 40
    rows = cases.rows(texts)
    same(exact_dedup(spark.createDataFrame(rows[::-1], cases.SCHEMA).repartition(5), counters, heavy), rows)


def test_repeated_row_with_other_columns_leaves_the_smallest(spark):
    rows = [(1, "a", lang, "s", 1, None, None, None, None) for lang in ("fr", "de", "en")]
    assert [r.lang for r in exact_dedup(spark.createDataFrame(rows, cases.SCHEMA)).collect()] == ["de"]


def test_summary_holds_every_frequent_digest():
    data = [b"hot"] * 500 + [str(i).encode() for i in range(400)]
    batches = (pa.RecordBatch.from_arrays([pa.array(data[i::7], pa.binary())], names=["d"]) for i in range(7))
    out = next(misra_gries(8)(batches))
    assert out.num_rows <= 8 and b"hot" in out.column(0).to_pylist()


def test_winners_are_counted_exactly(spark):
    from pyspark.sql import functions as F
    from tessera.llm.exact_dedup import D, I, N, KEEP, digest

    rows = cases.rows(["hot"] * 60 + [f"t{i}" for i in range(100)])
    keyed = spark.createDataFrame(rows, cases.SCHEMA).select(F.col("doc_id").alias(I), digest(F.col("text")).alias(D))
    assert [(r[KEEP], r[N]) for r in heavy_digests(keyed, 16, 32).collect()] == [(0, 60)]
