import re
from collections import Counter

import pytest
from tessera.llm.decontaminate import decontaminate

from tests.llm import cases

words = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())
ITEM = "a stone lies over the old well where nobody goes for water"
SHORT = "five small words right here"


def grams(items, n=8, least=5):
    out = set()
    for t in items:
        w = words(t)
        if len(w) >= least:
            k = min(n, len(w))
            out |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return out


def hit(text, g):
    w = words(text)
    return any(tuple(w[i : i + k]) in g for k in {len(x) for x in g} for i in range(len(w) - k + 1))


def bench(spark, items):
    return spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")


@pytest.mark.parametrize("size,limit", [(1 << 24, 0), (2000, 200_000), (2000, 0)])
def test_against_brute_force(spark, sf, size, limit):
    docs, b = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    g = grams([r.text for r in b.collect()])
    want = {r.doc_id for r in docs.collect() if not hit(r.text, g)}
    got = decontaminate(docs, b, part_bytes=size, broadcast_rows=limit)
    assert {r.doc_id for r in got.collect()} == want and len(want) < docs.count()


TEXTS = [
    f"before it, {ITEM.upper()}! and after",
    f"before it, {ITEM[: ITEM.index('where')]} and after",
    "A stone; lies -- over\nthe old well, where",
    f"{SHORT}",
    "five small words right",
    f"Ends with {SHORT} and then many other words that are of no benchmark at all, so most of it stays.",
    None,
    "",
    "a stone lies over the old",
]


def test_documents(spark):
    docs = spark.createDataFrame(cases.rows(TEXTS), cases.SCHEMA)
    got = decontaminate(docs, bench(spark, [ITEM, SHORT, "too short", None, "", ITEM]))
    assert got.columns == docs.columns
    g = grams([ITEM, SHORT])
    assert {r.doc_id for r in got.collect()} == {i for i, t in enumerate(TEXTS) if not hit(t, g)} == {1, 4, 6, 7, 8}


def test_spans(spark):
    docs = spark.createDataFrame(cases.rows(TEXTS), cases.SCHEMA)
    got = {r.doc_id: r.text for r in decontaminate(docs, bench(spark, [ITEM, SHORT]), mode="spans").collect()}
    assert got[5] == "Ends with and then many other words that are of no benchmark at all, so most of it stays."
    assert set(got) == {1, 4, 5, 6, 7, 8} and got[1] == TEXTS[1]
    g = grams([ITEM, SHORT])
    assert not any(hit(t, g) for t in got.values())


@pytest.mark.parametrize("mode", ["documents", "spans"])
def test_edges(spark, mode):
    docs = cases.edges(spark)
    assert Counter(decontaminate(docs, bench(spark, [ITEM]), mode=mode).collect()) == Counter(docs.collect())
    assert Counter(decontaminate(docs, bench(spark, []), mode=mode).collect()) == Counter(docs.collect())
    assert decontaminate(cases.empty(spark), bench(spark, [ITEM]), mode=mode).collect() == []
    kept = decontaminate(docs, bench(spark, ["the same row twice over in this table", "stone that lies over the well is heavy"]), mode="documents").collect()
    assert Counter(kept) == Counter(r for r in docs.collect() if r.doc_id not in (8, 11))


def test_gram_does_not_cross_documents(spark):
    half = ITEM.split()
    docs = spark.createDataFrame(cases.rows([" ".join(half[:6]), " ".join(half[6:])]), cases.SCHEMA).coalesce(1)
    assert decontaminate(docs, bench(spark, [ITEM])).count() == 2


@pytest.mark.parametrize("mode", ["spans", "documents"])
def test_any_number_of_parts_gives_the_same(spark, mode):
    items = [" ".join(f"b{i}x{k}" for k in range(10)) for i in range(7)]
    own = [" ".join(f"c{k}" for k in range(n)) for n in (11, 30)]
    texts = [*TEXTS, f"{items[0]} {own[0]} {items[1]}", f"{items[0]}\n{own[1]}\t{items[1]} end", f"{own[1]} {' '.join(items)}", f"{items[2]} {items[2]} {own[1]}", "x" * 50_000 + " " + items[3] + " y" * 50, own[0]]
    docs = spark.createDataFrame(cases.rows(texts + texts[-3:]), cases.SCHEMA).repartition(3)
    results = []
    for size in (1 << 20, 150, 1):
        results.append(Counter(decontaminate(docs, bench(spark, [*items, ITEM, SHORT]), mode=mode, part_bytes=size).collect()))
    assert results[0] == results[1] == results[2]
    kept = {r.doc_id: r.text for r in results[0]}
    first = len(TEXTS)
    assert first not in kept  # 20 of 31 words, in two items
    if mode == "spans":
        assert kept[first + 1] == own[1] + " end" and kept[first + 3] == own[1]
    assert results[0] == Counter(decontaminate(docs, bench(spark, [*items, ITEM, SHORT] * 3), mode=mode).collect())


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, ITEM, "x"), (2, "other words", "y")], "doc_id long, text string, `a.b` string")
    for size in (1 << 20, 1):
        assert [tuple(r) for r in decontaminate(docs, bench(spark, [ITEM, SHORT]), part_bytes=size).collect()] == [(2, "other words", "y")]


def test_a_large_benchmark_is_small_in_memory():
    import pickle

    from tessera.llm.decontaminate import PART_BYTES, Grams

    items = [" ".join(f"w{(i * 7919 + k * k * 31) % 50_000}" for k in range(100)) for i in range(PART_BYTES // 640)]
    g = Grams(items, 8, 5)
    assert len(pickle.dumps(g)) < 5 * PART_BYTES and sum(map(len, (t[0] for t in g.tables.values()))) > 1_000_000
