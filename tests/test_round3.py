"""What the findings of round 3 said, on small tables that hold the odd rows."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tessera.operators import chunking
from tessera.plans.queries import ORACLES, QUERIES


@pytest.fixture
def compared(spark, tmp_path):
    """Runs a query over one table made of rows, in Spark and SQL; both as sorted rows."""

    def run(name, table, schema, rows):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
        duck = duckdb.connect()
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        df = QUERIES[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        want = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
        return sorted(map(tuple, df.select(*columns).collect()), key=repr), sorted(want, key=repr)

    return run


def test_markdown_sections_of_any_length(compared):
    long = "\n\n".join(" ".join(["word"] * 80) for _ in range(10))
    got, want = compared("chunk_markdown", "conversations", "conv_id long, turn int, role string, text string", [(1, 0, "user", "short"), (1, 1, "assistant", long), (1, 2, "user", "x" * 2500)])
    assert got == want and len(got) == 3
    assert all(len(p.content) <= 2000 for p in chunking.markdown(f"## a\n\n{long}"))


def test_semantic_breaks_at_a_cosine_of_just_the_threshold(compared):
    # counts of a, e and i in parts that end with the word stop, so that their cosine is exactly 0.8
    counts = [(a, e, i) for a in range(6) for e in range(6) for i in range(12)]
    at = [(p, q) for p in counts for q in counts if 25 * (1 + sum(x * y for x, y in zip(p, q, strict=True))) ** 2 == 16 * (1 + sum(x * x for x in p)) * (1 + sum(x * x for x in q))]
    part = lambda p: " ".join([*("z" + v * n for v, n in zip("aei", p, strict=True)), *["zz"] * 7])
    rows = [(n, " ".join(map(part, (p, q, p, p))), "s", "en") for n, (p, q) in enumerate(at)]
    got, want = compared("chunk_semantic", "documents", "doc_id long, text string, source string, lang string", rows)
    assert len(at) > 50
    assert got == want


def test_neighbour_cosines_of_vectors_without_use():
    from tessera.functions.vector import neighbour_cosines

    rows = np.array([[3.0, 4.0], [4.0, 3.0], [0.0, 0.0], [1.0, np.nan], [1e200, 1e200], [1e200, 1.0]])
    assert neighbour_cosines(rows).tolist() == [0.96, 0.0, 0.0, 0.0, 0.0]
    assert neighbour_cosines(np.zeros((1, 5))).tolist() == []


def test_html_references_without_a_semicolon(compared):
    page = "<html><head><title>{0}</title></head><body><h1>{0}</h1><p>a&amp;b {0} c&lt;d&#39; x</p></body></html>"
    rows = [(n, page.format(t)) for n, t in enumerate(("and&amp", "a &amp;&amp", "one &am", "x &lt y", "q &quot;z&quot", "&#39", "R&D", "&amp;lt", "a & b &"))]
    got, want = compared("html_extract", "pages", "page_id long, html string", rows)
    assert got == want


def test_html_files_are_read_as_by_browsers():
    from tessera.sources import parse

    assert parse.page("<p>a &amp b &lt;</p>")[0] == "a & b <"
    assert parse.page("<p>a &amp b &lt; &ampx; &eacute;</p>", unclosed=False)[0] == "a &amp b < &ampx; é"


def test_a_long_document_is_ingested_as_one_chunk(compared):
    rows = [(1, "ering " * 40_000, "s", "en"), (2, "  ering and others ", "s", "en"), (3, " \n", "s", "en"), (4, "none", "s", "en")]
    schema = "doc_id long, text string, source string, lang string"
    got, want = compared("pipeline_counts", "documents", schema, rows)
    assert got == want == [(3, 3)]


def test_whole_documents_as_chunks(spark):
    rows = spark.createDataFrame([(1, " a b　"), (2, ""), (3, None)], "doc_id long, content string")
    assert [tuple(r) for r in chunking.whole(rows).collect()] == [(1, 0, "a b", 0, 3)]


def _same_in_slices(strategy, **parameters):
    """One batch of 3,000,000 characters and a longer text is handed on in slices that hold what its texts give one by one."""
    from tessera.operators.chunking import python

    texts = [f"{i} one two. Three.\n\nFour {i}. " * 100 for i in range(1000)] + [None, "", " ", "x y. " * 300_000, "end."]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])
    run = lambda t: python.STRATEGIES[strategy](t, **parameters)
    out = list(python.chunked(run, iter([batch])))
    lengths = [sum(len(texts[i]) for i in set(b.column(0).to_pylist())) for b in out]
    assert len(out) >= 4 and sorted(lengths)[-2] <= python.HELD
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert rows == [(i, k, *p) for i, t in enumerate(texts) if t for k, p in enumerate(run(t))]


def test_sentence_chunks_are_handed_on_in_slices():
    _same_in_slices("sentence")


def test_sentences_are_handed_on_in_slices():
    _same_in_slices("sentence", target=1, overlap=0, least=0)


def test_paragraph_chunks_are_handed_on_in_slices():
    _same_in_slices("paragraph")


WORDS = [(1, "apple pear apple"), (2, "pear plum"), (3, ""), (4, None), (5, "plum plum plum apple"), (6, "kiwi apple pear")]


def test_a_written_index_is_a_sorted_segment_for_each_part(spark, tmp_path):
    from tessera.operators.retrieval import BM25

    built = BM25.build(spark.createDataFrame(WORDS, "id long, content string").repartition(3), "id")
    written = built.write(str(tmp_path))
    files = list(tmp_path.glob("postings/*.parquet"))
    assert 2 <= len(files) <= 3
    for f in files:
        terms = [r[0] for r in duckdb.sql(f"SELECT term FROM '{f}'").fetchall()]
        assert terms == sorted(terms) and len(terms) > 1
    assert written.search("apple plum plum", 10).collect() == built.search("apple plum plum", 10).collect()


def test_a_replaced_index_is_searched_by_rows(spark):
    from tessera.operators.retrieval import BM25

    rows = lambda r: spark.createDataFrame(r, "id long, content string")
    new = [(2, "apple apple"), (7, "plum kiwi"), (3, "kiwi")]
    index = BM25.build(rows(WORDS), "id").replaced(BM25.build(rows(new), "id"))
    assert index.by_row is not None
    whole = BM25.build(rows([r for r in WORDS if r[0] not in (2, 3, 7)] + new), "id")
    for query in ("apple plum plum", "kiwi", "none"):
        assert index.search(query, 10).collect() == whole.search(query, 10).collect()
    assert sorted(index.document_frequencies().collect()) == sorted(whole.document_frequencies().collect())
    gone = index.without(rows([(7, "")]))
    assert [r[0] for r in gone.search("kiwi", 10).collect()] == [3, 6]


def test_embedders_get_a_batch_of_texts_at_a_time(spark):
    from tessera.functions.embed import embed, hashed

    def make():
        def model(texts):
            import sys

            assert len(texts) <= 7 and all(type(t) is str for t in texts)
            rows = sys._getframe(1).f_locals.get("texts")
            assert type(rows).__module__.startswith("pyarrow")
            return hashed(texts)

        return model

    texts = [f"word{i % 5} and more {i}" for i in range(50)] + [None, ""]
    got = embed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, content string"), make=make, batch=7)
    assert got.schema["vector"].dataType.simpleString() == "array<float>"
    want = np.asarray(hashed([t or "" for t in texts]), np.float32)
    assert [r.vector for r in got.orderBy("i").collect()] == want.tolist()
    none = spark.createDataFrame([], "i long, content string")
    assert embed(none).collect() == []
