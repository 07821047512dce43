import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tessera import streaming
from tessera.functions.embed import embed_cached, hashed
from tessera.functions.filters import where
from tessera.operators import chunking
from tessera.operators.store import ParquetStore
from tessera.plans import rag
from tessera.schema import QueryOptions

TEXTS = ["The old well lies under a heavy stone.", "Bread is made from flour and water.", "Ships sail when the wind is fair."]


@pytest.fixture()
def pipeline(spark, tmp_path):
    p = rag.Pipeline(ParquetStore(spark, str(tmp_path / "store")), lambda d: chunking.fixed_size(d, 100, 20))
    seen = []
    docs = spark.createDataFrame([(f"d{i}", t, f"s{i}") for i, t in enumerate(TEXTS)], "doc_id string, content string, source string")
    p.ingest(docs, seen.append)
    assert seen == ["chunking", "embedding", "storing", "complete"]
    return p


def test_query(pipeline):
    for mode in ("vector", "keyword", "rrf", "weighted", "distribution"):
        assert pipeline.retrieve("flour and water bread", 2, mode=mode).first().document_id == "d1"
    answer = pipeline.query("heavy stone over a well", QueryOptions(retrieval_limit=2))
    assert TEXTS[0] in [s["content"] for s in answer.sources] and answer.metadata["chunks_retrieved"] == 2
    for synthesis in ("compact", "refine", "tree"):
        assert pipeline.query("wind and ships", synthesis=synthesis).text
    only = pipeline.query("bread", QueryOptions(filter=where("source", "equals", "s2")))
    assert [s["source"] for s in only.sources] == ["s2"]
    assert tuple(pipeline.statistics().first()) == (3, 3)


def test_events_and_errors(pipeline):
    names = [n for n, _ in pipeline.events("bread")]
    assert names == ["retrieval_started", "retrieval_complete", "generation_started", "generation_chunk", "generation_complete", "complete"]
    none = list(pipeline.events("bread", QueryOptions(filter=where("source", "equals", "none"))))
    assert [n for n, _ in none] == ["retrieval_started", "retrieval_complete", "complete"] and none[-1][1].sources == []
    for bad in (lambda: pipeline.query(" "), lambda: pipeline.query("x", QueryOptions(retrieval_limit=0)), lambda: pipeline.query("x", synthesis="none")):
        with pytest.raises(ValueError):
            bad()


def test_tools(pipeline):
    assert len(rag.search_tool(pipeline, "bread flour water", 3)) == 3 and len(rag.search_tool(pipeline, "bread flour water", 3, 7.0)) <= 1
    assert rag.query_tool(pipeline, "bread")["confidence"] in ("low", "medium", "high") and rag.summarize_tool(pipeline, "wind")
    assert rag.ingest_tool(pipeline, ["A new text about mills."]) == 1 and pipeline.store.count() == 4
    many = rag.multi_index_tool({"a": pipeline, "b": None}, "mills", ["a", "b", "zzz"], 1)
    assert len(many["a"]) == 1 and many["b"].startswith("error") and "zzz" not in many


def test_ingest_is_repeatable(pipeline, spark):
    before = {r.chunk_id for r in pipeline.store.read().collect()}
    pipeline.ingest(spark.createDataFrame([(f"d{i}", t, f"s{i}") for i, t in enumerate(TEXTS)], "doc_id string, content string, source string"))
    assert {r.chunk_id for r in pipeline.store.read().collect()} == before


def test_transformers():
    assert rag.expand("q", lambda q: " more ") == "q more" and rag.expand(" ", lambda q: "x") == " " and rag.expand("q", lambda q: " ") == "q"
    assert rag.rephrase("q", lambda q: "r") == "r" == rag.hypothetical("q", lambda q: "r") and rag.rephrase("q", lambda q: "") == "q"
    assert rag.decompose("q", lambda q: "1. a\n\n- b") == "q\na\nb"
    assert rag.chain(lambda q: q + "1", lambda q: q + "2")("q") == "q12"
    assert rag.validated("{a}", "a") == "{a}"
    with pytest.raises(ValueError):
        rag.validated("{a}", "b")


def test_embedding_cache(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, None)], "i int, content string")
    rows, new = embed_cached(df)
    assert new.count() == 3 and np.allclose({r.i: r.vector for r in rows.collect()}[2], hashed(["a b"])[0], atol=1e-6)
    again, newer = embed_cached(df.unionByName(spark.createDataFrame([(5, "d")], "i int, content string")), new)
    assert newer.count() == 1 and again.count() == 5


def test_directory_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    sink, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        streaming.ingest(streaming.directory_stream(spark, str(folder)), lambda d: chunking.fixed_size(d, 10, 0), sink, state).awaitTermination()
        return spark.read.parquet(sink).count()

    (folder / "a.txt").write_text("x" * 25)
    assert run() == 3
    (folder / "b.md").write_text("y" * 10)
    (folder / "c.zip").write_bytes(b"z")
    assert run() == 4 == run()


def test_rates(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = streaming.rates(stream, by=["event_type"]).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("rates").agg(F.sum("n")).first()[0] == events.count()


def test_rate_limit_stream(spark, tmp_path):
    rows = pd.DataFrame({"event_id": range(7), "user_id": 1, "ts": pd.to_datetime([f"2024-01-01 00:00:{s:02}" for s in (0, 0, 0, 1, 10, 10, 10)])})
    df = spark.createDataFrame(rows)
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    q = streaming.rate_limited(stream, "user_id", 2, 1.0).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.allowed for r in spark.table("limited").orderBy("event_id").collect()] == [True, True, False, True, True, True, False]
