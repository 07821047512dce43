from collections import Counter

import pyarrow as pa
import pytest
from tessera.llm.token_binary import boundaries, document, token_binary
from tessera.llm.tokens import tokenizer

from tests.llm import cases


def back(shards):
    return Counter((i, tuple(document(r.asDict(), k).tolist())) for r in shards for k, i in enumerate(r.doc_ids))


def plain(rows):
    return Counter((r[0], tuple(tokenizer().one(r[1] or ""))) for r in rows)


@pytest.mark.parametrize("size", [1, 5, 1 << 20])
def test_edges(spark, size):
    shards = token_binary(cases.edges(spark).coalesce(1), shard_tokens=size).collect()
    assert back(shards) == plain(cases.EDGES)
    for s in shards:
        assert s.n_tokens <= size or s.n_docs == 1 or s.n_tokens == sum(len(document(s.asDict(), k)) for k in range(s.n_docs))
        assert s.n_tokens * s.id_bytes == len(s.ids) and boundaries(s.asDict()).select(s.n_docs) == s.n_tokens


def test_shards_hold_at_most_their_size(spark, sf):
    shards = token_binary(spark.read.parquet(f"{sf}/documents.parquet"), shard_tokens=20_000).collect()
    assert all(s.n_tokens <= 20_000 or s.n_docs == 1 for s in shards) and len({s.shard_id for s in shards}) == len(shards) > 3
    assert back(shards) == plain(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())


def test_empty(spark):
    assert token_binary(cases.empty(spark)).collect() == []


def test_batches_of_nothing():
    ids, bounds = tokenizer()(pa.array(["", ""], pa.large_string()))
    assert len(ids) == 0 and bounds.tolist() == [0, 0, 0]
