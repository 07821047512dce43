"""The pipeline against a plain restatement of each stage, and the guard for its absence."""

import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tessera.llm import mixing, simhash_dedup, toxicity
from tessera.llm.decontaminate import N, LEAST
from tessera.llm.hamming_graph import distance
from tessera.llm.token_binary import document
from tessera.llm.tokens import tokenizer

import corpus_pipeline
from tests.llm import cases
from tests.llm.test_decontaminate import grams, hit
from tests.llm.test_mixing import shares
from tests.llm.test_simhash import groups_of, shingles

ROOT = Path(__file__).resolve().parents[2]


def plain_toxicity(rows, docs, labels):
    m = toxicity.train(docs, labels)
    batch = pa.RecordBatch.from_arrays([pa.array([r.text for r in rows], pa.string())], names=["text"])
    feats, bounds = toxicity.features(batch)
    keep = []
    for r, a, b in zip(rows, bounds[:-1], bounds[1:], strict=True):
        w = m.w[m.known[feats[a:b]]].astype(float)
        z = m.bias + w[:, 0].sum() + sum(w[i, 1:] @ w[:i, 1:].sum(0) for i in range(1, len(w)))
        if not (b > a and 1 / (1 + np.exp(-np.clip(z, -60, 60))) >= m.threshold):
            keep.append(r)
    return keep


def plain_near(rows):
    sig, _ = simhash_dedup.signatures(pa.array([r.text for r in rows], pa.large_string()))
    x, y = np.nonzero(distance(sig[:, None], sig[None]) <= simhash_dedup.RADIUS)
    sets = [shingles(r.text) for r in rows]
    ok = [len(sets[a] & sets[b]) >= simhash_dedup.SIMILAR * len(sets[a] | sets[b]) for a, b in zip(x, y, strict=True)]
    root = groups_of([(rows[a].doc_id, rows[b].doc_id) for a, b in zip(x[ok], y[ok], strict=True)], [r.doc_id for r in rows])
    return [r for r in rows if root[r.doc_id] == r.doc_id]


def plain_mix(spark, rows):
    size = {r.doc_id: len(tokenizer().one(r.text)) for r in rows}
    rank = {r.doc_id: r.h for r in spark.createDataFrame([(r.doc_id,) for r in rows], "doc_id long").select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id").alias("h")).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r.doc_id)
    have = {s: sum(size[i] for i in ids) for s, ids in by.items()}
    share, keep = shares(have, mixing.tempered(have), int(mixing.SHARE * sum(have.values()))), set()
    for s, ids in by.items():
        lengths, counts = np.unique([size[i] for i in ids], return_counts=True)
        take = dict(zip(lengths.tolist(), mixing.fit(lengths, counts, share[s]).tolist(), strict=True))
        for n in take:
            keep |= set(sorted((i for i in ids if size[i] == n), key=lambda i: (rank[i], i))[: take[n]])
    return [r for r in rows if r.doc_id in keep]


def test_against_plain_stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id")
    rows = plain_near(plain_toxicity(docs.collect(), docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    g = grams([r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()], N, LEAST)
    rows = plain_mix(spark, [r for r in rows if not hit(r.text, g)])
    shards = corpus_pipeline.run(spark, sf_dir).collect()
    got = {i: document(s.asDict(), k).tolist() for s in shards for k, i in enumerate(s.doc_ids)}
    assert got == {r.doc_id: tokenizer().one(r.text) for r in rows} and 100 < len(got) < 1000


def test_stages(spark, sf, tmp_path):
    docs = cases.edges(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    out = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, out, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"s{i}"))
            out = spark.read.parquet(str(tmp_path / f"s{i}"))
    assert out.count() > 0
    nothing = cases.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        nothing_ = stage(spark, nothing, str(tmp_path))
        assert nothing_.count() == 0


def test_the_rest_works_without(tmp_path):
    for name in ("tessera", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "tessera/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_all_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
