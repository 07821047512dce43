import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tessera.llm import simhash_dedup as S
from tessera.llm.hamming_graph import Graph, distance

from tests.llm import cases


def planted(n=3000, copies=400, flips=(5, 30), seed=2):
    rng = np.random.default_rng(seed)
    sig = rng.integers(0, 1 << 63, (n, 4), dtype=np.uint64) * np.uint64(2)
    near = sig[rng.integers(0, n, copies)].copy()
    for row in near:
        for b in rng.choice(256, rng.integers(*flips), replace=False):
            row[b // 64] ^= np.uint64(1 << int(b % 64))
    return np.concatenate([sig, near])


def test_graph_recall_against_exact_search():
    sig = planted()
    left, right = Graph(sig).within(sig, S.RADIUS)
    d = distance(sig[:, None], sig[None])
    exact = set(zip(*np.nonzero(d <= S.RADIUS), strict=True))
    found = set(zip(left.tolist(), right.tolist(), strict=True))
    assert found <= exact and len(found & exact) / len(exact) >= 0.95


def test_a_crowd_is_found_whole():
    rng = np.random.default_rng(0)
    sig = np.repeat(rng.integers(0, 1 << 63, (1, 4), dtype=np.uint64), 600, 0)
    for row in sig:
        for b in rng.choice(256, 12, replace=False):
            row[b // 64] ^= np.uint64(1 << int(b % 64))
    left, right = Graph(sig).within(sig, S.RADIUS)
    assert len(set(zip(left.tolist(), right.tolist(), strict=True))) >= 0.99 * 600 * 600


@pytest.mark.parametrize("n", [0, 1, 2, 300])
def test_small_graphs(n):
    sig = planted(n, 0) if n else np.empty((0, 4), np.uint64)
    left, _ = Graph(sig).within(sig, 0)
    assert len(left) == n


def shingles(t):
    w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or {tuple(w) or t}


def groups_of(pairs, ids):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {i: top(i) for i in ids}


def test_estimates_follow_the_texts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    _, sketch = S.signatures(pa.array([r.text for r in rows], pa.large_string()))
    sets = [shingles(r.text) for r in rows]
    for i in range(0, 200, 7):
        for j in range(0, 200, 11):
            true = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            assert abs(S.similarity(sketch[i : i + 1], sketch[j : j + 1])[0] - true) < 0.35


def test_groups_against_exact_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    sig, sketch = S.signatures(pa.array([r.text for r in rows], pa.large_string()))
    x, y = np.nonzero(distance(sig[:, None], sig[None]) <= S.RADIUS)
    sets = {r.doc_id: shingles(r.text) for r in rows}
    ids = [r.doc_id for r in rows]
    alike = np.array([len(sets[ids[a]] & sets[ids[b]]) / len(sets[ids[a]] | sets[ids[b]]) for a, b in zip(x, y, strict=True)])
    ok = (x != y) & (alike >= S.SIMILAR)
    pairs = {(ids[a], ids[b]) for a, b in zip(x[ok], y[ok], strict=True)}
    want = groups_of(pairs, ids)
    got = {i: i for i in ids} | {r.doc_id: r.keep for r in S.groups(docs).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) / len(pairs) >= 0.95
    assert all(want[i] == want[got[i]] for i in ids)
    # near copies by the texts themselves
    true = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6]
    assert len(true) > 50
    kept = {r.doc_id for r in S.near_dedup(docs).collect()}
    assert kept == {i for i in ids if got[i] == i}
    n, found = S.audit(docs)
    assert found >= 0.9 * n


def test_small_shards_find_the_same(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, many = ({r.doc_id for r in S.near_dedup(docs, shard=s).collect()} for s in (1 << 16, 8))
    assert len(one ^ many) <= 2


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_edges(spark, limit):
    docs = cases.edges(spark)
    got = S.near_dedup(docs, broadcast_rows=limit)
    assert got.columns == docs.columns
    want = [r for i, r in enumerate(cases.EDGES) if i != 12 and r[0] != 10]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert S.near_dedup(cases.empty(spark)).collect() == []


def test_one_of_each_group_stays(spark):
    base = [" ".join(f"w{(i * 37 + k * k) % 997}" for k in range(120)) for i in range(20)]
    texts = base + [t.replace("w1 ", "v1 ", 1) + " end" for t in base] + base[:5]
    docs = spark.createDataFrame(cases.rows(texts), cases.SCHEMA)
    assert sorted(r.doc_id for r in S.near_dedup(docs).collect()) == list(range(20))


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (300, 200), (300, 200)]
    got = {r.node: r.root for r in S.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100: 90, 95: 90, 300: 200}
    assert S.components(spark.createDataFrame([], "a long, b long")).collect() == []


def near_texts(pairs, share, seed=4):
    """Texts in pairs of a Jaccard similarity of share, of 120 shingles in all."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(pairs):
        same = [f"s{i}x{k}" for k in range(round(120 * share) + 2)]
        for side in "ab":
            out.append(" ".join(same + [f"{side}{i}y{k}" for k in range((120 - round(120 * share)) // 2)]))
    return [out[k] for k in rng.permutation(len(out))]


@pytest.mark.parametrize("shard", [1000, 8])
def test_near_copies_meet_at_any_number_of_shards(spark, shard):
    docs = spark.createDataFrame(cases.rows(near_texts(1000, 0.55)), cases.SCHEMA)
    signs = S.signed(docs).withColumnRenamed("doc_id", "node")
    pair = {}
    for i, t in enumerate(r.text for r in docs.orderBy("doc_id").collect()):
        pair.setdefault(re.match(r"s(\d+)x", t)[1], []).append(i)
    of = {}
    for r in S.routed(signs, shard).collect():
        of.setdefault(r.node, set()).add(r.shard)
    assert np.mean([bool(of[a] & of[b]) for a, b in pair.values()]) >= 0.95
    assert all(len(x) <= S.LAYOUTS for x in of.values()) or shard == 8


def test_signatures_against_one_by_one():
    import xxhash

    from tessera.llm.common import mix, rolling

    texts = ["a b c d a b c", "", "one", "one two", "?!", "w " * 900, " ".join(f"x{i}" for i in range(700)), "é 中文 z"]
    sig, sketch, least = S._signatures(pa.array(texts, pa.large_string()))
    for i, t in enumerate(texts):
        w = np.array([xxhash.xxh64_intdigest(x) for x in re.findall(r"[a-z0-9\u0080-\U0010ffff]+", t)], np.uint64)
        f = np.unique(rolling(w, min(3, len(w)))) if len(w) else np.array([xxhash.xxh64_intdigest(t)], np.uint64)
        h = mix(f[:, None] ^ S._LANES)
        assert (least[i] == mix(np.concatenate([h.min(0), h.max(0)])).view(np.int64)).all()
        ones = np.unpackbits(np.ascontiguousarray(h[:, :4]).view(np.uint8).reshape(len(f), 32), axis=1).sum(0, dtype=int)
        assert (np.packbits(2 * ones > len(f)).view(np.uint64) == sig[i]).all()
        want = {}
        for x in sorted(f.tolist()):
            want.setdefault(x >> 58, min((x >> 42) & 0xFFFF, 0xFFFE))
        assert sketch[i].tolist() == [want.get(b, 0xFFFF) for b in range(64)]


def test_ids_and_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5), (2, "a b c d e f", 6)], "doc_id int, text string, `a.b` int")
    got = S.near_dedup(docs)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(1, "a b c d e f", 5)]
    with pytest.raises(TypeError):
        S.near_dedup(docs.withColumn("doc_id", docs.doc_id.cast("string")))


def test_a_shard_that_is_too_large_is_split(spark):
    # the same passage holds the least hashes of most texts
    passage = " ".join(f"p{k}" for k in range(60))
    docs = spark.createDataFrame(cases.rows([passage + " " + t for t in near_texts(500, 0.9)]), cases.SCHEMA)
    got = S.routed(S.signed(docs).withColumnRenamed("doc_id", "node"), 50).groupBy("shard").count()
    assert got.agg({"count": "max"}).first()[0] < 500
    # a crowd shares all its least and greatest hashes: parts with anchors split it
    crowd = spark.createDataFrame(cases.rows([t + f" v{i} w{i}" for i, t in enumerate([near_texts(1, 0.9)[0] * 9] * 3000)]), cases.SCHEMA)
    got = S.routed(S.signed(crowd).withColumnRenamed("doc_id", "node"), 500).groupBy("shard").count()
    assert got.agg({"count": "max"}).first()[0] <= 1000 + 1.5 * S.ANCHORS and S.near_dedup(crowd, shard=500).count() == 1


def test_crowds_lose_no_link():
    # two crowds with a bridge between them, one without, passages that many share, and pairs
    rng = np.random.default_rng(5)
    word = lambda n: [f"z{x}" for x in rng.integers(0, 1 << 40, n)]
    base = [word(100) for _ in range(3)]
    texts = [" ".join(b[: 100 - k % 20] + word(k % 20)) for k in range(150) for b in base]
    texts += [" ".join(base[0][:75] + base[1][:75])] + [" ".join(base[2][:30] + word(60)) for _ in range(150)] + near_texts(100, 0.7)
    sig, sketch = S.signatures(pa.array(texts, pa.large_string()))
    x, y = np.nonzero(distance(sig[:, None], sig[None]) <= S.RADIUS)
    ok = (x != y) & (S.similarity(sketch[x], sketch[y]) >= S.SIMILAR)
    want = groups_of(zip(x[ok].tolist(), y[ok].tolist(), strict=True), range(len(texts)))
    assert (S._crowds(sig, sketch, S.RADIUS, S.SIMILAR) >= 0).sum() > 300
    a, b, alike = S._links(sig, sketch, S.RADIUS, S.SIMILAR - S.BELOW, S.SIMILAR + S.ABOVE)
    for least in (S.SIMILAR - S.BELOW, S.SIMILAR, 0.6, S.SIMILAR + S.ABOVE):
        ok = (x != y) & (S.similarity(sketch[x], sketch[y]) >= least)
        want = groups_of(zip(x[ok].tolist(), y[ok].tolist(), strict=True), range(len(texts)))
        some = alike >= least
        assert groups_of(zip(a[some].tolist(), b[some].tolist(), strict=True), range(len(texts))) == want and len(set(want.values())) > 100


def test_spanning_forest():
    rng = np.random.default_rng(3)
    for n, m in ((0, 0), (1, 3), (30, 20), (50, 400), (200, 5000)):
        x, y, w = rng.integers(0, max(n, 1), m), rng.integers(0, max(n, 1), m), rng.integers(0, 12, m) / 12
        got = S._spanning(x, y, w)
        assert len(got) == n - len(set(groups_of(zip(x.tolist(), y.tolist(), strict=True), range(n)).values()))
        for least in np.unique(w):
            best = got[w[got] >= least]
            want = groups_of(zip(x[w >= least].tolist(), y[w >= least].tolist(), strict=True), range(n))
            assert groups_of(zip(x[best].tolist(), y[best].tolist(), strict=True), range(n)) == want


def test_texts_that_share_a_passage_stay(spark):
    # similarities of 0.36 to 0.47: many pairs look similar by sketch, none is
    rng = np.random.default_rng(8)
    passage = [f"p{k}" for k in range(50)]
    texts = [" ".join(passage + [f"o{i}x{k}" for k in range(30 + i % 12)]) for i in range(500)]
    texts = [texts[i] for i in rng.permutation(500)] + near_texts(60, 0.6)
    _, sketch = S.signatures(pa.array(texts, pa.large_string()))
    x, y = np.triu_indices(500, 1)
    assert (S.similarity(sketch[x], sketch[y]) >= S.SIMILAR).sum() > 100
    docs = spark.createDataFrame(cases.rows(texts), cases.SCHEMA)
    kept = {r.doc_id for r in S.near_dedup(docs).collect()}
    assert set(range(500)) <= kept and len(kept) <= 500 + 65


def test_exact_verification(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    ids = sorted(sets)
    pairs = [(ids[0], i) for i in ids[1:]] + [(a, b) for a, b in zip(ids, ids[1:], strict=False)][1:]
    pairs += [(a, b) for a in ids[::9] for b in ids if a < b and b % 9 and sets[a] & sets[b]]
    pairs = sorted({(max(p), min(p)) for p in pairs})
    old, S.SALT = S.SALT, 50
    try:
        got = {tuple(r) for r in S._exact(docs, spark.createDataFrame(pairs, "a long, b long"), 0.1).collect()}
    finally:
        S.SALT = old
    assert got == {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.1 * len(sets[a] | sets[b])} and len(got) > 10


def test_graph_recall_in_a_large_shard():
    # pairs that differ in 69 bits, as those of a Jaccard similarity of a half do
    sig = planted(16_400, 800, (69, 70), seed=6)
    left, right = Graph(sig).within(sig, S.RADIUS)
    found = set(zip(left.tolist(), right.tolist(), strict=True))
    truth = [(int(np.argmin(distance(sig[:16_400], sig[i]))), i) for i in range(16_400, 17_200)]
    assert np.mean([p in found for p in truth]) >= 0.93


@pytest.mark.parametrize("share", [0.55, 0.7])
def test_no_pair_alike_by_sketch_is_lost_in_a_shard(share):
    # a passage of its own in every text makes large entries
    passage = " ".join(f"p{k}" for k in range(12))
    sig, sketch = S.signatures(pa.array([passage + " " + t for t in near_texts(1500, share)], pa.large_string()))
    left, right = Graph(sig, entries=sketch, alike=S.SIMILAR).within(sig, S.RADIUS)
    x, y = np.nonzero(distance(sig[:, None], sig[None]) <= S.RADIUS)
    ok = S.similarity(sketch[x], sketch[y]) >= S.SIMILAR
    want = set(zip(x[ok].tolist(), y[ok].tolist(), strict=True))
    assert want <= set(zip(left.tolist(), right.tolist(), strict=True)) and len(want) > 4000


def test_a_refused_edge_leaves_room_for_a_lesser_one(spark):
    # by sketch the first text is nearer to the third (similar by 0.492) than the second is (by 0.504)
    base = [f"b{k}" for k in range(90)]
    same = 61 + int(np.random.default_rng(196).integers(0, 3))
    texts = [[f"u196x{k}" for k in range(4)] + base, base + ["v196x0"], base[:same] + [f"w196x{k}" for k in range(28)]]
    texts = [" ".join(t) for t in texts]
    sets = [shingles(t) for t in texts]
    assert len(sets[0] & sets[2]) < S.SIMILAR * len(sets[0] | sets[2]) and len(sets[1] & sets[2]) >= S.SIMILAR * len(sets[1] | sets[2])
    sig, sketch = S.signatures(pa.array(texts, pa.large_string()))
    assert S.similarity(sketch[:1], sketch[2:])[0] > S.similarity(sketch[1:2], sketch[2:])[0] and distance(sig[1], sig[2]) <= S.RADIUS
    docs = spark.createDataFrame(cases.rows(texts), cases.SCHEMA)
    assert [r.doc_id for r in S.near_dedup(docs).collect()] == [0]


def test_shards_that_are_split_lose_no_link(spark):
    # most texts share the least hashes, by a passage: pairs of a similarity of 0.61 among texts of 0.41
    passage = [f"p{k}" for k in range(50)]
    texts = [" ".join(passage + [f"o{i // 2}x{k}" for k in range(14)] + [f"o{i}y{k}" for k in range(20)]) for i in range(700)]
    texts = [texts[i] for i in np.random.default_rng(50).permutation(len(texts))]
    pair = {}
    for i, t in enumerate(texts):
        pair.setdefault(re.search(r"o(\d+)x", t)[1], []).append(i)
    docs = spark.createDataFrame(cases.rows(texts), cases.SCHEMA)
    signs = S.signed(docs).withColumnRenamed("doc_id", "node")
    assert S._plan(signs, 16)[1] and len(pair) == 350
    got = {i: i for i in range(len(texts))} | {r.doc_id: r.keep for r in S.groups(docs, shard=16).collect()}
    sig, _ = S.signatures(pa.array(texts, pa.large_string()))
    want = {i: i for i in got} | {max(p): min(p) for p in pair.values() if distance(sig[p[0]], sig[p[1]]) <= S.RADIUS}
    assert got == want


@pytest.mark.parametrize("n", [3, 600])
def test_blocks_hold_all_pairs_that_differ_in_root(spark, n, monkeypatch):
    monkeypatch.setattr(S, "REST", max(1, n // 16))
    rows = [(s, 0, i, 0 if i % 3 else i) for s in (1, 2) for i in range(n // s)] + [(3, 0, i, 0) for i in range(9)]
    got = S._blocks(spark.createDataFrame(rows, "shard long, tree long, node long, root long")).collect()
    block, seen = {}, {1: set(), 2: set()}
    for r in got:
        block.setdefault((r.shard, r.main, r.i, r.j), ([], []))[r.right].append(r.node)
    for (s, main, i, j), (a, b) in block.items():
        assert max(len(a), len(b)) <= 2 * max(1, n // 16) * 1.5
        seen[s] |= {(min(p), max(p)) for x in a for p in ((x, y) for y in (a if not main and i == j else b))}
    root = lambda i: 0 if i % 3 else i
    for s in (1, 2):
        assert {(x, y) for x in range(0, n // s, 7) for y in range(x + 1, n // s) if root(x) != root(y)} <= seen[s]


def test_pairs_that_never_meet_in_a_shard_are_linked(spark):
    # of pairs similar by 0.52 some share none of the values that shards go by
    texts = near_texts(1000, 0.52, seed=9)
    docs = spark.createDataFrame(cases.rows(texts), cases.SCHEMA)
    pair = {}
    for r in docs.select("doc_id", "text").collect():
        pair.setdefault(re.match(r"s(\d+)x", r.text)[1], []).append(r.doc_id)
    sig, _ = S.signatures(pa.array(texts, pa.large_string()))
    want = {max(p): min(p) for p in pair.values() if distance(sig[p[0]], sig[p[1]]) <= S.RADIUS}
    of = {}
    for r in S.routed(S.signed(docs).withColumnRenamed("doc_id", "node"), 8).collect():
        of.setdefault(r.node, set()).add(r.shard)
    assert any(not of[a] & of[b] for a, b in want.items()) and len(want) > 700
    assert {r.doc_id: r.keep for r in S.groups(docs, shard=8).collect()} == want


@pytest.mark.parametrize("often", [64, 2])
def test_links_are_found_whole_without_any_shard(spark, often, monkeypatch):
    monkeypatch.setattr(S, "OFTEN", often)
    monkeypatch.setattr(S, "PART", 20_000)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    first = docs.groupBy("text").agg({"doc_id": "min"}).toDF("text", "doc_id").orderBy("doc_id").collect()
    sets, ids = [shingles(r.text) for r in first], [r.doc_id for r in first]
    sig, _ = S.signatures(pa.array([r.text for r in first], pa.large_string()))
    x, y = np.nonzero(distance(sig[:, None], sig[None]) <= S.RADIUS)
    pairs = [(ids[a], ids[b]) for a, b in zip(x.tolist(), y.tolist(), strict=True) if a < b and len(sets[a] & sets[b]) >= S.SIMILAR * len(sets[a] | sets[b])]
    nodes = S.signed(spark.createDataFrame([(r.doc_id, r.text) for r in first], "doc_id long, text string")).withColumnRenamed("doc_id", "node")
    none = spark.createDataFrame([], "node long, root long")
    got = S._missed(docs, S.checkpointed(nodes), none, S.RADIUS, S.SIMILAR).collect()
    assert {tuple(sorted(r)) for r in got} <= {tuple(sorted(p)) for p in pairs} and len(pairs) > 50
    assert groups_of(got, ids) == groups_of(pairs, ids)


def test_slices_that_do_not_fit_together_raise():
    docs = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["a b c d e", "a b c d f", "x y z"]})
    sent = pa.Table.from_batches(S._slices(iter([docs]), 4))
    part = np.array(sent.column("part"))
    shared = [S._shared(sent.filter(pa.array(part == p))) for p in np.unique(part)]
    got = S._prefixes(pa.concat_tables(shared), 0.5).to_pylist()
    assert [r["node"] for r in got] == [1, 2] and got[0]["code"] == got[1]["code"] and got[0]["often"] == [2]
    with pytest.raises(RuntimeError):
        S._prefixes(pa.concat_tables(shared[:-1]), 0.5)
