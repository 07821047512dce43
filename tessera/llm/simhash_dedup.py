"""SimHash near-deduplication by navigable small-world graphs.

1. A document's features are its distinct runs of three words (of all its words if fewer; the whole text if it has
   none). They give a SimHash of 256 bits, and for verification a one-permutation MinHash sketch of 64 values.
   Documents with equal signatures become one node.
2. Nodes are spread over shards of ``SHARD`` nodes or so, eight at least, by MinHash values of their features: one in
   each of ``LAYOUTS`` layouts. A pair of Jaccard similarity J has the same value, and so meets, in a layout with J at
   any number of shards: 1 - (1 - J) ** LAYOUTS, 0.98 at 0.5. A shard of over twice ``SHARD`` nodes, as many texts
   share the feature of least hash, is split by ``FRESH`` other MinHash values in the same manner, and its parts once
   more. What is still larger, a crowd of much the same text, is split evenly by the hash of the node, with ``ANCHORS``
   or so of its nodes in every part, by which the parts of the crowd are linked. So no shard has more than
   2 * SHARD + ANCHORS nodes or so, whatever the input; pairs that shards or splits part are met in step 6.
3. In each shard, groups of ``CROWD`` nodes or more that are all near copies of one of them beyond doubt are linked with it,
   and compared with all others block by block; a crowd costs no more than its number. Of the rest a graph
   (hamming_graph.py) is searched by all its nodes, within a Hamming radius. Searches start from all nodes that share one
   of the rarest values of the sketch, of so many that no pair is lost whose sketches are alike. The shard sends the
   spanning forest of greatest similarity by sketch, down to ``similar`` - BELOW, never more rows than it has nodes.
4. Each edge is verified. One of an estimate of ``similar`` + ABOVE, four standard deviations off, is taken; of all
   others the Jaccard similarity is computed from the hashes of all features of both texts, and has to be ``similar``.
5. The connected components of the verified edges are found by alternating star contractions.
6. What shards, splits, sketches and forests have left out is done in full, over all nodes (``_missed``). If all texts
   have their features in order of frequency, rarest first, then two of similarity ``similar`` have one in common among
   the first n - ceil(similar * n) + 1 of each, n its number. Nodes of different components that share such a feature
   are compared, within the radius by all features: as pairs, or where OFTEN nodes or more have the feature, in blocks
   of REST nodes on either side. Nodes of a block's largest component are laid beside the others only, so a crowd that
   is linked costs no more than its number; one that is not costs the square of it.
   Of each component then the smallest doc_id stays.

``audit`` measures recall against exact search for a sample of queries over all nodes.

Defined results: columns are those of the input. A null or empty text, or a null doc_id, has no near copies: such rows
stay. Of rows that share a doc_id one stays, the smallest by text and the other columns. doc_id is an integer; other
types raise. Columns may have any names. Texts are read in full, however long; a text without words is one feature. An
empty input gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import TMP, Words, checkpointed, mix, rolling, safe, slices, table, type_of, utf8
from tessera.llm.hamming_graph import Graph, distance

SHINGLE = 3
BINS = 64
RADIUS = 76
SIMILAR = 0.5
#: Estimates from ``similar`` - BELOW to ``similar`` + ABOVE are in doubt: a sketch errs by 0.06 or less (one s.d.).
BELOW, ABOVE = 0.125, 0.25
#: Edges of a node in doubt that one task joins with its features.
SALT = 1 << 10
#: Bits by which documents whose features are not needed are left out: 8 MB, whatever the input.
BITMAP = 1 << 26
SHARD = 1 << 12
LAYOUTS = 6
FRESH, DEPTH = 3, 2
LANES = LAYOUTS + FRESH * DEPTH
ANCHORS = 256
#: Nodes on either side of a block in which what the shards have left is compared.
REST = 1 << 10
#: Features that one task counts; a slice of documents sends half as many at once.
PART = 1 << 20
#: Nodes with a feature from which they are compared in blocks and not as pairs.
OFTEN = 64
#: Near copies of one node that are a crowd.
CROWD = 64
#: Pairs that are verified at once.
PAIRS = 1 << 18
#: Removed doc_ids that are broadcast at most.
BROADCAST_ROWS = 1_000_000
#: Features whose bits are unpacked at once.
BLOCK = 1 << 12
_LANES = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89, 0x452821E638D01377, 0xBE5466CF34E90C6C], np.uint64)


def signatures(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """SimHash (n, 4) of 64-bit words, sketch (n, BINS) of 16 bits."""
    return _signatures(texts)[:2]


def _features(words: Words, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of all texts, distinct, in order of both."""
    hashes, count = words.hashes(), words.counts()
    runs, place = rolling(hashes, SHINGLE), np.repeat(np.arange(len(count)), count)
    inside = np.flatnonzero(place[: len(runs)] == place[SHINGLE - 1 :]) if len(runs) else np.empty(0, np.int64)
    docs, features = [place[inside]], [runs[inside]]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(count == n)
        at = words.bounds[:-1][short]
        docs.append(short)
        features.append(rolling(hashes[at[:, None] + np.arange(n)].ravel(), n)[::n] if len(short) else np.empty(0, np.uint64))
    none = np.flatnonzero(count == 0)
    docs.append(none)
    features.append(np.array([xxhash.xxh64_intdigest(t) for t in texts.take(pa.array(none)).to_pylist()], np.uint64))
    doc, feature = np.concatenate(docs), np.concatenate(features)
    order = np.argsort(feature)
    order = order[np.argsort(doc[order].astype(np.uint16 if len(count) < 1 << 16 else np.int64), kind="stable")]
    doc, feature = doc[order], feature[order]
    first = np.append(True, (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])) if len(doc) else np.empty(0, bool)
    return doc[first], feature[first]


def _signatures(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of signatures, and (n, LANES) MinHash values of 64 bits: of the least hashes, then of the greatest."""
    return _measured(texts)[:3]


def _measured(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Those of _signatures, and the number of features."""
    n = len(texts)
    doc, feature = _features(Words(texts), texts)
    sketch = np.full((n, BINS), 0xFFFF, np.uint16)
    if not n:
        return np.zeros((0, 4), np.uint64), sketch, np.zeros((0, LANES), np.int64), np.zeros(0, np.int64)
    start = np.searchsorted(doc, np.arange(n + 1))  # each text has a feature at least
    bin_ = (feature >> np.uint64(58)).astype(np.int64)
    first = np.append(True, (doc[1:] != doc[:-1]) | (bin_[1:] != bin_[:-1]))
    sketch[doc[first], bin_[first]] = np.minimum((feature[first] >> np.uint64(42)) & np.uint64(0xFFFF), np.uint64(0xFFFE))
    # bits are counted in bytes, for runs of 255 features; then the runs are added up
    size = np.diff(start)
    runs = -(-size // 255)
    of = np.repeat(np.arange(n), runs)
    begin = start[of] + 255 * (np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs))
    end = np.minimum(begin + 255, start[of + 1])
    ones, least, most = np.empty((len(of), 256), np.uint8), np.empty((len(of), LAYOUTS), np.uint64), np.empty((len(of), LANES - LAYOUTS), np.uint64)
    at = 0
    while at < len(of):  # some runs at a time, as the bits take 256 bytes a feature
        to = max(at + 1, int(np.searchsorted(end, begin[at] + BLOCK, "right")))
        mixed = mix(feature[begin[at] : end[to - 1]][:, None] ^ _LANES)
        least[at:to] = np.minimum.reduceat(mixed, begin[at:to] - begin[at], axis=0)
        most[at:to] = np.maximum.reduceat(mixed[:, : LANES - LAYOUTS], begin[at:to] - begin[at], axis=0)
        bits = np.unpackbits(np.ascontiguousarray(mixed[:, :4]).view(np.uint8).reshape(-1, 32), axis=1)
        for k, (x, y) in enumerate(zip((begin[at:to] - begin[at]).tolist(), (end[at:to] - begin[at]).tolist(), strict=True), at):
            np.add.reduce(bits[x:y], 0, dtype=np.uint8, out=ones[k])
        at = to
    least, most = np.minimum.reduceat(least, np.cumsum(runs) - runs, axis=0), np.maximum.reduceat(most, np.cumsum(runs) - runs, axis=0)
    total = np.add.reduceat(ones, np.cumsum(runs) - runs, axis=0, dtype=np.int64)
    sig = np.packbits(2 * total > size[:, None], axis=1).view(np.uint64)
    return sig, sketch, mix(np.concatenate([least, most], axis=1)).view(np.int64), size


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of sketches, row by row."""
    used = ((a != 0xFFFF) | (b != 0xFFFF)).sum(1)
    return ((a == b) & (a != 0xFFFF)).sum(1) / np.maximum(used, 1)


def _fixed(rows: np.ndarray, width: int) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary()) if len(rows) else pa.array([], pa.binary())


def _rows(column: pa.Array | pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, sig, sketch, least, size) of the documents with an id and a text; size: the number of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sig, sketch, least, size = _measured(utf8(part.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * LANES), pa.array(least.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _fixed(sig, 32), _fixed(sketch, 2 * BINS), lists, pa.array(size)], names=["doc_id", "sig", "sketch", "least", "size"])

    if type_of(docs, "doc_id") not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("doc_id must be an integer here: it numbers the nodes")
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & (F.col("text") != ""))
    return some.mapInArrow(run, "doc_id long, sig binary, sketch binary, least array<long>, size long")


def _spanning(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the edges of a spanning forest of greatest weight: all components take their best edge at once."""
    order = np.argsort(-weight, kind="stable")
    nodes, at = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    x, y, edge, chosen = at[: len(a)], at[len(a) :], np.arange(len(a)), []
    n = len(nodes)
    live = x != y
    x, y, edge = x[live], y[live], edge[live]
    while len(x):
        best = np.full(n, len(a))
        np.minimum.at(best, x, edge)
        np.minimum.at(best, y, edge)
        own = np.flatnonzero(best < len(a))
        where = np.searchsorted(edge, best[own])
        label = np.arange(n)
        label[own] = x[where] + y[where] - own  # the other end
        both = label[label] == np.arange(n)  # two that take the same edge
        label = np.where(both, np.minimum(label, np.arange(n)), label)
        chosen.append(np.unique(best[own]))
        while ((deep := label[label]) != label).any():
            label = deep
        x, y = label[x], label[y]
        live = x != y
        x, y, edge = x[live], y[live], edge[live]
    return order[np.concatenate(chosen)] if chosen else np.empty(0, np.int64)


def _router(count: int, again: list[dict[int, tuple[int, int]]], crowds: dict[int, tuple[int, int, int]], columns: tuple[str, ...]):
    """Arrow function: each node with its shards, of ``count`` in each layout. again: by depth, of shards that are split
    the number of the first part and of parts; crowds: of parts that are split evenly, also the number of nodes."""

    def arrays(of: dict, width: int) -> tuple[np.ndarray, ...]:
        keys = np.array(sorted(of), np.int64)
        return keys, *(np.array([of[k][i] for k in keys.tolist()], np.int64) for i in range(width))

    splits, (even, begin, lots, size) = [arrays(x, 2) for x in again], arrays(crowds, 3)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                least = part.column("least").flatten().to_numpy().reshape(-1, LANES)
                to = (np.arange(LAYOUTS) * count + least[:, :LAYOUTS] % count).ravel()
                row = np.repeat(np.arange(part.num_rows), LAYOUTS)
                for depth, (split, first, parts) in enumerate(splits):
                    if len(split) and (more := np.isin(to, split)).any():
                        at, some, lane = np.searchsorted(split, to[more]), row[more], LAYOUTS + depth * FRESH
                        fresh = first[at][:, None] + np.arange(FRESH) * parts[at][:, None] + least[some, lane : lane + FRESH] % parts[at][:, None]
                        to, row = np.concatenate([to[~more], fresh.ravel()]), np.concatenate([row[~more], np.repeat(some, FRESH)])
                if len(even) and (more := np.isin(to, even)).any():
                    at, some = np.searchsorted(even, to[more]), row[more]
                    hashed = mix(part.column("node").to_numpy()[some].view(np.uint64))
                    anchor = hashed.astype(np.float64) / 2.0**64 * size[at] < ANCHORS
                    copies = np.where(anchor, lots[at], 1)
                    nth = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                    own = np.repeat(np.where(anchor, 0, (hashed % lots[at].astype(np.uint64)).astype(np.int64)), copies)
                    to, row = np.concatenate([to[~more], np.repeat(begin[at], copies) + own + nth]), np.concatenate([row[~more], np.repeat(some, copies)])
                yield pa.RecordBatch.from_arrays([pa.array(to)] + [part.column(c).take(pa.array(row)) for c in columns], names=["shard", *columns])

    return route


def _plan(nodes: DataFrame, shard: int) -> tuple[int, list[dict[int, tuple[int, int]]], dict[int, tuple[int, int, int]]]:
    """How nodes are routed: the arguments of _router but the columns."""
    count = max(8, math.ceil(nodes.count() / shard))
    base, again, crowds = LAYOUTS * count, [], {}

    def large() -> list[tuple[int, int]]:
        sizes = nodes.mapInArrow(_router(count, again, {}, ()), "shard long").groupBy("shard").count()
        return sorted(tuple(r) for r in sizes.where(F.col("count") > 2 * shard).collect())

    while (hot := large()) and len(again) < DEPTH:
        again.append({})
        for at, n in hot:
            again[-1][at] = base, math.ceil(n / shard)
            base += FRESH * again[-1][at][1]
    for at, n in hot:
        crowds[at] = base, math.ceil(n / shard), n
        base += crowds[at][1]
    return count, again, crowds


def routed(nodes: DataFrame, shard: int) -> DataFrame:
    """(shard, node, sig, sketch): each node with all shards that it is in."""
    return _routed(nodes, _plan(nodes, shard))


def _routed(nodes: DataFrame, plan: tuple) -> DataFrame:
    return nodes.mapInArrow(_router(*plan, ("node", "sig", "sketch")), "shard long, node long, sig binary, sketch binary")


def _crowds(sig: np.ndarray, sketch: np.ndarray, radius: int, similar: float) -> np.ndarray:
    """The group of each node, -1 for none: a group is CROWD nodes or more that are near copies of its leader, which
    its number names. Leaders are looked for among nodes of whose sketch values at least ``similar`` are so frequent."""
    n, group = len(sig), np.full(len(sig), -1)
    often = np.zeros(sketch.shape, np.int32)
    for t in range(sketch.shape[1]):
        _, at, size = np.unique(sketch[:, t], return_inverse=True, return_counts=True)
        often[:, t] = np.where(sketch[:, t] == 0xFFFF, 0, size[at])
    used = (sketch != 0xFFFF).sum(1)
    enough = np.sort(often, 1)[np.arange(n), BINS - np.maximum(1, np.ceil(used * similar).astype(np.int64))]
    for leader in np.argsort(-enough, kind="stable")[: int((enough >= CROWD).sum())].tolist():
        if group[leader] < 0:
            free = np.flatnonzero(group < 0)
            near = free[distance(sig[free], sig[leader]) <= radius]
            near = near[similarity(sketch[near], sketch[leader]) >= similar]
            if len(near) >= CROWD:
                group[near] = leader
    return group


def _links(sig: np.ndarray, sketch: np.ndarray, radius: int, least: float, sure: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest of greatest similarity by sketch of the pairs within the radius that reach ``least``; beyond
    ``sure`` any links do, as there an edge need not be the best one."""
    group = _crowds(sig, sketch, radius, sure)
    inside, free = np.flatnonzero(group >= 0), np.flatnonzero(group < 0)
    left, right, weight = [inside], [group[inside]], [similarity(sketch[inside], sketch[group[inside]])]

    def kept(x: np.ndarray, y: np.ndarray) -> bool:
        found = False
        for k in range(0, len(x), PAIRS):
            a, b = x[k : k + PAIRS], y[k : k + PAIRS]
            alike = similarity(sketch[a], sketch[b])
            same = np.flatnonzero(alike >= least)
            same = same[_spanning(a[same], b[same], alike[same])]
            left.append(a[same])
            right.append(b[same])
            weight.append(alike[same])
            found |= bool((alike[same] >= sure).any())
        return found

    def compared(x: np.ndarray, y: np.ndarray) -> Iterator[bool]:
        for k in range(0, len(x), 256):
            some = x[k : k + 256]
            d = sum(np.bitwise_count(sig[some, w][:, None] ^ sig[y, w][None]).astype(np.uint16) for w in range(4))
            a, b = np.nonzero(d <= radius)
            yield kept(some[a], y[b])

    leaders = np.unique(group[inside]).tolist()
    for i, one in enumerate(leaders):
        members = np.flatnonzero(group == one)
        for _ in compared(free, members):
            pass
        for other in leaders[:i]:
            any(compared(members, np.flatnonzero(group == other)))  # one sure link is enough: each group is linked in itself
    graph = Graph(sig[free], entries=sketch[free], alike=least)
    for at in range(0, len(free), 4096):
        x, y = graph.near(at, at + 4096, radius)
        kept(free[x[x < y]], free[y[x < y]])
        kept(free[x[x > y]], free[y[x > y]])
    a, b, w = np.concatenate(left), np.concatenate(right), np.concatenate(weight)
    best = _spanning(a, b, w)
    return a[best], b[best], w[best]


def edges(nodes: DataFrame, plan: tuple, radius: int = RADIUS, similar: float = SIMILAR) -> DataFrame:
    """(a, b, alike): for each shard the spanning forest of greatest similarity by sketch, of pairs that may be similar.
    nodes: (node, sig, sketch, least), computed; plan: of _plan."""

    def search(rows: pa.Table) -> pa.Table:
        node = rows.column("node").to_numpy()
        order = np.argsort(node, kind="stable")
        node, sig, sketch = node[order], _rows(rows.column("sig"), np.uint64, 4)[order], _rows(rows.column("sketch"), np.uint16, BINS)[order]
        x, y, alike = _links(sig, sketch, radius, similar - BELOW, similar + ABOVE)
        a, b = node[np.maximum(x, y)], node[np.minimum(x, y)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "alike": pa.array(alike, pa.float64())})

    return _routed(nodes, plan).groupBy("shard").applyInArrow(search, "a long, b long, alike double")


def _chosen(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, Callable]:
    """(doc_id, text, h) of docs, and an Arrow function that leaves out most rows of it whose doc_id is not in ids."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP))
    words = ids.select(bit.alias("h")).groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(BITMAP // 64, np.int64)
    bitmap[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy()
            some = batch.filter(pa.array((sent.value[h >> 6] >> (h & 63)) & 1 == 1))
            if some.num_rows:
                yield some

    some = docs.where(F.col("doc_id").isNotNull() & (F.col("text") != "")).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return some.select("doc_id", "text", bit.alias("h")), needed


def _featured(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """The rows of ends, computed, of a doc_id each, with the hashes of all features of their texts; computed."""
    some, needed = _chosen(docs, ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(needed(batches), "text"):
            texts = utf8(part.column("text"))
            doc, feature = _features(Words(texts), texts)
            start = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(start), pa.array(feature.view(np.int64)))], names=["doc_id", "features"])

    return checkpointed(some.mapInArrow(run, "doc_id long, features array<long>").join(ends, "doc_id"))


def _exact(docs: DataFrame, pairs: DataFrame, similar: float) -> DataFrame:
    """Those of the distinct pairs (a, b) of doc_ids, computed, whose features have a Jaccard similarity of ``similar``.

    Only features of documents in such pairs are moved: once for their own pairs, by a node and SALT of its pairs, and
    once for each pair."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.ceil(F.count("*") / SALT).alias("lots"))
    ends = checkpointed(ends)
    features = _featured(docs, ends)
    salted = features.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("salt"), "features")
    lots = ends.select(F.col("doc_id").alias("node"), "lots")
    both = pairs.join(lots.toDF("a", "la"), "a").join(lots.toDF("b", "lb"), "b")
    both = both.select("a", "b", F.pmod(F.xxhash64("b"), "la").alias("sa"), F.pmod(F.xxhash64("a"), "lb").alias("sb"))
    both = both.join(salted.toDF("a", "sa", "fa"), ["a", "sa"]).join(salted.toDF("b", "sb", "fb"), ["b", "sb"])
    shared = F.size(F.array_intersect("fa", "fb"))
    return both.where(shared >= similar * (F.size("fa") + F.size("fb") - shared)).select("a", "b")


def verified(docs: DataFrame, found: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(a, b) of the edges (a, b, alike), computed, that are similar by estimate beyond doubt, or else by all features."""
    sure = F.col("alike") >= similar + ABOVE
    doubt = checkpointed(found.where(~sure).select("a", "b").distinct())
    taken = found.where(sure).select("a", "b")
    return taken if doubt.isEmpty() else taken.unionByName(_exact(docs, doubt, similar))


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of each node of the edges (a, b): root is the least node of its component. Alternating stars."""
    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = checkpointed(df)
        return df, tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    pairs, sign = written(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").distinct()
        small = down.groupBy("a").agg(F.min("b").alias("m"))
        star = down.join(small, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        pairs, new = written(star.where("a <> b").distinct())
        if new == sign:  # the same pairs, by their number and the sum of their hashes
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        sign = new


def _apart(sig: np.ndarray, label: np.ndarray, right: np.ndarray, radius: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a block within the radius, of different labels (which may change meanwhile), by some nodes of the left
    side at a time: with nodes of the right one, or with each other if it is the block's own."""
    left = np.flatnonzero(~right)
    other = left if own else np.flatnonzero(right)
    for k in range(0, len(left), 256):
        some = left[k : k + 256]
        to = other[k + 1 :] if own else other
        if len(to) and (label[some][:, None] != label[to]).any():
            d = sum(np.bitwise_count(sig[some, w][:, None] ^ sig[to, w][None]).astype(np.uint16) for w in range(4))
            x, y = np.nonzero((d <= radius) & (label[some][:, None] != label[to]))
            x, y = some[x], to[y]
            x, y = (x[x < y], y[x < y]) if own else (x, y)
            if len(x):
                yield x, y


def _confirmed(sig: np.ndarray, root: np.ndarray, right: np.ndarray, code: np.ndarray, start: np.ndarray, radius: int, similar: float, own: bool) -> list[tuple[int, int]]:
    """Pairs of different roots that join all nodes of a block that are linked: within the radius and ``similar`` by all
    features, which are code[start[i] : start[i + 1]] of node i, as numbers."""
    label, size, out = root.copy(), np.diff(start), []
    mark = np.zeros(int(code.max(initial=-1)) + 1, bool)
    for x, y in _apart(sig, label, right, radius, own):
        own_x, first = np.unique(x, return_index=True)
        for one, ys in zip(own_x.tolist(), np.split(y, first[1:]), strict=True):
            ys = ys[label[ys] != label[one]]
            ys = ys[(size[ys] >= similar * size[one]) & (size[one] >= similar * size[ys])]
            mark[code[start[one] : start[one + 1]]] = True
            for k in range(0, len(ys), 256):
                part = ys[k : k + 256]
                bounds = np.append(0, np.cumsum(size[part]))
                at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - start[part], size[part])
                shared = np.add.reduceat(mark[code[at]], bounds[:-1], dtype=np.int64)
                linked = np.unique(label[part[shared >= similar * (size[one] + size[part] - shared)]])
                linked = linked[linked != label[one]]
                out += [(max(int(label[one]), r), min(int(label[one]), r)) for r in linked.tolist()]
                label[np.isin(label, linked)] = label[one]
            mark[code[start[one] : start[one + 1]]] = False
    return out


def _blocks(members: DataFrame) -> DataFrame:
    """Members (shard, tree, node, root) of groups in blocks (shard, tree, main, i, j), of REST nodes or so on either side
    (right or not), so that each two of a group that differ in root meet in one: those of its most frequent root, if
    they are many, are only laid beside the others."""
    group = ["shard", "tree"]
    sizes = members.groupBy(*group, "root").agg(F.count("*").alias("n")).groupBy(*group)
    sizes = sizes.agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.max("n").alias("big"), F.sum("n").alias("all"))
    few = F.col("all") <= 2 * REST
    sizes = sizes.where("all > big").select(
        *group,
        F.when(~few, F.col("most")).alias("most"),
        F.when(few, 1).otherwise(F.ceil((F.col("all") - F.col("big")) / REST)).alias("lots"),
        F.when(few, 0).otherwise(F.ceil(F.col("big") / REST)).alias("mains"),
    )
    hashed = F.xxhash64("node", F.lit(7))
    rows = members.join(sizes, group).withColumn("is_main", F.coalesce(F.col("root") == F.col("most"), F.lit(False)))
    rows = rows.withColumn("p", F.pmod(hashed, F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("lots"))))
    place = "named_struct('main', {}, 'i', {}, 'j', {}, 'right', {})".format
    beside = f"transform(sequence(0L, lots - 1), q -> {place('true', 'q', 'p', 'true')})"
    each = f"transform(sequence(0L, lots - 1), q -> {place('false', 'least(p, q)', 'greatest(p, q)', 'p > q')})"
    main = f"transform(filter(sequence(0L, mains), q -> q < mains), q -> {place('true', 'p', 'q', 'false')})"
    rows = rows.withColumn("at", F.explode(F.expr(f"if(is_main, {beside}, concat({each}, {main}))")))
    return rows.select(*group, "at.main", "at.i", "at.j", "at.right", "node", "root")


def _rest(docs: DataFrame, nodes: DataFrame, members: DataFrame, radius: int, similar: float) -> DataFrame:
    """Pairs (a, b) of roots that join all members (shard, tree, node, root), computed, of a group that are linked: each
    two of a group that differ in root and lie within the radius are compared by all features, however many they are."""
    block = ["shard", "tree", "main", "i", "j"]

    def read(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        one = rows.slice(0, 1).to_pylist()[0]
        return _rows(rows.column("sig"), np.uint64, 4), rows.column("root").to_numpy(), rows.column("right").to_numpy(), not one["main"] and one["i"] == one["j"]

    def near(rows: pa.Table) -> pa.Table:
        sig, root, right, own = read(rows)
        some = np.zeros(len(sig), bool)
        for x, y in _apart(sig, root, right, radius, own):
            some[x] = some[y] = True
        return rows.filter(pa.array(some))

    def confirm(rows: pa.Table) -> pa.Table:
        sig, root, right, own = read(rows)
        lists = rows.column("features").combine_chunks()
        start = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        code = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        pairs = np.array(_confirmed(sig, root, right, code, start, radius, similar, own), np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    rows = _blocks(members).join(nodes.select("node", "sig"), "node").select(*block, "right", "node", "root", "sig")
    rows = checkpointed(rows.groupBy(*block).applyInArrow(near, rows.schema))
    if rows.isEmpty():
        return rows.select(F.col("node").alias("a"), F.col("root").alias("b"))
    features = _featured(docs, checkpointed(rows.select(F.col("node").alias("doc_id")).distinct()))
    rows = rows.join(features.select(F.col("doc_id").alias("node"), "features"), "node")
    return checkpointed(rows.groupBy(*block).applyInArrow(confirm, "a long, b long"))


def _slices(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Features of documents in slices, cut by parts of the features' range: rows (slice, part, n, idx, value), with the
    document's place in the slice (16 bits) and the rest of the feature (32 bits). A slice also has a row of a negative
    part, with the ids and sizes of its documents and the number n of its other rows."""
    ids, doc, feature, count = [], [], [], 0

    def flush() -> pa.RecordBatch:
        own, at, code = np.concatenate(ids), np.concatenate(doc), np.concatenate(feature)
        part = code >> np.uint64(32)
        part *= np.uint64(parts)
        part >>= np.uint64(32)
        part = part.astype(np.uint16 if parts < 1 << 16 else np.int64)
        order = np.argsort(part, kind="stable")
        part, at, code = part[order], at[order], code[order].astype(np.uint32)
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        bounds = list(zip(first.tolist(), np.append(first[1:], len(part)).tolist(), strict=True))
        name = xxhash.xxh64_intdigest(own.tobytes()) >> 1
        idx = [np.bincount(at, minlength=len(own)).astype(np.int64).tobytes()] + [at[x:y].tobytes() for x, y in bounds]
        value = [own.tobytes()] + [code[x:y].tobytes() for x, y in bounds]
        part = np.append(-1 - name % parts, part[first].astype(np.int64))
        arrays = [pa.array(np.full(len(part), name)), pa.array(part), pa.array(np.full(len(part), len(bounds))), pa.array(idx, pa.binary()), pa.array(value, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["slice", "part", "n", "idx", "value"])

    for batch in slices(batches, "text"):
        for start in range(0, batch.num_rows, 1 << 14):
            some = batch.slice(start, 1 << 14)
            texts = utf8(some.column("text"))
            place, own = _features(Words(texts), texts)
            doc.append((place + count).astype(np.uint16))
            feature.append(own)
            ids.append(some.column("doc_id").to_numpy())
            count += len(texts)
            if count > 1 << 15 or sum(map(len, feature)) >= PART // 2:
                yield flush()
                ids, doc, feature, count = [], [], [], 0
    if count:
        yield flush()


def _shared(rows: pa.Table) -> pa.Table:
    """Of the rows of a part of _slices the features that occur twice or more, with the number, up to 255."""
    if rows.column("part").slice(0, 1).to_pylist()[0] < 0:
        return rows.append_column("often", pa.array([b""] * len(rows), pa.binary()))
    bounds = np.cumsum([0] + [len(v) // 4 for v in rows.column("value").to_pylist()])
    idx, value = _rows(rows.column("idx"), np.uint16, 1).ravel(), _rows(rows.column("value"), np.uint32, 1).ravel()
    order = value.astype(np.uint64)
    order <<= np.uint64(32)
    order |= np.arange(len(value), dtype=np.uint64)
    order.sort()
    first = np.flatnonzero(np.append(True, np.diff(order >> np.uint64(32)) != 0))
    size = np.diff(np.append(first, len(order)))
    often = np.empty(len(value), np.uint8)
    often[(order & np.uint64(0xFFFFFFFF)).astype(np.int64)] = np.repeat(np.minimum(size, 255), size)
    kept = [x + np.flatnonzero(often[x:y] > 1) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    table_ = rows.select(["slice", "part", "n"])
    for name, of in (("idx", idx), ("value", value), ("often", often)):
        table_ = table_.append_column(name, pa.array([of[k].tobytes() for k in kept], pa.binary()))
    return table_


def _prefixes(rows: pa.Table, similar: float) -> pa.Table:
    """(node, code, often) of the documents of a slice of which links are possible: codes of the features that some text
    may have in common with it first, if all texts have theirs in order of frequency and code."""
    part = rows.column("part").to_numpy()
    head = np.flatnonzero(part < 0)
    if len(head) != 1 or rows.column("n").to_pylist()[head[0]] != len(part) - 1:
        raise RuntimeError("the documents came in another order when a lost task was done again")
    node, size = (np.frombuffer(rows.column(c)[int(head[0])].as_py(), np.int64) for c in ("value", "idx"))
    body = rows.filter(pa.array(part >= 0))
    idx, value, often = (_rows(body.column(c), kind, 1).ravel() for c, kind in (("idx", np.uint16), ("value", np.uint32), ("often", np.uint8)))
    code = np.repeat(part[part >= 0].astype(np.int64), [len(x) for x in body.column("often").to_pylist()]) << 32 | value.astype(np.int64)
    alone = size - np.bincount(idx, minlength=len(node))  # come first, and have nothing to meet
    room = size - np.ceil(size * similar - 1e-9).astype(np.int64) + 1 - alone
    some = np.flatnonzero(room[idx] > 0)
    some = some[np.lexsort((code[some], often[some], idx[some]))]
    doc = idx[some]
    some = some[np.arange(len(some)) - np.searchsorted(doc, doc) < room[doc]]
    own, count = np.unique(idx[some], return_counts=True)
    start = pa.array(np.append(0, np.cumsum(count)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(start, pa.array(x)) for x in (code[some], often[some].astype(np.int32))]
    return pa.table({"node": pa.array(node[own]), "code": lists[0], "often": lists[1]})


def _met(rows: pa.Table) -> pa.Table:
    """Distinct pairs (a, b) of nodes that share a code and differ in root; rows: (part, code, node, root)."""
    code, node, root = (rows.column(c).to_numpy() for c in ("code", "node", "root"))
    order = np.lexsort((node, code))
    code, node, root = code[order], node[order], root[order]
    found, k = [np.empty((0, 2), np.int64)], 1
    at = np.arange(len(code) - k)
    while len(at := at[at + k < len(code)]) and len(at := at[code[at] == code[at + k]]):
        apart = at[root[at] != root[at + k]]
        found.append(np.stack([node[apart + k], node[apart]], 1))
        k += 1
    pairs = np.concatenate(found)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    pairs = pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(1))] if len(pairs) else pairs
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _missed(docs: DataFrame, nodes: DataFrame, roots: DataFrame, radius: int, similar: float) -> DataFrame:
    """Pairs (a, b) of roots that join all nodes that are linked: of all pairs of nodes there are, whether they have met
    in a shard or not, those of different roots are found by their prefixes, and compared by all features."""
    parts = max(8, math.ceil((nodes.agg(F.sum("size")).first()[0] or 0) / PART))
    some, needed = _chosen(docs, nodes.select(F.col("node").alias("doc_id")))
    sent = some.mapInArrow(lambda batches: _slices(needed(slices(batches, "text")), parts), "slice long, part long, n long, idx binary, value binary")
    shared = sent.groupBy("part").applyInArrow(_shared, "slice long, part long, n long, idx binary, value binary, often binary")
    prefixes = shared.groupBy("slice").applyInArrow(lambda rows: _prefixes(rows, similar), "node long, code array<long>, often array<int>")
    ends = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    prefixes = checkpointed(prefixes.join(ends, "node"))
    rows = prefixes.select("node", "root", F.explode(F.arrays_zip("code", "often")).alias("at")).select("node", "root", "at.code", "at.often")
    few = rows.where(F.col("often") < OFTEN).select(F.shiftright("code", 32).alias("part"), "code", "node", "root")
    pairs = few.groupBy("part").applyInArrow(_met, "a long, b long").distinct()
    sig = nodes.select("node", "sig")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distance(_rows(batch.column("x"), np.uint64, 4), _rows(batch.column("y"), np.uint64, 4))
            yield batch.select(["a", "b"]).filter(pa.array(far <= radius))

    pairs = pairs.join(sig.toDF("a", "x"), "a").join(sig.toDF("b", "y"), "b").select("a", "b", "x", "y")
    pairs = checkpointed(pairs.mapInArrow(near, "a long, b long"))
    if not pairs.isEmpty():
        pairs = _exact(docs, pairs, similar).join(ends.toDF("a", "ra"), "a").join(ends.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    members = rows.where(F.col("often") >= OFTEN).select(F.col("code").alias("shard"), F.lit(0).cast("long").alias("tree"), "node", "root")
    return pairs.unionByName(_rest(docs, nodes, checkpointed(members.distinct()), radius, similar))


def _roots(docs: DataFrame, nodes: DataFrame, radius: int, similar: float, shard: int) -> DataFrame:
    """(node, root) of the nodes, computed, that are linked with a smaller one: root is the least of all linked."""
    found = checkpointed(edges(nodes, _plan(nodes, shard), radius, similar))
    roots = components(verified(docs, found, similar))
    more = checkpointed(_missed(docs, nodes, roots, radius, similar))
    if more.isEmpty():
        return roots
    more = components(more)
    old = roots.join(more.toDF("root", "least"), "root", "left").select("node", F.coalesce("least", "root").alias("root"))
    return checkpointed(old.unionByName(more))


def groups(docs: DataFrame, radius: int = RADIUS, similar: float = SIMILAR, shard: int = SHARD) -> DataFrame:
    """(doc_id, keep) of each document that has a smaller near copy, or one it is linked with: keep is the one that stays."""
    return _groups(docs, checkpointed(signed(docs)), radius, similar, shard)


def _groups(docs: DataFrame, signs: DataFrame, radius: int, similar: float, shard: int) -> DataFrame:
    grouped = signs.groupBy("sig", "sketch").agg(F.min("doc_id").alias("node"), F.min_by("least", "doc_id").alias("least"), F.min_by("size", "doc_id").alias("size"))
    nodes = checkpointed(grouped.select("node", "sig", "sketch", "least", "size"))
    roots = _roots(docs, nodes, radius, similar, shard)
    of = signs.join(nodes, ["sig", "sketch"]).select("doc_id", "node").join(roots, "node", "left")
    return of.select("doc_id", F.coalesce("root", "node").alias("keep")).where("doc_id <> keep")


def near_dedup(docs: DataFrame, radius: int = RADIUS, similar: float = SIMILAR, shard: int = SHARD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs of which one of each group of near copies stays; the columns of docs."""
    original, docs = docs.columns, safe(docs, "doc_id", "text")
    names = docs.columns
    repeated = checkpointed(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not repeated.isEmpty():
        again = docs.join(repeated, "doc_id", "left_semi").withColumn(TMP + "json", F.to_json(F.struct(F.struct("text"), *[c for c in names if c not in ("doc_id", "text")])))
        once = again.groupBy("doc_id").agg(F.min_by(F.struct(*names), F.struct(F.col("text").isNull(), TMP + "json")).alias(TMP + "row")).select(TMP + "row.*")
        docs = docs.join(repeated, "doc_id", "left_anti").unionByName(once)
    gone = checkpointed(_groups(docs, checkpointed(signed(docs)), radius, similar, shard).select("doc_id"))
    gone = F.broadcast(gone) if gone.count() <= broadcast_rows else gone.hint("shuffle_hash")
    return docs.join(gone, "doc_id", "left_anti").select(*names).toDF(*original)


def audit(docs: DataFrame, radius: int = RADIUS, similar: float = SIMILAR, queries: int = 200) -> tuple[int, int]:
    """For queries chosen by hash, over all nodes: pairs that exact search finds, and those of them in one group."""
    signs = checkpointed(signed(docs))
    nodes = checkpointed(signs.groupBy("sig", "sketch").agg(F.min("doc_id").alias("node"), F.min_by("least", "doc_id").alias("least"), F.min_by("size", "doc_id").alias("size")))
    asked = nodes.orderBy(F.xxhash64("node", F.lit(3)), "node").limit(queries).toArrow()
    node, sig, sketch = asked.column("node").to_numpy(), _rows(asked.column("sig"), np.uint64, 4), _rows(asked.column("sketch"), np.uint16, BINS)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                other = part.column("node").to_numpy()
                x, y = np.nonzero(distance(sig[:, None], _rows(part.column("sig"), np.uint64, 4)[None]) <= radius)
                alike = similarity(sketch[x], _rows(part.column("sketch"), np.uint16, BINS)[y])
                near = node[x] != other[y]
                yield pa.RecordBatch.from_arrays([pa.array(node[x[near]]), pa.array(other[y[near]]), pa.array(alike[near])], names=["a", "b", "alike"])

    true = verified(docs, checkpointed(nodes.select("node", "sig", "sketch").mapInArrow(exact, "a long, b long, alike double")), similar)
    roots = _roots(docs, nodes, radius, similar, SHARD)
    ra, rb = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    both = true.join(ra, "a", "left").join(rb, "b", "left").select((F.coalesce("ra", "a") == F.coalesce("rb", "b")).cast("int").alias("ok"))
    n, ok = both.agg(F.count("*"), F.sum("ok")).first()
    return n, ok or 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
