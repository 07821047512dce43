"""Toxicity: a factorization machine over hashed words.

score = sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j>) over the distinct words of a document; the pair term is computed
as half of (sum v)^2 - sum v^2. Pairs of words count beyond their sum, so an insult along with a mention of a group can
weigh more than either. Words are those of common.Words, hashed into ``BUCKETS``.

Training reads at most ``train_rows`` labelled documents of each class, chosen by the hash of doc_id (the only
sampling), on the driver. Features in ``MIN_DOCS`` documents have factors, so that words that do not tell alone can in
pairs. Weights of their own go to those that set the classes apart by a G-test of ``MIN_G`` or are in a share of
``FREQUENT`` of the documents; thousands of others would only add noise to long texts.
The threshold is the one of best F1 on a fifth that is held out, midway to the next lower score; the weights are then
learnt from all of the sample. All documents are scored, over whole texts.

Defined results: a null or empty text scores as no words at all and is never rejected. Repeated rows score alike.
Without labels of both classes nothing is rejected and scores are 0. Labels null or of unknown documents are ignored.
doc_id may be of any type that has an order. ``without_toxic`` keeps all columns, whatever their names; ``toxicity``
those of its own only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Words, mapped, slices, sums, table, type_of, utf8

BUCKETS = 1 << 20
FACTORS = 6
TRAIN_ROWS = 4000
MIN_DOCS = 3
MIN_G = 10.8
FREQUENT = 0.2
#: AdaGrad starts from this for features without a weight of their own: chance gradients hardly move their factors.
DAMPING = 0.1
EPOCHS = 12


def features(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words of each text, sorted, and their bounds."""
    words = Words(utf8(part.column("text")))
    doc = np.repeat(np.arange(part.num_rows, dtype=np.uint64), words.counts())
    key = np.sort((doc << np.uint64(20)) | (words.hashes() & np.uint64(BUCKETS - 1)))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return (key & np.uint64(BUCKETS - 1)).astype(np.int32), np.searchsorted(key >> np.uint64(20), np.arange(part.num_rows + 1, dtype=np.uint64))


class Machine:
    def __init__(self, factors: int = FACTORS):
        self.known = np.zeros(BUCKETS, np.int32)  # bucket -> row of the weights; row 0 is all zeros
        self.w = np.zeros((1, 1 + factors), np.float32)
        self.bias, self.threshold = -20.0, 0.5

    def margin(self, feats: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        row = self.known[feats]
        live = row > 0
        kept = np.concatenate([[0], np.cumsum(live)])[bounds]
        x = self.w[row[live]].astype(np.float64)
        total = sums(x, kept)
        return self.bias + total[:, 0] + 0.5 * ((total[:, 1:] ** 2).sum(1) - sums((x[:, 1:] ** 2).sum(1), kept))

    def score(self, feats: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(feats, bounds), -60, 60)))

    def fit(self, docs: list[np.ndarray], y: np.ndarray, seed: int = 7, l2: float = 1e-3, rate: float = 0.1) -> Machine:
        """AdaGrad on the logistic loss, both classes of the same weight."""
        rng = np.random.default_rng(seed)
        enough, telling = _telling(docs, y)
        kept = np.flatnonzero(enough)
        linear = np.append(False, telling[kept])
        self.known[:] = 0
        self.known[kept] = np.arange(1, len(kept) + 1)
        k = self.w.shape[1] - 1
        w = np.concatenate([np.zeros((len(kept) + 1, 1)), rng.normal(0, 0.01, (len(kept) + 1, k))], 1)
        w[0] = 0
        seen, bias, seen_bias = np.where(linear[:, None], 1e-6, DAMPING) * np.ones_like(w), 0.0, 1e-6
        rows = [r[r > 0] for r in (self.known[d] for d in docs)]
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for a in range(0, len(order), 256):
                batch = order[a : a + 256]
                flat = np.concatenate([rows[i] for i in batch])
                bounds = np.concatenate([[0], np.cumsum([len(rows[i]) for i in batch])])
                x = w[flat]
                total = sums(x, bounds)
                z = bias + total[:, 0] + 0.5 * ((total[:, 1:] ** 2).sum(1) - sums((x[:, 1:] ** 2).sum(1), bounds))
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) * weight[batch] / len(batch)
                per = np.repeat(err, np.diff(bounds))
                grad = np.empty_like(x)
                grad[:, 0] = per
                grad[:, 1:] = per[:, None] * (np.repeat(total[:, 1:], np.diff(bounds), axis=0) - x[:, 1:])
                o = np.argsort(flat, kind="stable")
                touched, first = np.unique(flat[o], return_index=True)
                if len(touched):
                    g = np.add.reduceat(grad[o], first, axis=0) + l2 * w[touched] / len(batch)
                    g[~linear[touched], 0] = 0
                    seen[touched] += g * g
                    w[touched] -= rate * g / np.sqrt(seen[touched])
                seen_bias += err.sum() ** 2
                bias -= rate * err.sum() / np.sqrt(seen_bias)
        self.w, self.bias = w.astype(np.float32), float(bias)
        return self


def _telling(docs: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each feature whether it has factors, and whether it has a weight: it sets the classes apart (G-test), or is in many documents."""
    every, own = (np.bincount(np.concatenate([d for d, t in zip(docs, y, strict=True) if t >= least] or [np.empty(0, np.int64)]), minlength=BUCKETS).astype(float) for least in (0, 1))
    n, share = max(1, len(y)), (y == 1).mean() if len(y) else 0.0

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-12)), 0)

    test = 2 * (part(own, every * share) + part(every - own, every * (1 - share)) + part(n * share - own, (n - every) * share) + part(n - n * share - every + own, (n - every) * (1 - share)))
    enough = every >= MIN_DOCS
    return enough, enough & ((test >= MIN_G) | (every >= FREQUENT * n))


def _best(score: np.ndarray, y: np.ndarray) -> float:
    """Threshold of best F1, midway to the next lower score."""
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(y[order] == 1)
    ends = np.flatnonzero(np.append(s[:-1] != s[1:], True))
    f1 = 2 * hit[ends] / (ends + 1 + max(1, (y == 1).sum()))
    i = ends[np.argmax(f1)]
    return float((s[i] + (s[i + 1] if i + 1 < len(s) else 0)) / 2)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Machine:
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows) for c in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            feats, bounds = features(part)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(feats))], names=["doc_id", "toxic", "feats"])

    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")
    rows = labelled.mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, toxic int, feats array<int>").toArrow()
    machine = Machine()
    if not rows.num_rows:
        return machine
    rows = rows.combine_chunks()
    feats = rows.column("feats").combine_chunks()
    flat, bounds = feats.values.to_numpy(), feats.offsets.to_numpy()
    y, sizes = rows.column("toxic").to_numpy(), np.diff(bounds)
    ids = rows.column("doc_id").combine_chunks().dictionary_encode()
    place = np.argsort(pc.array_sort_indices(ids.dictionary).to_numpy())  # of each distinct id in their order
    order = np.lexsort((sizes, y, place[ids.indices.to_numpy()]))
    each = [flat[bounds[i] : bounds[i + 1]] for i in order]
    y = y[order].astype(np.int64)
    if len(set(y.tolist())) < 2:
        return machine
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        held[np.flatnonzero(y == c)[::5]] = True
    learn = ~held if all((y[~held] == c).any() for c in (0, 1)) else np.ones(len(y), bool)
    machine.fit([each[i] for i in np.flatnonzero(learn)], y[learn])
    out = [each[i] for i in np.flatnonzero(held)]
    score = machine.score(np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])]))
    machine.threshold = _best(score, y[held])
    return machine.fit(each, y)


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, score, toxic) for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, train_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            score, toxic = _judged(sent.value, part)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array(toxic)], names=["doc_id", "score", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, score double, toxic boolean")


def _judged(machine: Machine, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Score of each text, and whether it is rejected."""
    feats, bounds = features(part)
    score = machine.score(feats, bounds)
    return score, (score >= machine.threshold) & (np.diff(bounds) > 0)


def without_toxic(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs without those rejected; the columns of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, train_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield part.filter(pa.array(~_judged(sent.value, part)[1]))

    return mapped(docs, run, "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
