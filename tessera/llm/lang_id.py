"""Language identification: the language whose byte contexts code a text in the fewest bits (see ppm.py).

Each language has a tree of contexts of up to three bytes, trained on at most ``train_docs`` documents that carry its
label, chosen by the hash of doc_id. (That bound is the only sampling; every document is then scored, in full.) The
trees are frozen and merged into one table of exact code lengths by (context, byte, language), so that a text is
scored by four gathers a byte. The table's size depends on the sample alone, never on the input.

Defined results: one row for each row of the input. A null or empty text has a null language and margin and 0 bits per
byte. Ties go to the language first in order of name. With no labelled text every language is null. margin is the gap
in bits per byte to the second language, null if there is only one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import ppm
from tessera.llm.common import raw, slices, sums, table, type_of, utf8

#: Labelled documents of each language that training reads at most.
TRAIN_DOCS = 600


class Trees:
    """Context trees of several languages, frozen. keys, counts: of each language, the grams of its texts."""

    def __init__(self, langs: list[str], keys: list[np.ndarray], counts: list[np.ndarray]):
        self.langs = langs
        every = np.unique(np.concatenate([np.zeros(1, np.uint32), *keys]))
        seen = np.unique(np.concatenate([(every >> np.uint32(8 * k)) & np.uint32(255) for k in range(4)]))
        self.cls = np.full(256, len(seen), np.int64)  # the last class: bytes that no language has
        self.cls[seen] = np.arange(len(seen))
        width = len(seen) + 1
        symbols = np.append(seen.astype(np.uint64), np.uint64(next((b for b in range(256) if b not in set(seen.tolist())), 255)))
        # contexts of each order that any language has; a row of the table each, shorter ones first
        levels = [np.unique((every.astype(np.uint64) >> np.uint64(8)) & np.uint64((1 << 8 * k) - 1)) for k in range(4)]
        base = np.cumsum([0, *map(len, levels)])
        rows = int(base[-1])
        # states: a row with shorter contexts; its copy, which stays, as the longer context is unknown; a longest context
        inner = int(base[3])
        self.next = np.repeat(np.arange(2 * inner, dtype=np.int32)[:, None], width, 1)
        self.next[:inner] += inner
        for k in range(1, 4):
            oldest = (levels[k] >> np.uint64(8 * (k - 1))).astype(np.int64)
            shorter = base[k - 1] + np.searchsorted(levels[k - 1], levels[k] & np.uint64((1 << 8 * (k - 1)) - 1))
            self.next[shorter, self.cls[oldest]] = base[k] + np.arange(len(levels[k])) + (inner if k == 3 else 0)
        self.row = np.concatenate([np.arange(inner), np.arange(inner), np.arange(inner, rows)]).astype(np.int32)
        self.bits = np.zeros((rows, width, len(langs)), np.float32)
        for j, (k_, n_) in enumerate(zip(keys, counts, strict=True)):
            root = np.bincount((k_ & np.uint32(255)).astype(np.int64), n_, 256).astype(np.int64)
            for k in range(4):
                wanted = (levels[k][:, None] << np.uint64(8)) + symbols[None]
                self.bits[base[k] : base[k + 1], :, j] = ppm.costs(wanted.ravel(), k_.astype(np.uint64), n_, root, k).reshape(wanted.shape)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        context = self.cls[data]
        symbol, state = context, np.zeros(len(data), np.int32)
        starts, nul = offsets[:-1][offsets[:-1] < len(data)], self.cls[0]
        for _ in range(3):
            context = np.concatenate([[nul], context[:-1]]) if len(context) else context
            context[starts] = nul
            state = self.next[state, context]
        return sums(self.bits[self.row[state], symbol].astype(np.float64), offsets)


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Trees:
    ids = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = ids.withColumn("k", F.row_number().over(first)).where(F.col("k") <= train_docs).select("doc_id", "lang")
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("lang", "text")
    codes = {x: i for i, x in enumerate(sorted(r[0] for r in chosen.select("lang").distinct().collect()))}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers = [], []
        for part in slices(batches, "text"):
            data, offsets = raw(utf8(part.column("text")))
            lang = np.array([codes[x] for x in part.column("lang").to_pylist()], np.uint64) << np.uint64(32)
            k, n = ppm.counted(ppm.grams(data, offsets) | np.repeat(lang, np.diff(offsets)))
            keys.append(k)
            numbers.append(n)
        if keys:
            k, n = ppm.merged(np.concatenate(keys), np.concatenate(numbers))
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    found = texts.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = found.column("key").to_numpy().astype(np.uint64), found.column("n").to_numpy()
    order = np.argsort(key)
    key, n = key[order], n[order]
    of = (key >> np.uint64(32)).astype(np.int64)
    return Trees(list(codes), [(key[of == i] & np.uint64(0xFFFFFFFF)).astype(np.uint32) for i in codes.values()], [n[of == i] for i in codes.values()])


def lang_id(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, lang, bits_per_byte, margin) for each row of docs; lang is the language found."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, train_docs))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: Trees = sent.value
        names = np.array([*trees.langs, None], object)
        for part in slices(batches, "text"):
            data, offsets = raw(utf8(part.column("text")))
            size = np.diff(offsets)
            if not trees.langs:
                best, least, gap = np.full(len(size), -1), np.full(len(size), 0.0), np.full(len(size), np.nan)
            else:
                bits = trees(data, offsets) / np.maximum(size, 1)[:, None]
                best, ranked = np.where(size > 0, bits.argmin(1), -1), np.sort(bits, 1)
                least = ranked[:, 0]
                gap = ranked[:, 1] - ranked[:, 0] if len(trees.langs) > 1 else np.full(len(size), np.nan)
                gap = np.where(size > 0, gap, np.nan)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(least), pa.array(gap, from_pandas=True)], names=["doc_id", "lang", "bits_per_byte", "margin"])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {type_of(docs, 'doc_id')}, lang string, bits_per_byte double, margin double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id(table(spark, sf_dir, "documents"))
