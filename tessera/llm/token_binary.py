"""Token ids as binary shards with Elias-Fano encoded document boundaries.

A shard is one row: the ids of its documents in a row (little endian, two bytes each if all are below 65,536, else
four), and the offsets where documents start and end. These are a rising sequence of n + 1 numbers up to u, kept in
n * (2 + log2(u / n)) bits or so: the low bits of each packed, the high ones in unary, and the position of every
``SAMPLE``-th one-bit for select. ``EliasFano.select(i)`` gives the i-th offset without decoding the others.

Documents are gathered as they come, each partition cutting a shard at ``shard_tokens``; a longer document is a shard of
its own. doc_ids lists the documents in the order of their ids, so that a shard can be read by itself.

Defined results: each row of the input is a document of exactly one shard, repeated rows and null doc_ids included. A
null or empty text is a document of no tokens. An empty input has no shards. doc_id may be of any type; columns other
than it and the text go. Texts are encoded in full, however long. shard_id numbers rows by partition and
place, so it holds for one layout of the input; first_doc and n_tokens tell shards apart in any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import slices, table, type_of, utf8
from tessera.llm.tokens import VOCABULARY, tokenizer

SHARD_TOKENS = 1 << 20
SAMPLE = 64
SCHEMA = "shard_id long, first_doc {0}, n_docs long, n_tokens long, id_bytes int, ids binary, doc_ids array<{0}>, universe long, low_bits int, low binary, high binary, samples array<int>"


class EliasFano:
    """A non-decreasing sequence of integers from 0 to universe."""

    def __init__(self, n: int, universe: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high, self.samples = n, universe, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values, n = np.asarray(values, np.uint64), len(values)
        universe = int(values[-1]) if n else 0
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        rest = values & np.uint64((1 << low_bits) - 1)
        bits = ((rest[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, universe, low_bits, np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype(np.int32))

    def select(self, i: int) -> int:
        """The i-th value: from the sample before it, the one-bit is counted up in the high part."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        word = self.high[byte] & (0xFF << (at & 7)) & 0xFF
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        top = (byte * 8 + (word & -word).bit_length() - 1 - i) << self.low_bits
        first = i * self.low_bits
        got = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3], "little") >> (first & 7)
        return top | (got & ((1 << self.low_bits) - 1))

    def decode(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
        return ((high - np.arange(self.n)) << self.low_bits) + (bits << np.arange(self.low_bits)).sum(1)


def boundaries(row: dict) -> EliasFano:
    """The boundaries of a shard, a row of the result."""
    return EliasFano(row["n_docs"] + 1, row["universe"], row["low_bits"], row["low"], row["high"], np.array(row["samples"]))


def document(row: dict, i: int) -> np.ndarray:
    """Ids of the i-th document of a shard."""
    at, kind = boundaries(row), np.dtype("<u2" if row["id_bytes"] == 2 else "<u4")
    a, b = at.select(i), at.select(i + 1)
    return np.frombuffer(row["ids"], kind, b - a, a * kind.itemsize)


def token_binary(docs: DataFrame, vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    def shard(number: int, ids: list[np.ndarray], sizes: list[np.ndarray], docs_: list[pa.Array]) -> pa.RecordBatch:
        flat, size, doc = np.concatenate(ids), np.concatenate(sizes), pa.concat_arrays(docs_)
        ef = EliasFano.encode(np.concatenate([[0], np.cumsum(size)]))
        wide = len(flat) and int(flat.max()) >= 1 << 16
        row = {"shard_id": number, "first_doc": doc[0].as_py(), "n_docs": len(size), "n_tokens": len(flat), "id_bytes": 4 if wide else 2}
        row |= {"ids": flat.astype("<u4" if wide else "<u2").tobytes(), "doc_ids": doc, "universe": ef.universe, "low_bits": ef.low_bits, "low": ef.low, "high": ef.high, "samples": ef.samples}
        kinds = {"first_doc": doc.type, "id_bytes": pa.int32(), "ids": pa.binary(), "low_bits": pa.int32(), "low": pa.binary(), "high": pa.binary()}
        lists = {"doc_ids": doc.type, "samples": pa.int32()}
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, lists[k])) if k in lists else pa.array([v], kinds.get(k, pa.int64())) for k, v in row.items()], names=list(row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = tokenizer(vocabulary), TaskContext.get().partitionId() << 32
        ids, sizes, docs_, held = [], [], [], 0
        for part in slices(batches, "text"):
            flat, bounds = encode(utf8(part.column("text")))
            at = 0
            while at < part.num_rows:
                to = int(np.searchsorted(bounds, bounds[at] + shard_tokens - held, "right")) - 1
                to = min(part.num_rows, to if to > at or held else at + 1)
                if to > at:
                    ids.append(flat[bounds[at] : bounds[to]])
                    sizes.append(np.diff(bounds[at : to + 1]))
                    docs_.append(part.column("doc_id").slice(at, to - at))
                    held += int(bounds[to] - bounds[at])
                at = to
                if at < part.num_rows and sizes:
                    yield shard(number, ids, sizes, docs_)
                    ids, sizes, docs_, held, number = [], [], [], 0, number + 1
        if sizes:
            yield shard(number, ids, sizes, docs_)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA.format(type_of(docs, "doc_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary(table(spark, sf_dir, "documents"))
