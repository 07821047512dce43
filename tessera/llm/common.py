"""Shared pieces: checkpoint folder, column names, Arrow slices of bounded size, words as integer codes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tessera.session import shared_folder

#: Bytes of text handled at once by the vectorised kernels; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20
#: Prefix of helper columns, so that no column of the input can clash with them.
TMP = "__tsr_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder, so that a lost executor costs nothing."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def safe(docs: DataFrame, *known: str) -> DataFrame:
    """docs with all columns but the known ones named by their place, so that no name (dots, clashes) can do harm."""
    return docs.toDF(*[c if c in known else f"{TMP}{i}" for i, c in enumerate(docs.columns)])


def mapped(docs: DataFrame, run: Callable, *known: str) -> DataFrame:
    """docs.mapInArrow of a function that keeps the columns, of which it knows the known ones by name."""
    plain = safe(docs, *known)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def type_of(docs: DataFrame, column: str) -> str:
    return docs.schema[column].dataType.simpleString()


def utf8(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """A text column as large_string, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and the n + 1 offsets between them, from 0."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in order, in runs of about limit bytes of text."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(lengths), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


#: Of a lower-cased text, bytes that belong to words: ASCII letters and digits, and all of other characters.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


class Words:
    """The words of a slice of texts: runs of [a-z0-9] and non-ASCII characters, after lower-casing.

    code: each word as an index into ``distinct`` (a binary array); start, end: where it lies in ``data``, the
    lower-cased bytes; bounds: the n + 1 offsets of the documents in these arrays.
    """

    def __init__(self, texts: pa.LargeStringArray):
        self.texts = pc.utf8_lower(texts)
        self.data, self.offsets = raw(self.texts)
        size = len(self.data)
        word = np.zeros(size + 1, bool)
        word[1:] = WORD[self.data]
        first = word[1:] & ~word[:-1]
        cut = self.offsets[1:-1]
        cut = cut[(cut > 0) & (cut < size)]  # a word ends where its document does
        first[cut] = word[1:][cut]
        last = np.empty(size, bool)
        last[:-1] = word[1:-1] & (~word[2:] | first[1:])
        if size:
            last[-1] = word[-1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, self.offsets)
        # words and the gaps between them, as one binary array over the same buffer
        edges = np.empty(2 * len(self.start) + 1, np.int64)
        edges[0:-1:2], edges[1::2] = self.start, self.end
        edges[-1] = self.end[-1] if len(self.end) else 0
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(self.start), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(self.data))])
        found = pieces.take(pa.array(np.arange(0, 2 * len(self.start), 2))).dictionary_encode()
        self.code, self.distinct = found.indices.to_numpy(zero_copy_only=False), found.dictionary

    def __len__(self) -> int:
        return len(self.start)

    def hashed(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each distinct word."""
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.distinct.to_pylist()), np.uint64, len(self.distinct))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word."""
        of = self.hashed(seed)
        return of[self.code] if len(of) else np.empty(0, np.uint64)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n hashes: result[i] is of h[i : i + n]."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out, size = np.zeros(len(h) - n + 1, np.uint64), len(h) - n + 1
    for k in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : k + size]
    return mix(out)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i] : bounds[i + 1]] for each i, 0 for an empty run."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), values.dtype if values.dtype != bool else np.int64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0, dtype=out.dtype)
    return out
