"""Benchmark decontamination: documents that hold a run of words of a benchmark item.

A word is a run of [a-z0-9] and non-ASCII characters of the lower-cased text. The grams are all runs of ``n`` words of
the items; an item shorter than that, but of at least ``least`` words, is one gram. Every window of every document is
looked up in a sorted array of the grams' hashes, and hits are verified word by word. Both arrays go to all workers,
at 16 bytes or so a gram and the benchmark's distinct words; a benchmark of more than ``part_bytes`` of text is taken
in parts. Then each part's verified hits are written, by the digest of the text, one part being held at a time, and
documents are joined with what hits they have. One part or many, the result is the same: a document is decided upon and
cut once, by the hits of all parts in its original text.

mode "documents" drops documents with a verified hit. mode "spans" cuts the covered words out, with what lies between
them, and drops documents of which more than ``most`` of the words are covered. (Words on either side of a cut may be
neighbours then; they are not looked at again.)

Defined results: columns and rows are those of the input. A null or empty text has no hits and stays. Repeated rows are
treated alike, and texts are searched in full, however long. Null or too short items match nothing, and repeated items
as one. An empty benchmark leaves all documents as they are.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import TMP, Words, checkpointed, mapped, rolling, safe, slices, table, utf8

N = 8
LEAST = 5
MOST = 0.5
PART_BYTES = 24 << 20
#: Texts with hits that are broadcast at most, if the benchmark comes in parts.
BROADCAST_ROWS = 200_000
DIGEST, HITS = TMP + "digest", TMP + "hits"


class Grams:
    """Grams of benchmark items: by number of words sorted hashes, where each stands, and the items' words to verify by.

    The hash is seeded so that no two words, and no two grams, have the same one.
    """

    def __init__(self, items: list[str], n: int, least: int):
        words = Words(pa.array(items, pa.large_string()))
        for self.seed in itertools.count():
            hashed = words.hashed(self.seed)
            order = np.argsort(hashed)
            self.known = hashed[order]
            if (self.known[1:] != self.known[:-1]).all() and self._tables(words, hashed, n, least):
                break
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.words = words.distinct.take(pa.array(order))
        self.ids = place[words.code] if len(place) else np.empty(0, np.int32)

    def _tables(self, words: Words, hashed: np.ndarray, n: int, least: int) -> bool:
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        count = words.counts()
        hashes = hashed[words.code] if len(hashed) else np.empty(0, np.uint64)
        for size in np.unique(np.minimum(count[count >= least], n)).tolist():
            fits = (count >= n) if size == n else (count == size)
            at = rolling(hashes, size)
            item = np.repeat(np.arange(len(count)), count)[: len(at)]
            start = np.flatnonzero(fits[item] & (np.arange(len(at)) + size <= words.bounds[1:][item])).astype(np.int32)
            at = at[start]
            order = np.argsort(at, kind="stable")
            at, start = at[order], start[order]
            first = np.append(True, at[1:] != at[:-1]) if len(at) else np.empty(0, bool)
            of = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            if any((words.code[start + k] != words.code[start[of] + k]).any() for k in range(size)):
                return False
            at, start = at[first], start[first]
            bits = np.zeros(1 << max(13, len(at).bit_length() + 1), np.uint8)  # eight bits a byte
            slot = at & np.uint64(8 * len(bits) - 1)
            np.bitwise_or.at(bits, slot >> np.uint64(3), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
            self.tables[size] = at, start, bits
        return True

    def found(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and number of words of each verified gram in a slice of texts."""
        starts, sizes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if self.tables and len(words):
            hashed = words.hashed(self.seed)
            at = np.minimum(np.searchsorted(self.known, hashed), len(self.known) - 1)
            at[self.known[at] != hashed] = -1
            some = np.flatnonzero(at >= 0)
            differ = np.array(self.words.take(pa.array(at[some])).to_pylist(), object) != np.array(words.distinct.take(pa.array(some)).to_pylist(), object)
            at[some[differ.astype(bool)]] = -1
            hashes, ids = hashed[words.code], at[words.code].astype(np.int32)
            doc = np.repeat(np.arange(len(words.bounds) - 1), words.counts())
            for size, (keys, where, bits) in self.tables.items():
                window = rolling(hashes, size)
                slot = window & np.uint64(8 * len(bits) - 1)
                maybe = np.flatnonzero((bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
                maybe = maybe[doc[maybe] == doc[maybe + size - 1]]
                gram = np.minimum(np.searchsorted(keys, window[maybe]), len(keys) - 1)
                same = keys[gram] == window[maybe]
                maybe, gram = maybe[same], where[gram[same]]
                for k in range(size):
                    ok = ids[maybe + k] == self.ids[gram + k]
                    maybe, gram = maybe[ok], gram[ok]
                starts.append(maybe)
                sizes.append(np.full(len(maybe), size))
        return np.concatenate(starts), np.concatenate(sizes)


def covered(n: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each of n words whether a gram covers it."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + sizes, -1)
    return np.cumsum(steps)[:n] > 0


def _parts(benchmark: DataFrame, part_bytes: int) -> Iterator[list[str]]:
    part, size = [], 0
    for row in benchmark.where(F.col("text").isNotNull()).select("text").distinct().toLocalIterator():
        more = len(row[0].encode())
        if part and size + more > part_bytes:
            yield part
            part, size = [], 0
        part.append(row[0])
        size += more
    if part:
        yield part


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, least: int = LEAST, mode: str = "documents", most: float = MOST, part_bytes: int = PART_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs without the benchmark's passages; the columns of docs."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode {mode!r}")
    parts = _parts(benchmark, part_bytes)
    first, second = next(parts, None), next(parts, None)
    if first is None:
        return docs
    if second is None:
        return _one_part(docs, Grams(first, n, least), mode, most)
    hits = [_hits(docs, Grams(part, n, least), mode) for part in itertools.chain((first, second), parts)]
    return _joined(docs, hits, mode, most, broadcast_rows)


def _one_part(docs: DataFrame, grams: Grams, mode: str, most: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(utf8(part.column("text")))
            yield _decided(part, words, *sent.value.found(words), mode, most)

    return mapped(docs, run, "text")


def _decided(part: pa.RecordBatch, words: Words, starts: np.ndarray, sizes: np.ndarray, mode: str, most: float) -> pa.RecordBatch:
    """The rows of part that stay, cut."""
    hit = covered(len(words), starts, sizes)
    share = np.diff(np.concatenate([[0], np.cumsum(hit)])[words.bounds])
    if mode == "documents":
        return part.filter(pa.array(share == 0))
    keep = share <= most * np.maximum(words.counts(), 1)
    if share.any():
        cut = part.column("text").to_pylist()
        for i in np.flatnonzero((share > 0) & keep).tolist():
            cut[i] = _without(cut[i], hit[words.bounds[i] : words.bounds[i + 1]])
        k = part.schema.get_field_index("text")
        part = part.set_column(k, part.schema.field(k), pa.array(cut, part.schema.field(k).type))
    return part.filter(pa.array(keep))


def _hits(docs: DataFrame, grams: Grams, mode: str) -> DataFrame:
    """(digest, start, size) of the verified grams of one part in each distinct text, written."""
    sent = docs.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(utf8(part.column("text")))
            starts, sizes = sent.value.found(words)
            doc = np.searchsorted(words.bounds, starts, "right") - 1
            if mode == "documents":
                doc, first = np.unique(doc, return_index=True)
                starts, sizes = starts[first], sizes[first]
            yield pa.RecordBatch.from_arrays([part.column(DIGEST).take(pa.array(doc)), pa.array(starts - words.bounds[doc]), pa.array(sizes)], names=[DIGEST, "start", "size"])

    texts = docs.where(F.col("text").isNotNull()).select("text", F.unhex(F.sha2("text", 256)).alias(DIGEST))
    out = checkpointed(texts.mapInArrow(run, f"{DIGEST} binary, start long, size long").distinct())
    sent.destroy()
    return out


def _joined(docs: DataFrame, hits: list[DataFrame], mode: str, most: float, broadcast_rows: int) -> DataFrame:
    """docs decided upon by the hits of all parts. Hits of one text meet in one row: as many as it has words, at most."""
    every = hits[0]
    for more in hits[1:]:
        every = every.unionByName(more)
    plain = safe(docs, "text").withColumn(DIGEST, F.unhex(F.sha2("text", 256)))
    if mode == "documents":
        gone = checkpointed(every.select(DIGEST).distinct())
        gone = F.broadcast(gone) if gone.count() <= broadcast_rows else gone.hint("shuffle_hash")
        return plain.join(gone, DIGEST, "left_anti").drop(DIGEST).toDF(*docs.columns)
    by_text = every.distinct().groupBy(DIGEST).agg(F.collect_list(F.struct("start", "size")).alias(HITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(utf8(part.column("text")))
            lists = part.column(HITS)
            doc = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()) * lists.is_valid().to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            starts, sizes = flat.field("start").to_numpy() + words.bounds[doc], flat.field("size").to_numpy()
            yield _decided(part, words, starts, sizes, mode, most).drop_columns([HITS])

    joined = plain.join(by_text.hint("shuffle_hash"), DIGEST, "left").drop(DIGEST)
    return joined.mapInArrow(run, safe(docs, "text").schema).toDF(*docs.columns)


def _without(text: str, hit: np.ndarray) -> str:
    """text without the words hit and what lies between two of them."""
    spans, start, k = [], None, 0
    inside = lambda c: not c.isascii() or c.isalnum()
    for i, c in enumerate(text + " "):
        if inside(c) and i < len(text):
            start = i if start is None else start
        elif start is not None:
            spans.append((start, i, bool(hit[k])))
            start, k = None, k + 1
    out, at, last = [], 0, False
    for a, b, h in spans:
        if not h:
            if last:
                out.append(" " if out else "")
            elif at < a:
                out.append(text[at:a])
            out.append(text[a:b])
            at = b
        else:
            if not last and at < a:
                out.append(text[at:a].rstrip())
            at = b
        last = h
    if not last:
        out.append(text[at:])
    return "".join(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\x{80}-\x{10FFFF}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\x{80}-\x{10FFFF}]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT DISTINCT array_to_string(w[i:i+7], ' ') AS gram, 8 AS size FROM (SELECT w, unnest(range(1, len(w) - 6)) AS i FROM b WHERE len(w) >= 8)
  UNION SELECT DISTINCT array_to_string(w, ' '), len(w) FROM b WHERE len(w) BETWEEN 5 AND 7),
sizes AS (SELECT DISTINCT size FROM g),
win AS (SELECT doc_id, size, array_to_string(w[i:i+size-1], ' ') AS gram FROM
  (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT DISTINCT doc_id FROM win JOIN g USING (gram, size))
SELECT doc_id, text, lang, source, n_chars FROM d WHERE doc_id NOT IN (SELECT doc_id FROM hit)
"""
