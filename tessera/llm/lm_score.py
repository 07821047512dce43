"""Language-model scoring: bits that each document costs under prediction by partial matching (see ppm.py).

The statistics are those of the whole corpus, in two halves by the hash of the text, and each half is scored under
the statistics of the other: no document, nor any copy of it, is in what it is scored by.

1. Each partition counts its grams; the counts are summed by a shuffle of (half, gram, count), never of text.
2. All grams whose context ends in the same byte meet in one group, which has everything that orders 3 to 1 need; the
   256 counts of the empty context come as constants. There each gram gets its cost, escapes and exclusion included.
3. Documents are scored by table, which goes to all workers as tries (see ppm.Trie). A table of over ``table_bytes``
   is cut by the two oldest bytes of the grams, and documents are scored once for each part: bits by the digest of the
   text are written, summed and joined with the documents. Texts, or grams of documents, are never shuffled.

Defined results: one row for each row of the input, repeated rows and null doc_ids included; doc_id may be of any type.
A null or empty text has 0 bytes, 0 bits and null bits_per_byte. With no other half to learn from, each byte costs 8
bits. Texts are scored in full, however long. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ppm
from tessera.llm.common import TMP, checkpointed, raw, slices, sums, table, type_of, utf8

#: Bytes of the part of the table that is held at a time, at the driver (as rows) and in each worker (as tries).
TABLE_BYTES = 128 << 20
ROW_BYTES = 12
#: Distinct grams that a counting task holds before it merges them.
MERGE_AT = 4_000_000
DIGEST = TMP + "digest"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts = [], []

    def fold() -> None:
        k, n = ppm.merged(np.concatenate(keys), np.concatenate(counts))
        keys[:], counts[:] = [k], [n]

    for part in slices(batches, "text"):
        data, offsets = raw(utf8(part.column("text")))
        half = part.column("half").to_numpy(zero_copy_only=False).astype(np.uint64) << np.uint64(32)
        k, n = ppm.counted(ppm.grams(data, offsets) | np.repeat(half, np.diff(offsets)))
        keys.append(k)
        counts.append(n)
        if sum(map(len, keys)) > MERGE_AT and len(keys) > 1:
            fold()
    if keys:
        fold()
        for i in range(0, len(keys[0]), 1 << 18):
            k, n = keys[0][i : i + (1 << 18)], counts[0][i : i + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array((k >> np.uint64(32)).astype(np.int32)), pa.array((k & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n.astype(np.int64))], names=["half", "gram", "n"])


def gram_counts(docs: DataFrame) -> DataFrame:
    """(half, gram, n) over all documents."""
    halves = docs.select("text", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"))
    return halves.mapInArrow(_count, "half int, gram long, n long").groupBy("half", "gram").agg(F.sum("n").alias("n"))


def gram_costs(counts: DataFrame) -> DataFrame:
    """(half, gram, bits): for the grams of each half the cost under the statistics of the other. gram as a signed integer."""
    roots = {h: np.zeros(256, np.int64) for h in (0, 1)}
    for h, s, n in counts.groupBy("half", (F.col("gram") % 256).alias("s")).agg(F.sum("n")).collect():
        roots[h][s] = n

    def of(group: pa.Table) -> pa.Table:
        half, gram, n = (group.column(c).to_numpy() for c in ("half", "gram", "n"))
        gram, out = gram.astype(np.uint64), np.zeros(len(gram))
        for h in (0, 1):
            order = np.argsort(gram[half == 1 - h])
            out[half == h] = ppm.costs(gram[half == h], gram[half == 1 - h][order], n[half == 1 - h][order], roots[1 - h])
        return pa.table({"half": group.column("half"), "gram": pa.array(gram.astype(np.uint32).view(np.int32)), "bits": pa.array(out.astype(np.float32))})

    return counts.groupBy(F.shiftrightunsigned("gram", 8) % 256).applyInArrow(of, "half int, gram int, bits float")


def _parts(costs: DataFrame, table_bytes: int) -> list[tuple[int, int]]:
    """Ranges (first, last) of the two oldest bytes, of table_bytes each or of a single value."""
    by_context = costs.groupBy("half", F.shiftrightunsigned("gram", 8).alias("c")).count()
    size = F.sum(F.col("count") * (ROW_BYTES + ppm.Trie.GRAM_BYTES) + ppm.Trie.CONTEXT_BYTES)
    out, held, begin = [], 0, 0
    for pair, more in sorted(tuple(r) for r in by_context.groupBy(F.shiftrightunsigned("c", 8)).agg(size).collect()):  # 65,536 rows at most
        if held and held + more > table_bytes:
            out.append((begin, pair - 1))
            held, begin = 0, pair
        held += more
    return [*out, (begin, 65535)]


def lm_score(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte) for each row of docs."""
    costs = checkpointed(gram_costs(checkpointed(gram_counts(docs))))
    half = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half")
    parts = _parts(costs, table_bytes)
    if len(parts) == 1:
        kind = type_of(docs, "doc_id")
        scored = docs.select("doc_id", "text", half).mapInArrow(_scorer(costs, "doc_id"), f"doc_id {kind}, n_bytes long, bits double")
    else:
        scored = _by_parts(docs.withColumn(DIGEST, F.unhex(F.sha2("text", 256))), half, costs, parts)
    return scored.select("doc_id", "n_bytes", "bits", F.when(F.col("n_bytes") > 0, F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"))


def _scorer(costs: DataFrame, key: str):
    """Arrow function: (key, n_bytes, bits) of texts under a table of costs, or a part of it."""
    rows = costs.toArrow()
    half, gram, bits = (rows.column(c).to_numpy() for c in ("half", "gram", "bits"))
    gram, order = gram.view(np.uint32), np.argsort(gram.view(np.uint32))
    tries = [ppm.Trie(gram[o], bits[o]) for o in (order[half[order] == h] for h in (0, 1))]
    sent = costs.sparkSession.sparkContext.broadcast(tries)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = sent.value
        for part in slices(batches, "text"):
            data, offsets = raw(utf8(part.column("text")))
            keys, size = ppm.grams(data, offsets), np.diff(offsets)
            second = np.repeat(part.column("half").to_numpy(zero_copy_only=False) == 1, size)
            bits = np.empty(len(keys), np.float64)
            bits[~second], bits[second] = tries[0](keys[~second]), tries[1](keys[second])
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(size), pa.array(sums(bits, offsets))], names=[key, "n_bytes", "bits"])

    return score


def _by_parts(docs: DataFrame, half, costs: DataFrame, parts: list[tuple[int, int]]) -> DataFrame:
    every = None
    for first, last in parts:
        score = _scorer(costs.where(F.shiftrightunsigned("gram", 16).between(first, last)), DIGEST)
        found = docs.where(F.col(DIGEST).isNotNull()).select(DIGEST, "text", half).mapInArrow(score, f"{DIGEST} binary, n_bytes long, bits double")
        found = checkpointed(found.groupBy(DIGEST).agg(F.max("bits").alias("bits")))  # copies of a text are scored alike
        every = found if every is None else every.unionByName(found)
    bits = every.groupBy(DIGEST).agg(F.sum("bits").alias("bits"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return docs.select("doc_id", DIGEST, size.alias("n_bytes")).join(bits, DIGEST, "left").select("doc_id", "n_bytes", F.coalesce("bits", F.lit(0.0)).alias("bits"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))
