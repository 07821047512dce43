"""Exact deduplication with a heavy-hitter split.

1. Every text is reduced to its SHA-256 digest; (doc_id, digest) goes to the shared checkpoint folder, on which all
   counting works. Texts are hashed once more when they are compared with the winners.
2. A Misra-Gries summary of ``counters`` entries per partition, merged over all, holds every digest that makes up more
   than 1/(counters + 1) of the rows. The candidates are then counted exactly; those with at least ``heavy_least``
   rows are the verified winners. There are never more than ``counters`` of them, whatever the input, so they are
   broadcast: their copies go before any shuffle, and no digest can make a hot shuffle partition.
3. The remaining digests are grouped by an ordinary shuffle.

Defined results: of rows with equal text the one of the smallest doc_id stays (a null doc_id counts as the largest).
Rows repeated with the same doc_id and text leave one row, the smallest by its other columns. A null text is no copy
of anything: such rows all stay. The empty text is a text like any other, and texts are hashed in full, however long.
Further columns, whatever their names, are kept as they are; doc_id may be of any type that has an order. An empty
input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import TMP, checkpointed, safe, table

COUNTERS = 1024
HEAVY_LEAST = 32
D, I, KEEP, N, SAME = (TMP + x for x in ("digest", "id", "keep", "n", "same"))


def misra_gries(counters: int):
    """Arrow function: a summary of at most ``counters`` digests for the partition's column of digests."""

    def fold(held: dict[bytes, int]) -> dict[bytes, int]:
        if len(held) <= counters:
            return held
        less = sorted(held.values(), reverse=True)[counters]
        return {k: v - less for k, v in held.items() if v > less}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for x in pc.value_counts(batch.column(0)).to_pylist():
                held[x["values"]] = held.get(x["values"], 0) + x["counts"]
            held = fold(held)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=[D, N])

    return run


def digest(text):
    return F.unhex(F.sha2(text, 256))


def heavy_digests(digests: DataFrame, counters: int = COUNTERS, heavy_least: int = HEAVY_LEAST) -> DataFrame:
    """Verified winners (digest, keep, n, same) of a table (id, digest)."""
    summary = digests.select(D).mapInArrow(misra_gries(counters), f"{D} binary, {N} long")
    candidates = summary.groupBy(D).agg(F.sum(N).alias(N)).orderBy(F.desc(N), D).limit(counters).select(D)
    return winners(digests.join(F.broadcast(candidates), D, "left_semi")).where(F.col(N) >= heavy_least)


def winners(digests: DataFrame) -> DataFrame:
    """For each digest the doc_id that stays, the rows with that doc_id, and all rows."""
    by_id = digests.groupBy(D, I).agg(F.count("*").alias(SAME))
    first = F.min(F.struct(F.col(I).isNull().alias("last"), F.col(I).alias("id"), F.col(SAME).alias("same")))
    return by_id.groupBy(D).agg(first.alias(KEEP), F.sum(SAME).alias(N)).select(D, F.col(f"{KEEP}.id").alias(KEEP), F.col(f"{KEEP}.same").alias(SAME), N)


def exact_dedup(docs: DataFrame, counters: int = COUNTERS, heavy_least: int = HEAVY_LEAST) -> DataFrame:
    """docs without exact copies of text; the columns of docs."""
    original, docs = docs.columns, safe(docs, "doc_id", "text")
    names = docs.columns
    keyed = docs.withColumn(D, digest(F.col("text")))
    digests = checkpointed(keyed.where(F.col(D).isNotNull()).select(F.col("doc_id").alias(I), D))
    heavy = F.broadcast(checkpointed(heavy_digests(digests, counters, heavy_least)))
    light = winners(digests.join(heavy, D, "left_anti")).where(F.col(N) > 1)

    of_heavy = keyed.join(heavy, D, "left").where(F.col(N).isNull() | F.col("doc_id").eqNullSafe(F.col(KEEP)))
    of_heavy = of_heavy.select(*names, D, F.col(SAME).alias(TMP + "s1"))
    rest = of_heavy.join(light.hint("shuffle_hash"), D, "left").where(F.col(N).isNull() | F.col("doc_id").eqNullSafe(F.col(KEEP)))
    rest = rest.select(*names, D, F.greatest(F.coalesce(TMP + "s1", F.lit(1)), F.coalesce(SAME, F.lit(1))).alias(SAME))
    once = rest.where(F.col(SAME) == 1).select(*names)
    again = rest.where(F.col(SAME) > 1).withColumn(TMP + "json", F.to_json(F.struct(*[c for c in names if c not in ("doc_id", "text")]))) if len(names) > 2 else rest.where(F.col(SAME) > 1).withColumn(TMP + "json", F.lit(""))
    again = again.groupBy(D).agg(F.min_by(F.struct(*names), TMP + "json").alias(TMP + "row")).select(TMP + "row.*")
    return once.unionByName(again).toDF(*original)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, text, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents)
WHERE k = 1 OR text IS NULL
"""
