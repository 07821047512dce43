"""Mixing sources to target weights, by fitting each source's token budget with a bounded knapsack.

1. Documents are tokenized and counted by (source, exact token length).
2. Source s may spend the smaller of rate * weight_s and what it has; the rate is the one by which all spend the budget
   together, so what a small source can't use goes to the others in proportion to their weights. Of each length the
   same share is taken, rounded down. What remains is filled from the documents left: down to ``window`` tokens by one
   document of each length after the other, longest first, and the last stretch by dynamic programming over the
   remaining lengths and their counts, which finds the largest sum that fits; mostly it meets the budget to the token.
   This runs on the counts alone, one task for each source, which holds a row for each length. (If nothing but longer
   documents is left, the last stretch may be as long as the longest of them.)
3. Of each (source, length) the planned number of documents is chosen in the order of a seeded hash of doc_id. A group
   of over ``SPAN`` units is cut into spans of the hash, which are counted; spans that are taken or left as a whole need
   no order, so only the one in which the plan ends is sorted.

Only (source, doc_id, length) is shuffled for the choice; texts are moved once, to be joined with it. Sums by source
stay distributed; the driver sees totals only.

Defined results: columns are those of the input, whatever their names; doc_id may be of any type that has an order.
Rows that share source and doc_id, nulls included, are one unit, taken or left together, with the sum of their tokens.
A null source is a source. Units without tokens are left out. An empty input gives an empty result. A source with
weight 0 or without a weight is left out. If all sources with a weight have less than the budget, all they have is
taken. Ties of the hash go to the smaller doc_id. Texts are counted in full, however long.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import TMP, checkpointed, safe, slices, table, type_of, utf8
from tessera.llm.tokens import VOCABULARY, tokenizer

SHARE = 0.7
TEMPERATURE = 0.5
WINDOW = 1 << 16
SEED = 17
#: Units of a source and length whose order one task finds.
SPAN = 1 << 16
K, I, L, W, T = (TMP + x for x in ("key", "id", "len", "weight", "tokens"))


def fit(lengths: np.ndarray, counts: np.ndarray, target: int, window: int = WINDOW) -> np.ndarray:
    """How many documents of each length to take, so that the sum is at most target and as near as can be."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((lengths * counts).sum())
    if target >= total:
        return counts.copy()
    take = counts * target // total if total * int(counts.max()) < 1 << 62 else np.floor(counts * (target / total)).astype(np.int64)
    left = target - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if lengths[i] > 0 and left - lengths[i] >= window and take[i] < counts[i]:
            take[i] += 1
            left -= int(lengths[i])
    for i in np.argsort(-lengths, kind="stable"):  # only if single documents did not do
        if lengths[i] > 0 and left > window and take[i] < counts[i]:
            more = min(int(counts[i] - take[i]), (left - window) // int(lengths[i]))
            take[i] += more
            left -= more * int(lengths[i])
    # bounded knapsack: counts split into powers of two; first[s] is the piece by which sum s was first reached
    first = np.full(left + 1, -1, np.int32)
    reached = np.zeros(left + 1, bool)
    reached[0] = True
    pieces: list[tuple[int, int]] = []
    for i in np.argsort(lengths, kind="stable"):
        size, free = int(lengths[i]), int(counts[i] - take[i])
        if not 0 < size <= left:
            continue
        free, lot = min(free, left // size), 1
        while free > 0 and not reached[left]:
            lot = min(lot, free)
            step = size * lot
            new = reached[: left + 1 - step] & ~reached[step:]
            first[step:][new] = len(pieces)
            reached[step:] |= new
            pieces.append((int(i), lot))
            free, lot = free - lot, lot * 2
        if reached[left]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, lot = pieces[first[at]]
        take[i] += lot
        at -= int(lengths[i]) * lot
    return take


def tempered(tokens: Mapping[str, int], temperature: float = TEMPERATURE) -> dict[str, float]:
    """Weights in proportion to a power of each source's tokens."""
    power = {k: float(n) ** temperature for k, n in tokens.items() if n > 0}
    return {k: x / sum(power.values()) for k, x in power.items()}


def _key(source):
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source.cast("string")))


def _weighed(have: DataFrame, weights: Mapping[str | None, float] | None) -> DataFrame:
    """have (key, tokens) with the weight of each source, of those with any."""
    if weights is None:
        return have.withColumn(W, F.pow(F.col(T).cast("double"), F.lit(TEMPERATURE)))
    given = have.sparkSession.createDataFrame([("n" if k is None else f"s{k}", float(w)) for k, w in weights.items()], f"{K} string, {W} double")
    return have.join(F.broadcast(given), K).where(F.col(W) > 0)


def rate(have: DataFrame, spend: int) -> float:
    """The rate at which sources (tokens, weight) that spend the smaller of rate * weight and their tokens spend it all.

    Each round takes the sources that the rate exhausts out of the sum; the rate only rises, and ends when none is new.
    """
    at = 0.0
    while True:
        full = F.col(T) <= F.lit(at) * F.col(W)
        spent, open_ = have.agg(F.sum(F.when(full, F.col(T)).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col(W)))).first()
        if not open_:
            return float("inf") if spent is None or spent <= spend else at
        new = max(0.0, (spend - spent) / open_)
        if new <= at * (1 + 1e-12):
            return at
        at = new


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, budget: int | None = None, share: float = SHARE, seed: int = SEED, vocabulary: str = VOCABULARY, window: int = WINDOW, span: int = SPAN) -> DataFrame:
    """The chosen documents; the columns of docs.

    weights: of each source; by default in proportion to a power of its tokens. budget: tokens of the whole; by default
    share of all there are.
    """

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary)
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(K), part.column("doc_id"), pa.array(np.diff(encode(utf8(part.column("text")))[1]))], names=[K, I, L])

    names, docs = docs.columns, safe(docs, "doc_id", "text", "source")
    counted = docs.select(_key(F.col("source")).alias(K), "doc_id", "text").mapInArrow(lengths, f"{K} string, {I} {type_of(docs, 'doc_id')}, {L} long")
    units = checkpointed(counted.groupBy(K, I).agg(F.sum(L).alias(L)).where(F.col(L) > 0))
    groups = checkpointed(units.groupBy(K, L).agg(F.count("*").alias("n")))
    tokens = groups.groupBy(K).agg(F.sum(F.col(L) * F.col("n")).alias(T))
    spend = budget if budget is not None else int(share * (tokens.agg(F.sum(T)).first()[0] or 0))
    have = checkpointed(_weighed(tokens, weights))
    target = F.least(F.col(T).cast("double"), F.floor(F.lit(rate(have, spend)) * F.col(W) + F.lit(1e-6))).cast("long")

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(L)
        took = fit(rows[L].to_numpy(), rows["n"].to_numpy(), int(rows["target"].iloc[0]), window)
        return pd.DataFrame({K: rows[K], L: rows[L], "n": rows["n"], "take": took})

    planned = groups.join(have.select(K, target.alias("target")), K).groupBy(K).applyInPandas(plan, f"{K} string, {L} long, n long, take long").where("take > 0")
    chosen = _chosen(units, checkpointed(planned), seed, span)
    joined = docs.withColumn(K, _key(F.col("source"))).join(chosen.withColumnRenamed(K, K + "2").hint("shuffle_hash"), (F.col(K) == F.col(K + "2")) & F.col("doc_id").eqNullSafe(F.col(I)), "left_semi")
    return joined.drop(K).toDF(*names)


def _chosen(units: DataFrame, planned: DataFrame, seed: int, span: int) -> DataFrame:
    """(key, id): of each key and length the planned number of units, by the least hash."""
    rank = F.xxhash64(F.lit(seed), I)
    spans = F.ceil(F.col("n") / F.lit(span))
    # the hash as a share of all hashes, from 0 to 1, in the order of the hash
    place = F.floor((rank.cast("double") / F.lit(2.0**64) + 0.5) * spans)
    due = units.join(planned, [K, L]).select(K, L, I, "take", rank.alias("rank"), F.when(spans == 1, 0).otherwise(F.least(F.greatest(place, F.lit(0)), spans - 1)).alias("span"), spans.alias("spans"), (F.col("take") < F.col("n")).alias("some"))
    whole = due.where(~F.col("some")).select(K, I)
    due = due.where("some")
    few = due.where("spans = 1").withColumn("before", F.lit(0).cast("long"))
    sizes = due.where("spans > 1").groupBy(K, L, "span").agg(F.count("*").alias("size"))
    running = Window.partitionBy(K, L).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(running), F.lit(0)))
    many = due.where("spans > 1").join(sizes, [K, L, "span"]).where("before < take")
    inside = many.where("before + size <= take").select(K, I)
    last = few.select(K, L, I, "take", "rank", "span", "before").unionByName(many.where("before + size > take").select(K, L, I, "take", "rank", "span", "before"))
    by = Window.partitionBy(K, L, "span").orderBy("rank", I)
    last = last.withColumn("k", F.row_number().over(by) + F.col("before")).where("k <= take").select(K, I)
    return whole.unionByName(inside).unionByName(last)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
