"""Row-level isolation of tenants, their tiers, and token buckets replayed over an event log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.filters import Fields, Filter, compile_filter

TIERS = (("free", 10, 100, 1), ("standard", 60, 1000, 10), ("professional", 300, 10_000, 50), ("enterprise", 1000, None, 100))


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TIERS), "tier string, queries_per_minute int, documents_per_day int, max_document_mb int")


def isolate(chunks: DataFrame, tenant: str, prefix: str | None = None) -> DataFrame:
    """chunks as a tenant's: ids carry its prefix, the original document id is kept beside."""
    lead = F.lit(f"{prefix or tenant}_")
    out = chunks.withColumn("tenant_id", F.lit(tenant)).withColumn("original_document_id", F.col("document_id").cast("string"))
    return out.withColumn("chunk_id", F.concat(lead, F.col("chunk_id").cast("string"))).withColumn("document_id", F.concat(lead, F.col("document_id").cast("string")))


def of_tenant(chunks: DataFrame, tenant: str, where: Filter | None = None, fields: Fields | None = None) -> DataFrame:
    """A tenant's rows. A filter on documentId means the original id."""
    fields = fields or Fields()
    if "documentId" in fields.columns:
        fields = Fields(fields.columns | {"documentId": ("original_document_id", "string")}, fields.custom)
    return chunks.where((F.col("tenant_id") == tenant) & compile_filter(where, fields))


def restore(chunks: DataFrame, tenant: str, prefix: str | None = None) -> DataFrame:
    lead = f"{prefix or tenant}_"
    plain = F.when(F.startswith("chunk_id", F.lit(lead)), F.expr(f"substring(chunk_id, {len(lead) + 1})")).otherwise(F.col("chunk_id"))
    return chunks.withColumn("chunk_id", plain).withColumn("document_id", F.col("original_document_id")).drop("tenant_id", "original_document_id")


def counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("tenant_id").agg(F.count("*").alias("chunks"))


def replay_rate_limit(events: DataFrame, key: str, ts: str, id_: str, capacity: float, per_second: float) -> DataFrame:
    """(id, key, allowed, tokens): a token bucket for each key, full at first, over its events in the order of time.

    A task replays the keys it has, batch after batch of sorted events, and holds one bucket at a time. Each step needs
    the one before, so a hot key is serial. Events without a key share a bucket.
    """
    kinds = dict(events.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, last, held = float(capacity), None, object()
        for batch in batches:
            names, at = batch.column(key).to_pylist(), batch.column("_us").to_pylist()
            allowed, tokens = [], []
            for name, now in zip(names, at, strict=True):
                if name != held:
                    left, held = float(capacity), name
                elif now is not None and last is not None:
                    left = min(capacity, left + (now - last) / 1e6 * per_second)
                last, ok = now, left >= 1
                left -= ok
                allowed.append(ok)
                tokens.append(left)
            yield pa.RecordBatch.from_arrays([batch.column(id_), batch.column(key), pa.array(allowed, pa.bool_()), pa.array(tokens, pa.float64())], names=[id_, key, "allowed", "tokens"])

    rows = events.select(id_, key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"))
    return rows.repartition(key).sortWithinPartitions(key, "_us", id_).mapInArrow(run, f"{id_} {kinds[id_]}, {key} {kinds[key]}, allowed boolean, tokens double")


def bucket_function(capacity: float, per_second: float):
    """The same bucket for applyInPandasWithState: state (tokens, seconds of the last event)."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        left, last = state.get if state.exists else (float(capacity), None)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        allowed = []
        for at in rows["ts"]:
            now = at.timestamp()
            if last is not None:
                left = min(capacity, left + max(0.0, now - last) * per_second)
            last, ok = now, left >= 1
            left -= ok
            allowed.append(bool(ok))
        state.update((left, last))
        yield pd.DataFrame({"event_id": rows["event_id"], "key": str(key[0]), "allowed": allowed})

    return run
