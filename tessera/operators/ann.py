"""Approximate vector search by an inverted file: vectors are stored by their nearest centroid, and a search reads the
partitions of the few centroids nearest to the query. Exact search is in retrieval.py; this is for tables where a full
scan for each query is too much.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vector import unit
from tessera.operators.retrieval import vector_topk

LISTS, TRAIN_ROWS = 100, 20_000


def centroids(vectors: np.ndarray, lists: int, rounds: int = 15, seed: int = 3) -> np.ndarray:
    """Spherical k-means; a list left empty takes the vector that fits its own worst."""
    rows = unit(vectors)
    rng = np.random.default_rng(seed)
    c = rows[rng.choice(len(rows), min(lists, len(rows)), replace=False)]
    for _ in range(rounds):
        near = rows @ c.T
        own = near.argmax(1)
        for i in range(len(c)):
            mine = rows[own == i]
            c[i] = mine.sum(0) if len(mine) else rows[near.max(1).argmin()]
        c = unit(c)
    return c


class IVF:
    """A folder of rows partitioned by list, and its centroids."""

    def __init__(self, spark: SparkSession, folder: str, id_: str, vector: str):
        self.spark, self.folder, self.id, self.vector = spark, folder, id_, vector
        got = spark.read.parquet(f"{folder}/centroids").orderBy("list").collect()  # as many as there are lists
        self.centroids = np.array([r.centroid for r in got])

    @staticmethod
    def build(rows: DataFrame, folder: str, lists: int = LISTS, id_: str = "chunk_id", vector: str = "vector", train_rows: int = TRAIN_ROWS) -> IVF:
        """Centroids are trained on at most train_rows rows, chosen by the hash of the id."""
        spark = rows.sparkSession
        sample = rows.orderBy(F.xxhash64(id_), id_).limit(train_rows).select(vector).collect()
        c = centroids(np.array([r[0] for r in sample]), lists)
        sent = spark.sparkContext.broadcast(c)
        at = rows.schema.fieldNames().index(vector)
        kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    own = (unit(np.array(batch.column(at).to_pylist())) @ sent.value.T).argmax(1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=[*batch.schema.names, "list"])

        placed = rows.mapInArrow(assign, f"{kinds}, list int").repartition("list")
        placed.write.mode("overwrite").partitionBy("list").parquet(f"{folder}/rows")
        spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(c)], "list int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centroids")
        return IVF(spark, folder, id_, vector)

    def search(self, query: Sequence[float], limit: int = 5, probes: int = 10) -> DataFrame:
        near = np.argsort(-(self.centroids @ unit(np.array([query]))[0]), kind="stable")[:probes]
        rows = self.spark.read.parquet(f"{self.folder}/rows").where(F.col("list").isin(*map(int, near)))
        return vector_topk(rows, query, limit, self.id, self.vector)
