"""Embeddings: a deterministic hashing embedder, and the way to run any embedder over a column of texts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 64
Embedder = Callable[[list[str]], np.ndarray]


def hashed(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Sums of signed unit vectors chosen by the hash of each word, normalized."""
    out = np.zeros((len(texts), dimensions))
    for i, text in enumerate(texts):
        for word in re.findall(r"\w+", text.lower()):
            h = zlib.crc32(word.encode())
            out[i, h % dimensions] += 1.0 if h >> 31 else -1.0
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def embed_udf(make: Callable[[], Embedder], batch: int = 100):
    """A column function array<float> of texts; the embedder is made once for each worker, and fed in batches."""

    @F.arrow_udf("array<float>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for texts in parts:
            # of a part only batch texts are held as Python strings
            got = [to_arrow(np.asarray(model([t or "" for t in texts.slice(at, batch).to_pylist()]), np.float32)) for at in range(0, len(texts), batch)]
            yield pa.concat_arrays(got) if got else to_arrow(np.zeros((0, 0), np.float32))

    return run


def hashing_embedder() -> Embedder:
    return hashed


def embed(df: DataFrame, text: str = "content", make: Callable[[], Embedder] = hashing_embedder, batch: int = 100) -> DataFrame:
    """df with a column vector."""
    return df.withColumn("vector", embed_udf(make, batch)(F.col(text)))


def embed_cached(df: DataFrame, cache: DataFrame | None = None, text: str = "content", make: Callable[[], Embedder] = hashing_embedder) -> tuple[DataFrame, DataFrame]:
    """(df with a column vector, new rows (text_hash, vector) for the cache). Each distinct text is embedded once."""
    keyed = df.withColumn("text_hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    wanted = keyed.groupBy("text_hash").agg(F.first(text).alias("text"))
    if cache is not None:
        wanted = wanted.join(cache, "text_hash", "left_anti")
    new = wanted.select("text_hash", embed_udf(make)(F.col("text")).alias("vector"))
    every = new if cache is None else cache.select("text_hash", "vector").unionByName(new)
    return keyed.join(every, "text_hash").drop("text_hash"), new


def to_arrow(vectors: np.ndarray) -> pa.Array:
    return pa.array(list(vectors), pa.list_(pa.float32()))
