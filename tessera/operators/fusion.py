"""Fusion of two ranked lists (id, score) into one, as a union and an aggregate by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHT, K = 0.7, 60


def _both(first: DataFrame, second: DataFrame, weight: float, id_: str) -> DataFrame:
    """Rows (id, side, weight, score)."""
    one = first.select(id_, F.lit(0).alias("side"), F.lit(float(weight)).alias("weight"), F.col("score").cast("double").alias("score"))
    two = second.select(id_, F.lit(1).alias("side"), F.lit(1.0 - weight).alias("weight"), F.col("score").cast("double").alias("score"))
    return one.unionByName(two)


def _sum(rows: DataFrame, part: Column, limit: int, id_: str) -> DataFrame:
    return rows.withColumn("part", part).groupBy(id_).agg(F.sum("part").alias("score")).orderBy(F.desc("score"), id_).limit(limit)


def rrf(first: DataFrame, second: DataFrame, limit: int = 5, weight: float = WEIGHT, k: int = K, id_: str = "chunk_id") -> DataFrame:
    """Reciprocal ranks: the sum of weight / (k + rank)."""
    rank = F.row_number().over(Window.partitionBy("side").orderBy(F.desc("score"), id_))
    rows = _both(first, second, weight, id_).withColumn("rank", rank)
    return _sum(rows, F.col("weight") / (F.lit(max(1, k)) + F.col("rank")), limit, id_)


def weighted(first: DataFrame, second: DataFrame, limit: int = 5, weight: float = WEIGHT, id_: str = "chunk_id") -> DataFrame:
    """Scores scaled to 0..1 in each list; all are 1 in a list of equal scores."""
    side = Window.partitionBy("side")
    low, high = F.min("score").over(side), F.max("score").over(side)
    rows = _both(first, second, weight, id_).withColumn("scaled", F.when(high > low, (F.col("score") - low) / F.nullif(high - low, F.lit(0.0))).otherwise(F.lit(1.0)))
    return _sum(rows, F.col("weight") * F.col("scaled"), limit, id_)


def distribution(first: DataFrame, second: DataFrame, limit: int = 5, weight: float = WEIGHT, id_: str = "chunk_id") -> DataFrame:
    """Standard scores in each list; scores as they are in a list of equal ones."""
    side = Window.partitionBy("side")
    mean, spread = F.avg("score").over(side), F.stddev_pop("score").over(side)
    rows = _both(first, second, weight, id_).withColumn("scaled", F.when(spread > 0, (F.col("score") - mean) / F.nullif(spread, F.lit(0.0))).otherwise(F.col("score")))
    return _sum(rows, F.col("weight") * F.col("scaled"), limit, id_)


METHODS = {"rrf": rrf, "weighted": weighted, "distribution": distribution}


def hybrid(first: DataFrame, second: DataFrame, limit: int = 5, method: str = "rrf", id_: str = "chunk_id", **parameters: float) -> DataFrame:
    """first and second should hold twice the limit, so that rows low in one list can rise."""
    return METHODS[method](first, second, limit=limit, id_=id_, **parameters)
