"""Metadata values as plain strings, and small arithmetic on caches and batches."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flat(value: Any) -> str:
    """null is empty, lists are joined by ", ", objects are {key: value} by sorted keys."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, list):
        return ", ".join(map(flat, value))
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k}: {flat(v)}" for k, v in sorted(value.items())) + "}"
    return str(value)


def _strings(custom: pd.Series) -> pd.Series:
    return custom.map(lambda s: None if s is None else {k: flat(v) for k, v in json.loads(s).items()})


def flattened(custom: Column | str) -> Column:
    """A JSON object's keys with their values as strings; null for null."""
    return F.pandas_udf(_strings, "map<string,string>")(custom)


def hit_rate(hits: Column, misses: Column) -> Column:
    """Share of hits, 0 for no use at all."""
    return F.coalesce(F.try_divide(hits.cast("double"), (hits + misses).cast("double")), F.lit(0.0))


def batches(df: DataFrame, size: int, order: str, by: str | None = None) -> DataFrame:
    """df with column batch, from 0: size rows each in the order of a column, within each value of by if given."""
    if size <= 0:
        raise ValueError("size must be positive")
    window = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy(order)
    return df.withColumn("batch", F.floor((F.row_number().over(window) - 1) / size))
