"""Context for a question from ranked results: a cap for each source, a token budget, formatting, and reductions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import token_count
from tessera.functions.segments import token_count as token_count_of

SEPARATOR = "\n\n---\n\n"
EMPTY = "No relevant information was found."


def ranked(results: DataFrame, id_: str = "chunk_id") -> DataFrame:
    return results.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_)))


def source_cap(results: DataFrame, most: int, by: Column | None = None) -> DataFrame:
    """The first most results of each source, or of each document without one; needs rank."""
    if most <= 0:
        raise ValueError("most must be positive")
    key = F.coalesce("source", "document_id") if by is None else by
    n = F.row_number().over(Window.partitionBy(key).orderBy("rank"))
    return results.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def formatted(results: DataFrame, metadata: bool = True, scores: bool = False) -> DataFrame:
    """With columns position, from 1 on, and block: a header line and the content. Needs rank."""
    out = results.withColumn("position", F.row_number().over(Window.orderBy("rank")))
    if not metadata:
        return out.withColumn("block", F.col("content"))
    head = F.concat(F.lit("[Source "), F.col("position").cast("string"), F.lit("] ("), F.coalesce("source", F.lit("Unknown")), F.lit(")"))
    if scores:
        head = F.concat(head, F.format_string(" [score: %.4f]", F.col("score").cast("double")))
    return out.withColumn("block", F.concat(head, F.lit("\n"), F.col("content")))


def budget(blocks: DataFrame, max_tokens: int, separator: str = SEPARATOR) -> DataFrame:
    """The blocks before the first that would go over max_tokens, separators counted. Needs position and block."""
    if max_tokens <= 0:
        raise ValueError("max_tokens must be positive")
    between = token_count_of(separator)
    cost = token_count(F.col("block")) + F.when(F.col("position") > 1, between).otherwise(0)
    running = F.sum(cost).over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("tokens", running).where(F.col("tokens") <= max_tokens)


def build(results: DataFrame, max_tokens: int, most: int | None = None, metadata: bool = True, scores: bool = False, separator: str = SEPARATOR, id_: str = "chunk_id") -> DataFrame:
    """One row (context, chunks) from a list of search results."""
    rows = ranked(results, id_)
    rows = rows if most is None else source_cap(rows, most)
    kept = budget(formatted(rows, metadata, scores), max_tokens, separator)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("position", "block"))), lambda x: x.block)
    return kept.agg(F.array_join(lines, separator).alias("context"), F.count("*").alias("chunks"))


def structured(results: DataFrame, most: int | None = None, id_: str = "chunk_id") -> DataFrame:
    """(index, content, source, score) in order, without a budget."""
    rows = ranked(results, id_)
    rows = formatted(rows if most is None else source_cap(rows, most), metadata=False)
    return rows.select(F.col("position").alias("index"), "content", "source", F.col("score").cast("double").alias("score"))


def tree_reduce(texts: Sequence[str], combine: Callable[[list[str]], str], group: int = 4) -> str:
    """texts combined in groups, then the results, until one is left."""
    level, group = list(texts), max(2, group)
    if not level:
        return EMPTY
    while len(level) > 1:
        level = [combine(level[i : i + group]) for i in range(0, len(level), group)]
    return level[0]


def refine(texts: Sequence[str], first: Callable[[str], str], again: Callable[[str, str], str]) -> str:
    """A left fold: an answer from the first text, refined by each other."""
    if not texts:
        return EMPTY
    answer = first(texts[0])
    for text in texts[1:]:
        answer = again(answer, text)
    return answer


def tree_levels(rows: DataFrame, combine: Callable[[Column], Column], group: int = 4, order: str = "position", text: str = "content") -> DataFrame:
    """tree_reduce as a plan, for long lists: groups of neighbours are combined by an expression on their array."""
    group = max(2, group)
    level = rows.select(F.col(order).cast("long").alias("i"), F.col(text).alias("text"))
    n = level.count()
    while n > 1:
        both = F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x.text)
        level = level.groupBy(F.floor((F.col("i") - 1) / group).alias("g")).agg(combine(both).alias("text")).select((F.col("g") + 1).alias("i"), "text")
        n = -(-n // group)
    return level.select("text")
