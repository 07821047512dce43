"""Retrieval: exact vector search, BM25, reranking, diversity, and merging of several queries or indexes.

Ties are broken by id everywhere. A single query is ordered and limited, so Spark keeps a bounded heap for each task;
batches of queries go through numpy matrix products and keep k rows for each task before any shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vector as V
from tessera.functions.filters import Fields, Filter, compile_filter
from tessera.functions.text import STOP_WORDS, term_frequency, tokenize

K1, B = 1.2, 0.75
#: Rows of queries that are sent to all workers at most; a larger batch is searched in several passes.
QUERY_ROWS = 20_000


def _checked(limit: int) -> int:
    if limit <= 0:
        raise ValueError("limit must be positive")
    return limit


def vector_topk(embeddings: DataFrame, query: Sequence[float], limit: int = 5, id_: str = "chunk_id", vector: str = "vector", where: Filter | Column | None = None, fields: Fields | None = None, threshold: float | None = None) -> DataFrame:
    """The rows nearest to query by cosine, with score; the filter goes before scoring, the threshold after the limit."""
    condition = where if isinstance(where, Column) else compile_filter(where, fields) if where is not None else None
    rows = embeddings if condition is None else embeddings.where(condition)
    top = rows.withColumn("score", V.cosine_to(F.col(vector), list(query))).orderBy(F.desc("score"), id_).limit(_checked(limit))
    return top if threshold is None else top.where(F.col("score") >= threshold)


def vector_topk_batch(embeddings: DataFrame, queries: DataFrame, limit: int = 5, id_: str = "chunk_id", vector: str = "vector", query_id: str = "query_id") -> DataFrame:
    """(query_id, id, score, rank) of the limit nearest rows to each query."""
    _checked(limit)
    kinds = {c: t for d in (embeddings, queries) for c, t in d.dtypes}
    out = None
    asked = queries.select(query_id, vector).toArrow()
    for at in range(0, max(asked.num_rows, 1), QUERY_ROWS):
        part = _one_batch(embeddings, asked.slice(at, QUERY_ROWS), limit, id_, vector, query_id, kinds)
        out = part if out is None else out.unionByName(part)
    by = Window.partitionBy(query_id).orderBy(F.desc("score"), id_)
    return out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)


def _one_batch(embeddings: DataFrame, asked: pa.Table, limit: int, id_: str, vector: str, query_id: str, kinds: dict[str, str]) -> DataFrame:
    names, rows = asked.column(query_id).to_pylist(), asked.column(vector).to_pylist()
    size = max((len(r) for r in rows if r), default=1)
    wanted = V.unit(np.array([r if r and len(r) == size else [0.0] * size for r in rows]).reshape(-1, size))
    sent = embeddings.sparkSession.sparkContext.broadcast((names, wanted, [len(r or ()) for r in rows]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_, wanted_, sizes = sent.value
        best: pd.DataFrame | None = None
        for batch in batches:
            ids, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if not ids or not names_:
                continue
            fit = [r if r and len(r) == size and None not in r else [0.0] * size for r in lists]
            score = wanted_ @ V.unit(np.array(fit)).T
            keep = min(limit, len(ids))
            near = np.argpartition(-score, keep - 1, 1)[:, :keep] if keep < len(ids) else np.tile(np.arange(len(ids)), (len(names_), 1))
            # rows that tie with the last one kept are kept as well, so that ties can go by id
            last = np.take_along_axis(score, near, 1).min(1)
            q, r = np.nonzero(score >= last[:, None])
            found = pd.DataFrame({"q": q, "id": [ids[i] for i in r], "score": score[q, r]})
            best = found if best is None else pd.concat([best, found])
            best = best.sort_values(["q", "score", "id"], ascending=[True, False, True]).groupby("q").head(limit)
        if best is not None and len(best):
            yield pa.RecordBatch.from_arrays([pa.array([names_[i] for i in best["q"]]), pa.array(best["id"].tolist()), pa.array(best["score"].to_numpy())], names=[query_id, id_, "score"])

    return embeddings.select(id_, vector).mapInArrow(search, f"{query_id} {kinds[query_id]}, {id_} {kinds[id_]}, score double")


class BM25:
    """An inverted index as tables: lengths (id, length) and postings (id, term, tf).

    An index just built still knows its tokens; a search then reads the texts once and keeps what they hold of its terms,
    and only that is joined or shuffled. One that is written is searched by its postings, of which only the pages of the terms are read.
    """

    def __init__(self, lengths: DataFrame, postings: DataFrame, id_: str, by_row: Callable[..., DataFrame] | None = None):
        """by_row: from columns over an array "tokens" to (id, those columns), a row for each chunk."""
        self.lengths, self.postings, self.id, self.by_row = lengths, postings, id_, by_row

    @staticmethod
    def build(chunks: DataFrame, id_: str = "chunk_id", content: str = "content", min_length: int = 3, stop_words: bool = True) -> BM25:
        """The index of chunks, each of which has an id of its own."""
        tokens = chunks.select(id_, tokenize(F.col(content), min_length, stop_words).alias("tokens"))
        lengths = tokens.select(id_, F.size("tokens").alias("length"))
        # a chunk's terms are counted in its row: ends of runs in its sorted tokens, so nothing is shuffled
        runs = tokens.select(id_, F.sort_array("tokens").alias("t"))
        last = F.filter(F.sequence(F.lit(1), F.greatest(F.size("t"), F.lit(1))), lambda i: ~F.get("t", i - 1).eqNullSafe(F.get("t", i)))
        counted = F.transform("ends", lambda e, k: F.struct(F.get("t", e - 1).alias("term"), (e - F.coalesce(F.get("ends", k - 1), F.lit(0))).cast("bigint").alias("tf")))
        postings = runs.where(F.size("t") > 0).select(id_, "t", last.alias("ends")).select(id_, F.explode(counted).alias("p")).select(id_, "p.term", "p.tf")
        return BM25(lengths, postings, id_, lambda *columns: tokens.select(id_, *columns))

    def persist(self) -> BM25:
        return BM25(self.lengths.persist(), self.postings.persist(), self.id)

    def write(self, folder: str) -> BM25:
        """The index as Parquet: a segment for each part of the chunks, sorted by term, so that a search reads the pages
        of its terms. Nothing is shuffled."""
        self.lengths.write.mode("overwrite").parquet(f"{folder}/lengths")
        self.postings.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/postings")
        return BM25.read(self.lengths.sparkSession, folder, self.id)

    @staticmethod
    def read(spark, folder: str, id_: str = "chunk_id") -> BM25:
        return BM25(spark.read.parquet(f"{folder}/lengths"), spark.read.parquet(f"{folder}/postings"), id_)

    def without(self, ids: DataFrame) -> BM25:
        left = lambda rows: rows.join(ids.select(self.id), self.id, "left_anti")
        return BM25(left(self.lengths), left(self.postings), self.id, None if self.by_row is None else lambda *columns: left(self.by_row(*columns)))

    def replaced(self, other: BM25) -> BM25:
        """This index with all rows of other, which come in the place of those with the same ids."""
        left = self.without(other.lengths.select(self.id))
        known = left.by_row is not None and other.by_row is not None
        by_row = (lambda *columns: left.by_row(*columns).unionByName(other.by_row(*columns))) if known else None
        return BM25(left.lengths.unionByName(other.lengths), left.postings.unionByName(other.postings), self.id, by_row)

    def document_frequencies(self) -> DataFrame:
        rows = self.postings if self.by_row is None else self.by_row(F.array_distinct("tokens").alias("terms")).select(F.explode("terms").alias("term"))
        return rows.groupBy("term").agg(F.count("*").alias("df"))

    def search(self, query: str, limit: int = 5, where: DataFrame | None = None, min_length: int = 3, stop_words: bool = True) -> DataFrame:
        """(id, score): terms of query count as often as they are in it; where: ids that may be returned. The weights
        are those of the whole index."""
        return self.scored(query, where, min_length, stop_words).orderBy(F.desc("score"), self.id).limit(_checked(limit))

    def scored(self, query: str, where: DataFrame | None = None, min_length: int = 3, stop_words: bool = True) -> DataFrame:
        """search without a limit: all that hold a term."""
        times = Counter(query_terms(query, min_length, stop_words))
        rows = self._by_postings(times) if self.by_row is None else self._by_tokens(times)
        return rows if where is None else rows.join(where.select(self.id), self.id, "left_semi")

    def _by_tokens(self, times: Mapping[str, int]) -> DataFrame:
        terms = list(times) or [""]
        found = self.by_row(F.size("tokens").alias("length"), F.filter("tokens", lambda t: t.isin(*terms)).alias("found")).persist()
        tf = [term_frequency(F.lit(w), F.col("found")) for w in terms]
        known = [F.sum((x > 0).cast("bigint")).alias(f"df{i}") for i, x in enumerate(tf)]
        whole = found.agg(F.count("*").alias("n"), F.greatest(F.lit(1.0), F.coalesce(F.avg("length"), F.lit(0.0))).alias("mean"), *known)
        rows = found.where(F.size("found") > 0).crossJoin(F.broadcast(whole))  # one row
        score = sum((F.lit(times.get(w, 0)) * _part(x, F.col(f"df{i}")) for i, (w, x) in enumerate(zip(terms, tf, strict=True))), F.lit(0.0))
        return rows.select(self.id, score.alias("score"))

    def _by_postings(self, times: Mapping[str, int]) -> DataFrame:
        hits = self.postings.where(F.col("term").isin(*times) if times else F.lit(False))
        known = hits.groupBy("term").agg(F.count("*").alias("df"))
        whole = self.lengths.agg(F.count("*").alias("n"), F.greatest(F.lit(1.0), F.coalesce(F.avg("length"), F.lit(0.0))).alias("mean"))
        # a row for each term of the query
        weighted = F.broadcast(known.crossJoin(F.broadcast(whole)))
        rows = hits.join(weighted, "term").join(self.lengths, self.id)
        return rows.groupBy(self.id).agg(F.sum(_times(times) * _part(F.col("tf"), F.col("df"))).alias("score"))


def _times(times: Mapping[str, int]) -> Column:
    out = F.lit(0)
    for term, n in times.items():
        out = F.when(F.col("term") == term, n).otherwise(out)
    return out


def _part(tf: Column, df: Column) -> Column:
    """A term's share of a score; needs n, mean and length."""
    rarity = F.log1p((F.col("n") + 0.5 - df) / (df + 0.5))
    relative = F.col("length") / F.col("mean")
    return rarity * tf * (1 + K1) / (K1 * (relative * B + (1 - B)) + tf)


def query_terms(query: str, min_length: int = 3, stop_words: bool = True) -> list[str]:
    """The terms of a query, by the rule of functions.text.tokenize."""
    words = "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in query.lower()).split(" ")
    return [w for w in words if len(w) >= max(1, min_length) and not (stop_words and w in STOP_WORDS)]


def merge_queries(results: DataFrame, limit: int = 5, id_: str = "chunk_id") -> DataFrame:
    """One list from those of several queries: of each id the row of its highest score."""
    others = [c for c in results.columns if c not in (id_, "score")]
    best = F.max(F.struct("score", *others)) if not others else F.max_by(F.struct("score", *others), "score")
    return results.groupBy(id_).agg(best.alias("b")).select(id_, "b.*").orderBy(F.desc("score"), id_).limit(_checked(limit))


def generated_queries(query: str, generate: Callable[[str], str], most: int = 3) -> list[str]:
    """The query, then the first most lines that generate makes of it, without numbering; the query alone if it fails."""
    try:
        lines = generate(query).split("\n")
    except Exception:
        return [query]
    plain = (re.sub(r"^(?:\d+\.|[-*])\s*", "", line.strip()).strip() for line in lines)
    return [query, *[x for x in plain if x][:most]]


def multi_query(search: Callable[[str], DataFrame], queries: Sequence[str], limit: int = 5, id_: str = "chunk_id") -> DataFrame | None:
    """search for each distinct query, the original first; None for a blank one. Variants that fail are left out."""
    asked = list(dict.fromkeys(q.strip()[:1000] for q in queries if q.strip()))
    if not asked or limit <= 0:
        return None
    out = search(asked[0])
    for q in asked[1:]:
        try:
            out = out.unionByName(search(q))
        except Exception:  # noqa: BLE001 - the original query's results stand
            continue
    return merge_queries(out, limit, id_)


def rerank(results: DataFrame, score: Column, limit: int = 5, id_: str = "chunk_id") -> DataFrame:
    """results by a new score."""
    return results.withColumn("score", score).orderBy(F.desc("score"), id_).limit(_checked(limit))


def rank_scores(results: DataFrame, id_: str = "chunk_id") -> DataFrame:
    """Scores 1, 0.9, 0.8 ... by the present order, as a stand-in for a reranker. For lists of search results."""
    rank = F.row_number().over(Window.orderBy(F.desc("score"), id_))
    return results.withColumn("score", F.lit(1.0) - F.lit(0.1) * (rank - 1))


def multi_index(results: DataFrame, index: str = "index", limit: int = 3, id_: str = "chunk_id", names: Sequence[str] | None = None) -> DataFrame:
    """The limit best of each index; indexes that are not there are left out. Not merged."""
    rows = results if names is None else results.where(F.col(index).isin(*names))
    by = Window.partitionBy(index).orderBy(F.desc("score"), id_)
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)


def mmr(candidates: DataFrame, query: Sequence[float], limit: int = 5, balance: float = 0.5, id_: str = "chunk_id", vector: str = "vector", group: Sequence[str] = ()) -> DataFrame:
    """Greedy choice of limit rows by balance * cosine with query - (1 - balance) * highest cosine with those chosen.

    Ties go to the first by similarity, then id. candidates are those of one query, or of one for each value of group.
    """
    _checked(limit)
    balance = min(max(balance, 0.0), 1.0)
    kinds = dict(candidates.dtypes)
    q = V.unit(np.array([query], np.float64))[0]
    keys = [F.lit(1).alias("_one")] if not group else [F.col(c) for c in group]

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        vectors = V.unit(np.stack(rows[vector].to_numpy()))
        near = vectors @ q
        order = np.lexsort((rows[id_].to_numpy(), -near))
        rows, vectors, near = rows.iloc[order], vectors[order], near[order]
        worst, left, picked, scores = np.zeros(len(rows)), np.ones(len(rows), bool), [], []
        while left.any() and len(picked) < limit:
            score = np.where(left, balance * near - (1 - balance) * worst, -np.inf)
            best = int(np.argmax(score > score.max() - 1e-12))
            picked.append(best)
            scores.append(float(score[best]))
            left[best] = False
            with_best = vectors @ vectors[best]
            worst = with_best if len(picked) == 1 else np.maximum(worst, with_best)
        out = {c: rows[c].to_numpy()[picked] for c in (*group, id_)}
        return pd.DataFrame(out | {"rank": np.arange(1, len(picked) + 1), "score": scores})

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in (*group, id_)), "rank int", "score double"])
    return candidates.select(*group, id_, vector).groupBy(*keys).applyInPandas(choose, schema)


def confidence(results: DataFrame) -> DataFrame:
    """(mean_score, confidence) of a result list."""
    mean = F.avg("score")
    return results.agg(mean.alias("mean_score")).withColumn("confidence", F.when(F.col("mean_score") > 0.8, "high").when(F.col("mean_score") > 0.5, "medium").otherwise("low"))
