"""One query for each operator over the test tables, and the same in SQL where SQL has it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import filters as flt
from tessera.functions import metadata as M
from tessera.functions import text as T
from tessera.functions import vector as V
from tessera.functions.embed import embed_cached
from tessera.functions.filters import Fields, Filter, compile_filter, where
from tessera.operators import chunking, context, fusion, retrieval, store, tenancy
from tessera.schema import chunk_errors
from tessera.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: White space of any kind as a class of DuckDB's patterns.
SPACE = r"[\x09-\x0d \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), "source", "lang")


def rounded(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# chunks

TRIM = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
FIXED = rf"""chunks AS (SELECT doc_id AS document_id, i::INT AS chunk_index, substring(t, i * 800 + 1, 1000) AS content,
  (i * 800)::INT AS start_offset, least(i * 800 + 1000, n)::INT AS end_offset
  FROM (SELECT *, unnest(range(CASE WHEN n <= 1000 THEN 1 ELSE (n - 1000 + 799) // 800 + 1 END)) AS i
    FROM (SELECT doc_id, {TRIM} AS t, length({TRIM}) AS n FROM documents) WHERE n > 0))"""


def _fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_size(documents(spark, sf_dir))


query("chunk_fixed_size", f"WITH {FIXED} SELECT * FROM chunks")(_fixed)


@query(
    "chunk_fixed_tokens",
    rf"""SELECT doc_id AS document_id, i::INT AS chunk_index, substring(t, i * 1756 + 1, 1946) AS content, (i * 1756)::INT AS start_offset, least(i * 1756 + 1946, n)::INT AS end_offset
  FROM (SELECT *, unnest(range(CASE WHEN n <= 1946 THEN 1 ELSE (n - 1946 + 1755) // 1756 + 1 END)) AS i
    FROM (SELECT doc_id, {TRIM} AS t, length({TRIM}) AS n FROM documents) WHERE n > 0)""",
)
def chunk_fixed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_tokens(documents(spark, sf_dir), 512, 50, "cl100k")


@query(
    "chunk_statistics",
    f"WITH {FIXED} SELECT count(*) AS count, sum(length(content))::BIGINT AS total_characters, round(avg(length(content)), 6) AS average_size, min(length(content)) AS min_size, max(length(content)) AS max_size, floor(median(length(content)))::BIGINT AS median_size FROM chunks",
)
def chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.statistics(_fixed(spark, sf_dir)).withColumn("average_size", rounded("average_size"))


@query("chunk_validate", f"WITH {FIXED} SELECT document_id || ':' || chunk_index AS chunk_id, chunk_index, 'chunk of ' || length(content) || ' characters is over the limit of 900' AS reason FROM chunks WHERE length(content) > 900")
def chunk_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _fixed(spark, sf_dir).withColumn("chunk_id", F.concat_ws(":", F.col("document_id").cast("string"), F.col("chunk_index").cast("string")))
    return chunk_errors(named, 900)


@query(
    "chunk_overlap",
    f"WITH {FIXED} SELECT document_id, chunk_index, tail || content AS content, greatest(0, start_offset - length(tail))::INT AS start_offset, end_offset FROM (SELECT *, coalesce(right(lag(content) OVER (PARTITION BY document_id ORDER BY chunk_index), 50), '') AS tail FROM chunks)",
)
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.add_overlap(_fixed(spark, sf_dir), 50)


@query(
    "chunk_overlap_removed",
    f"""WITH {FIXED}, p AS (SELECT *, coalesce(lag(content) OVER (PARTITION BY document_id ORDER BY chunk_index), '') AS before FROM chunks),
  c AS (SELECT *, coalesce(list_max(list_filter(range(1, least(length(before), length(content)) + 1), lambda n: right(before, n) = left(content, n))), 0) AS cut FROM p)
  SELECT document_id, chunk_index, substring(content, cut + 1) AS content, (start_offset + cut)::INT AS start_offset, end_offset FROM c""",
)
def chunk_overlap_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.remove_overlap(_fixed(spark, sf_dir))


@query("paragraph_split", r"SELECT doc_id, p AS paragraph FROM (SELECT doc_id, unnest(list_transform(regexp_split_to_array(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n\s*\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))) AS p FROM documents) WHERE p <> ''")
def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.explode(T.paragraphs(F.col("content"))).alias("paragraph"))


# text functions


@query("token_count", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 3.8::DOUBLE)::INT) END AS cl100k, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4)::INT END AS simple FROM documents")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.token_count(F.col("content"), "cl100k").alias("cl100k"), T.token_count(F.col("content")).alias("simple"))


@query("token_total", "SELECT sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END)::BIGINT AS tokens FROM documents")
def token_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).agg(F.sum(T.token_count(F.col("content"))).alias("tokens"))


@query("preview", "SELECT doc_id, left(text, 100) || CASE WHEN length(text) > 100 THEN '...' ELSE '' END AS preview FROM documents")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.preview(F.col("content"), 100).alias("preview"))


@query("key_hash", "SELECT page_id, sha256(url) AS hash FROM pages")
def key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.key_hash(F.col("url")).alias("hash"))


# keyword search

STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
TOKENS = rf"list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda x: length(x) >= 3 AND x NOT IN ({STOP}))"
POSTINGS = f"""t AS (SELECT doc_id, {TOKENS} AS w FROM documents),
lengths AS (SELECT doc_id, len(w) AS length FROM t),
postings AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM t) GROUP BY ALL)"""
ASKED, OTHER = "ering ering thhe stupid outi", "erhe onea thand idiot ouerre ement"


def bm25_sql(name: str, asked: str, limit: int | None, condition: str = "true") -> str:
    terms = ", ".join(f"('{w}')" for w in asked.split())
    order = f" ORDER BY score DESC, doc_id LIMIT {limit}" if limit else ""
    return f"""{name} AS (SELECT doc_id, sum(times * ln(1 + (0.5 + n - df) / (0.5 + df)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score
  FROM (SELECT term, count(*) AS times FROM (VALUES {terms}) v(term) WHERE length(term) >= 3 GROUP BY term) q JOIN postings USING (term)
  JOIN (SELECT term, count(*) AS df FROM postings GROUP BY term) USING (term) JOIN lengths USING (doc_id), (SELECT count(*) AS n, greatest(1.0::DOUBLE, avg(length)) AS mean FROM lengths)
  WHERE doc_id IN (SELECT doc_id FROM documents WHERE {condition}) GROUP BY doc_id{order})"""


def _index(spark: SparkSession, sf_dir: str) -> retrieval.BM25:
    return retrieval.BM25.build(documents(spark, sf_dir), "doc_id")


INDEXES: dict[tuple[str, str], retrieval.BM25] = {}


def _stored(spark: SparkSession, sf_dir: str) -> retrieval.BM25:
    """The index as a service has it: written once for an application, in the shared folder, then searched by its postings."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in INDEXES:
        INDEXES[key] = _index(spark, sf_dir).write(f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    return INDEXES[key]


@query("tokenize", f"SELECT doc_id, {TOKENS} AS tokens FROM documents")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.tokenize(F.col("content")).alias("tokens"))


@query("term_frequencies", f"WITH {POSTINGS} SELECT * FROM postings")
def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).postings


@query("bm25_df", f"WITH {POSTINGS} SELECT term, count(*) AS df FROM postings GROUP BY term")
def bm25_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).document_frequencies()


@query("bm25_topk", f"WITH {POSTINGS}, {bm25_sql('hits', ASKED, 10)} SELECT doc_id, round(score, 6) AS score FROM hits")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).search(ASKED, 10).select("doc_id", rounded("score").alias("score"))


LANG = "lang IN ('de', 'en')"


@query("bm25_filtered", f"WITH {POSTINGS}, {bm25_sql('hits', ASKED, 10, LANG)} SELECT doc_id, round(score, 6) AS score FROM hits")
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = documents(spark, sf_dir).where(F.col("lang").isin("de", "en"))
    return _index(spark, sf_dir).search(ASKED, 10, where=some).select("doc_id", rounded("score").alias("score"))


@query("bm25_remove", f"WITH {POSTINGS.replace('FROM documents', 'FROM documents WHERE doc_id % 3 <> 0')}, {bm25_sql('hits', ASKED, 10)} SELECT doc_id, round(score, 6) AS score FROM hits")
def bm25_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = documents(spark, sf_dir).where("doc_id % 3 = 0").select("doc_id")
    return _index(spark, sf_dir).without(gone).search(ASKED, 10).select("doc_id", rounded("score").alias("score"))


# vector search


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings")


def _first(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(_embeddings(spark, sf_dir).where("vec_id = 0").first()["embedding"])


Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
SCORED = f"scored AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], {Q}) AS score FROM embeddings)"


@query("vector_topk", f"WITH {SCORED} SELECT vec_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.vector_topk(_embeddings(spark, sf_dir), _first(spark, sf_dir), 10, "vec_id", "embedding").select("vec_id", rounded("score").alias("score"))


LABEL = Fields({"label": ("label", "int")}, None)


@query("vector_topk_filtered", f"WITH {SCORED} SELECT vec_id, round(score, 6) AS score FROM scored WHERE label >= 3 ORDER BY scored.score DESC, vec_id LIMIT 10")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.vector_topk(_embeddings(spark, sf_dir), _first(spark, sf_dir), 10, "vec_id", "embedding", where("label", "greaterThanOrEqual", 3), LABEL).select("vec_id", rounded("score").alias("score"))


@query("vector_threshold", f"WITH {SCORED}, top AS (SELECT * FROM scored ORDER BY score DESC, vec_id LIMIT 20) SELECT vec_id, round(score, 6) AS score FROM top WHERE top.score >= 0.3")
def vector_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.vector_topk(_embeddings(spark, sf_dir), _first(spark, sf_dir), 20, "vec_id", "embedding", threshold=0.3).select("vec_id", rounded("score").alias("score"))


@query(
    "vector_topk_batch",
    "SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) DESC, e.vec_id)::INT AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) s WHERE rank <= 5",
)
def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.vector_topk_batch(e, asked, 5, "vec_id", "embedding").withColumn("score", rounded("score"))


@query("vector_dot", f"SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], {Q}), 6) AS dot FROM embeddings")
def vector_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array(*map(F.lit, _first(spark, sf_dir)))
    return _embeddings(spark, sf_dir).select("vec_id", rounded(V.dot(F.col("embedding"), q)).alias("dot"))


@query("vector_euclidean", f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {Q}), 6) AS distance FROM embeddings")
def vector_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array(*map(F.lit, _first(spark, sf_dir)))
    return _embeddings(spark, sf_dir).select("vec_id", rounded(V.euclidean(F.col("embedding"), q)).alias("distance"))


NORM = "sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))"


@query("vector_magnitude", f"SELECT vec_id, round({NORM}, 6) AS magnitude FROM embeddings")
def vector_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddings(spark, sf_dir).select("vec_id", rounded(V.magnitude(F.col("embedding"))).alias("magnitude"))


@query("vector_normalize", f"SELECT vec_id, (unnest(range(64)) + 1)::INT AS i, round(unnest(embedding::DOUBLE[]) / {NORM}, 6) AS x FROM embeddings")
def vector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = _embeddings(spark, sf_dir).select("vec_id", F.posexplode(V.normalize(F.col("embedding"))).alias("i", "x"))
    return unit.select("vec_id", (F.col("i") + 1).alias("i"), rounded("x").alias("x"))


@query("confidence_label", f"WITH {SCORED}, top AS (SELECT * FROM scored ORDER BY score DESC, vec_id LIMIT 5) SELECT round(avg(score), 6) AS mean_score, CASE WHEN avg(score) > 0.8 THEN 'high' WHEN avg(score) > 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM top")
def confidence_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = retrieval.vector_topk(_embeddings(spark, sf_dir), _first(spark, sf_dir), 5, "vec_id", "embedding")
    return retrieval.confidence(top).withColumn("mean_score", rounded("mean_score"))


# fusion, merging, reranking


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    index = _stored(spark, sf_dir)
    return index.search(ASKED, 20), index.search(OTHER, 20)


LISTS = f"{POSTINGS}, {bm25_sql('a', ASKED, 20)}, {bm25_sql('b', OTHER, 20)}"
SIDES = f"{LISTS}, both_ AS (SELECT doc_id, 0 AS side, 0.7::DOUBLE AS weight, score FROM a UNION ALL SELECT doc_id, 1, 1.0::DOUBLE - 0.7::DOUBLE, score FROM b)"
PARTS = {
    "rrf": "weight / (60 + row_number() OVER (PARTITION BY side ORDER BY score DESC, doc_id))",
    "weighted": "weight * CASE WHEN max(score) OVER (PARTITION BY side) > min(score) OVER (PARTITION BY side) THEN (score - min(score) OVER (PARTITION BY side)) / (max(score) OVER (PARTITION BY side) - min(score) OVER (PARTITION BY side)) ELSE 1 END",
    "distribution": "weight * CASE WHEN stddev_pop(score) OVER (PARTITION BY side) > 0 THEN (score - avg(score) OVER (PARTITION BY side)) / stddev_pop(score) OVER (PARTITION BY side) ELSE score END",
}


def _fusion(method: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fusion.hybrid(*_lists(spark, sf_dir), limit=10, method=method, id_="doc_id").select("doc_id", rounded("score").alias("score"))

    query(f"hybrid_{method}", f"WITH {SIDES}, p AS (SELECT doc_id, {PARTS[method]} AS part FROM both_), s AS (SELECT doc_id, sum(part) AS score FROM p GROUP BY doc_id) SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 10")(run)


for _method in PARTS:
    _fusion(_method)


@query("multi_query_merge", f"WITH {LISTS}, m AS (SELECT doc_id, max(score) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id) SELECT doc_id, round(score, 6) AS score FROM m ORDER BY m.score DESC, doc_id LIMIT 10")
def multi_query_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _stored(spark, sf_dir)
    return retrieval.multi_query(lambda q: index.search(q, 20), [ASKED, OTHER, ASKED], 10, "doc_id").select("doc_id", rounded("score").alias("score"))


@query("mock_rerank", f"WITH {LISTS} SELECT doc_id, round(1 - 0.1 * (row_number() OVER (ORDER BY score DESC, doc_id) - 1), 6)::DOUBLE AS score FROM a")
def mock_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rank_scores(_lists(spark, sf_dir)[0], "doc_id").select("doc_id", rounded("score").alias("score"))


@query("rerank_by_length", f"WITH {LISTS} SELECT doc_id, (1.0 / (1 + abs(n_chars - 2000)))::DOUBLE AS score FROM a JOIN documents USING (doc_id) ORDER BY abs(n_chars - 2000), doc_id LIMIT 5")
def rerank_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _lists(spark, sf_dir)[0].join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return retrieval.rerank(found, F.lit(1.0) / (1 + F.abs(F.col("n_chars") - 2000)), 5, "doc_id").select("doc_id", "score")


@query("multi_index_search", f"WITH {POSTINGS}, {bm25_sql('hits', ASKED, None)} SELECT * FROM (SELECT lang, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id)::INT AS rank FROM hits JOIN documents USING (doc_id)) WHERE rank <= 3")
def multi_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = _stored(spark, sf_dir).scored(ASKED).join(docs.select("doc_id", "lang"), "doc_id")
    return retrieval.multi_index(found, "lang", 3, "doc_id").select("lang", "doc_id", rounded("score").alias("score"), "rank")


# context


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _lists(spark, sf_dir)[0]
    return documents(spark, sf_dir).join(F.broadcast(found), "doc_id").withColumn("document_id", F.col("doc_id").cast("string"))


RANKED = f"{LISTS}, r AS (SELECT doc_id, text AS content, source, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM a JOIN documents USING (doc_id))"


@query("context_source_cap", f"WITH {RANKED} SELECT doc_id, source, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(source, doc_id::VARCHAR) ORDER BY rank) AS n FROM r) WHERE n <= 1")
def context_source_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.source_cap(context.ranked(_results(spark, sf_dir), "doc_id"), 1).select("doc_id", "source", "rank")


BLOCKS = f"{RANKED}, k AS (SELECT *, '[Source ' || rank || '] (' || coalesce(source, 'Unknown') || ')' || chr(10) || content AS block FROM r), c AS (SELECT *, sum(greatest(1, length(block) // 4) + CASE WHEN rank > 1 THEN 1 ELSE 0 END) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) AS tokens FROM k)"


@query("context_budget", f"WITH {BLOCKS} SELECT doc_id, rank::INT AS position, tokens::BIGINT AS tokens FROM c WHERE tokens <= 4096")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = context.formatted(context.ranked(_results(spark, sf_dir), "doc_id"))
    return context.budget(blocks, 4096).select("doc_id", "position", "tokens")


@query("context_format", f"WITH {BLOCKS} SELECT string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS chunks FROM c WHERE tokens <= 4096")
def context_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.build(_results(spark, sf_dir), 4096, id_="doc_id")


@query("context_structured", f"WITH {RANKED} SELECT rank::INT AS index, content, source, round(score, 6) AS score FROM r")
def context_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.structured(_results(spark, sf_dir), id_="doc_id").withColumn("score", rounded("score"))


# filters, over the JSON properties of events and a key that only some have

FIELDS = Fields({"type": ("event_type", "string"), "value": ("value", "double"), "user": ("user_id", "int")})
CUSTOM = "CASE WHEN event_id % 5 = 0 THEN '{}' WHEN event_id % 5 = 1 THEN '{\"k\": null}' WHEN event_id % 5 = 2 THEN '{\"k\": \"' || event_id % 7 || '\"}' ELSE props END"
EVENTS = f"e AS (SELECT *, {CUSTOM} AS custom FROM events), j AS (SELECT *, json_type(custom, '$.k') AS kind, TRY_CAST(json_extract_string(custom, '$.k') AS DOUBLE) AS num, json_extract_string(custom, '$.k') AS str FROM e)"
NUM, STR = "(kind IN ('BIGINT', 'UBIGINT', 'DOUBLE'))", "(kind = 'VARCHAR')"
FILTERS: dict[str, tuple[Filter, str]] = {
    "equals": (where("k", "equals", 3), f"{NUM} AND num = 3"),
    "not_equals": (where("k", "notEquals", 3), f"NOT coalesce({NUM} AND num = 3, false)"),
    "greater": (where("k", "greaterThan", 40), f"{NUM} AND num > 40"),
    "less": (where("k", "lessThan", 40), f"{NUM} AND num < 40"),
    "greater_equal": (where("k", "greaterThanOrEqual", 40), f"{NUM} AND num >= 40"),
    "less_equal": (where("k", "lessThanOrEqual", 40.5), f"{NUM} AND num <= 40.5"),
    "in": (where("k", "in", [1, 2, "3", "4"]), f"({NUM} AND num IN (1, 2)) OR ({STR} AND str IN ('3', '4'))"),
    "not_in": (where("k", "notIn", [1, 2, "3", "4"]), f"NOT coalesce(({NUM} AND num IN (1, 2)) OR ({STR} AND str IN ('3', '4')), false)"),
    "contains": (where("type", "contains", "i"), "contains(event_type, 'i')"),
    "starts_with": (where("type", "startsWith", "c"), "starts_with(event_type, 'c')"),
    "ends_with": (where("k", "endsWith", "3"), f"{STR} AND ends_with(str, '3')"),
    "exists": (where("k", "exists"), "kind IS NOT NULL AND kind <> 'NULL'"),
    "not_exists": (where("k", "notExists"), "kind IS NULL OR kind = 'NULL'"),
    "and": (where("user", "greaterThan", 50) & where("k", "exists"), "user_id > 50 AND kind IS NOT NULL AND kind <> 'NULL'"),
    "or": (flt.any_of(where("user", "lessThan", 20), where("k", "equals", "3") & where("value", "greaterThan", 10)), f"user_id < 20 OR ({STR} AND str = '3' AND value > 10)"),
    "not": (~(where("k", "greaterThan", 10) & where("user", "lessThan", 100)), f"NOT (coalesce({NUM} AND num > 10, false) AND user_id < 100)"),
}


def _filter(name: str, node: Filter, condition: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = read(spark, sf_dir, "events").withColumn("custom", F.parse_json(F.expr(CUSTOM.replace("event_id % 7", "cast(event_id % 7 AS string)"))))
        return events.where(compile_filter(node, FIELDS)).select("event_id", "user_id")

    query(f"filter_{name}", f"WITH {EVENTS} SELECT event_id, user_id FROM j WHERE coalesce({condition}, false)")(run)


for _name, (_node, _condition) in FILTERS.items():
    _filter(_name, _node, _condition)


# the store


def _store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "content", "source")


@query("upsert", "SELECT doc_id AS chunk_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE text END AS content, source FROM documents UNION ALL SELECT -1 - doc_id, 'new', source FROM documents WHERE doc_id % 4 = 0")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _store_rows(spark, sf_dir)
    again = old.where("chunk_id % 4 = 0").withColumn("content", F.lit("new"))
    return store.upsert(old, again.unionByName(again.withColumn("chunk_id", -1 - F.col("chunk_id"))))


@query("delete_ids", "SELECT doc_id AS chunk_id, text AS content, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def delete_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.delete_ids(_store_rows(spark, sf_dir), read(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id")))


@query("delete_filter", "SELECT doc_id AS chunk_id, text AS content, source FROM documents WHERE source IS DISTINCT FROM 'src3'")
def delete_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.delete_where(_store_rows(spark, sf_dir), where("source", "equals", "src3"))


@query("point_lookup", "SELECT doc_id AS chunk_id, text AS content, source FROM documents WHERE doc_id = 42")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store_rows(spark, sf_dir).where("chunk_id = 42")


@query("chunks_of_document", "SELECT turn, role, text FROM conversations WHERE conv_id = 5 ORDER BY turn")
def chunks_of_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), "role", "text")
    return store.chunks_of(rows, 5).select(F.col("chunk_index").alias("turn"), "role", "text")


@query("distinct_documents", "SELECT DISTINCT conv_id AS document_id FROM conversations")
def distinct_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.documents_of(read(spark, sf_dir, "conversations").withColumn("document_id", F.col("conv_id")))


@query("pipeline_statistics", "SELECT count(DISTINCT conv_id) AS document_count, count(*) AS chunk_count FROM conversations")
def pipeline_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.statistics(read(spark, sf_dir, "conversations").withColumn("document_id", F.col("conv_id")))


@query("store_validation", "SELECT doc_id AS chunk_id, 'embedding' AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'chunk' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def store_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.orphans(_store_rows(spark, sf_dir), read(spark, sf_dir, "labels").withColumn("chunk_id", F.col("doc_id")))


# tenants


def _tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumn("tenant_id", F.col("source")).withColumn("original_document_id", F.col("doc_id").cast("string"))


@query("tenant_isolated_search", f"WITH {POSTINGS}, {bm25_sql('hits', ASKED, 5, chr(39).join(('source = ', 'src1', '')))} SELECT doc_id, round(score, 6) AS score FROM hits")
def tenant_isolated_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tenancy.of_tenant(_tenants(spark, sf_dir), "src1")
    return _index(spark, sf_dir).search(ASKED, 5, where=own).select("doc_id", rounded("score").alias("score"))


@query("tenant_counts", "SELECT source AS tenant_id, count(*) AS chunks FROM documents GROUP BY source")
def tenant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tenancy.counts(_tenants(spark, sf_dir))


@query("tenant_restore", "SELECT doc_id::VARCHAR AS chunk_id, doc_id::VARCHAR AS document_id FROM documents")
def tenant_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("document_id"))
    return tenancy.restore(tenancy.isolate(rows, "acme"), "acme")


# pages and embeddings of texts


@query("embed_distinct_texts", "SELECT count(*) AS documents, count(DISTINCT text) AS embedded FROM documents")
def embed_distinct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, new = embed_cached(documents(spark, sf_dir))
    return rows.agg(F.count("vector").alias("documents")).crossJoin(new.agg(F.count("vector").alias("embedded")))


@query("batch_numbers", "SELECT doc_id, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 7)::BIGINT AS batch FROM documents")
def batch_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.batches(documents(spark, sf_dir), 7, "doc_id", "source").select("doc_id", "batch")


@query("cache_hit_rate", "SELECT round((count(text) - count(DISTINCT text)) / count(text)::DOUBLE, 6) AS hit_rate FROM documents")
def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a cache of embeddings by text, over the documents in turn."""
    seen = documents(spark, sf_dir).agg(F.count("content").alias("n"), F.count_distinct("content").alias("misses"))
    return seen.select(rounded(M.hit_rate(F.col("n") - F.col("misses"), F.col("misses"))).alias("hit_rate"))


@query("flatten_metadata", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def flatten_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.element_at(M.flattened(F.col("props")), "k").alias("k"))


# the rest of the catalogue registers itself; Python workers may import any of these first, so they share only what stands above

from tessera.plans import chunk_queries, engine_queries, file_queries  # noqa: E402, F401
