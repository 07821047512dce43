"""Ingest and query end to end: load, chunk, embed, store; then search, fuse, build a context, answer."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.embed import Embedder, embed, hashing_embedder
from tessera.functions.filters import Filter
from tessera.functions.text import fill_template
from tessera.operators import context, fusion, retrieval
from tessera.operators.store import ParquetStore
from tessera.schema import QueryOptions, chunk_id

Generate = Callable[[str], str]
PROMPT = "Answer from these sources only.\n\n{context}\n\nQuestion: {query}\n"
REFINE = "Improve this answer if the source helps.\n\nAnswer: {existing_answer}\n\nSource: {context}\n\nQuestion: {query}\n"
MAX_QUESTION, MAX_LIMIT = 10_000, 1000


def extractive(prompt: str) -> str:
    """A stand-in for a language model: the first line of the first source."""
    lines = [line for line in prompt.split("\n") if line.strip()]
    return lines[2] if len(lines) > 2 else lines[-1] if lines else ""


def validated(template: str, *names: str) -> str:
    if missing := [n for n in names if "{" + n + "}" not in template]:
        raise ValueError(f"the template lacks {missing}")
    return template


def expand(query: str, generate: Generate) -> str:
    """The query with what generate adds; as it is if blank, or if nothing is added."""
    more = generate(query).strip() if query.strip() else ""
    return f"{query} {more}" if more else query


def rephrase(query: str, generate: Generate) -> str:
    return (generate(query).strip() if query.strip() else "") or query


def decompose(query: str, generate: Generate) -> str:
    """The query and its sub-questions, a line each."""
    if not query.strip():
        return query
    lines = [line.strip().lstrip("-*0123456789.").strip() for line in generate(query).split("\n")]
    return "\n".join([query, *filter(None, lines)])


def hypothetical(query: str, generate: Generate) -> str:
    """A made-up answer, to search with in place of the question."""
    return rephrase(query, generate)


def chain(*steps: Callable[[str], str]) -> Callable[[str], str]:
    def run(query: str) -> str:
        for step in steps:
            query = step(query)
        return query

    return run


@dataclass
class Answer:
    text: str
    sources: list[dict[str, Any]]
    metadata: dict[str, Any] = field(default_factory=dict)


class Pipeline:
    """documents -> chunks with vectors in a store; questions -> answers with sources."""

    def __init__(self, store: ParquetStore, chunker: Callable[[DataFrame], DataFrame], make: Callable[[], Embedder] = hashing_embedder, generate: Generate = extractive, transform: Callable[[str], str] = lambda q: q):
        self.store, self.chunker, self.make, self.generate, self.transform = store, chunker, make, generate, transform

    def ingest(self, documents: DataFrame, progress: Callable[[str], None] = lambda phase: None) -> None:
        """Adds the chunks of documents (schema.DOCUMENT); those of the same ids are replaced."""
        progress("chunking")
        chunks = self.chunker(documents)
        about = documents.select(F.col("doc_id").alias("document_id"), "source")
        rows = chunks.join(about, "document_id").withColumn("chunk_id", chunk_id(F.col("document_id"), F.col("chunk_index")))
        progress("embedding")
        rows = embed(rows, make=self.make)
        progress("storing")
        self.store.add(rows)
        progress("complete")

    def _rows(self) -> DataFrame:
        rows = self.store.read()
        if rows is None:
            raise LookupError("the store is empty")
        return rows

    def retrieve(self, query: str, limit: int = 5, where: Filter | None = None, mode: str = "vector", threshold: float | None = None) -> DataFrame:
        """Chunks with score. mode: vector, keyword, or one of the fusion methods over twice the limit of both."""
        rows, q = self._rows(), self.make()([query])[0].tolist()
        if mode == "vector":
            return retrieval.vector_topk(rows, q, limit, where=where, threshold=threshold)
        allowed = None if where is None else rows.where(retrieval.compile_filter(where)).select("chunk_id")
        keyword = retrieval.BM25.build(rows).search(query, limit if mode == "keyword" else 2 * limit, where=allowed)
        found = keyword if mode == "keyword" else fusion.hybrid(retrieval.vector_topk(rows, q, 2 * limit, where=where).select("chunk_id", "score"), keyword, limit, mode)
        return rows.join(F.broadcast(found), "chunk_id").orderBy(F.desc("score"), "chunk_id")  # at most limit rows

    def events(self, question: str, options: QueryOptions = QueryOptions(), synthesis: str = "compact", mode: str = "vector") -> Iterator[tuple[str, Any]]:
        """The steps of a query as they happen, the last with the answer."""
        if not question.strip() or len(question) > MAX_QUESTION:
            raise ValueError("the question is blank or too long")
        if not 1 <= options.retrieval_limit <= MAX_LIMIT:
            raise ValueError(f"retrieval_limit must be 1 to {MAX_LIMIT}")
        yield "retrieval_started", None
        found = self.retrieve(self.transform(question), options.retrieval_limit, options.filter, mode)  # type: ignore[arg-type]
        results = [r.asDict() for r in found.drop("vector").collect()]  # a list of at most MAX_LIMIT
        yield "retrieval_complete", results
        if not results:
            yield "complete", Answer(context.EMPTY, [], {"chunks_retrieved": 0})
            return
        yield "generation_started", None
        text = self._synthesize(question, results, options, synthesis)
        yield "generation_chunk", text
        yield "generation_complete", text
        yield "complete", Answer(text, results, {"chunks_retrieved": len(results), "synthesis": synthesis})

    def query(self, question: str, options: QueryOptions = QueryOptions(), synthesis: str = "compact", mode: str = "vector") -> Answer:
        return list(self.events(question, options, synthesis, mode))[-1][1]

    def _synthesize(self, question: str, results: list[dict[str, Any]], options: QueryOptions, synthesis: str) -> str:
        fill = lambda template, **v: _filled(template, query=question, **v)
        texts = [r["content"] for r in results]
        if synthesis == "refine":
            return context.refine(texts, lambda t: self.generate(fill(PROMPT, context=t)), lambda a, t: self.generate(fill(REFINE, existing_answer=a, context=t)))
        if synthesis == "tree":
            return context.tree_reduce(texts, lambda group: self.generate(fill(PROMPT, context="\n\n".join(f"[Source {i}]: {t}" for i, t in enumerate(group, 1)))))
        if synthesis != "compact":
            raise ValueError(f"unknown synthesis {synthesis!r}")
        spark = self.store.spark
        rows = spark.createDataFrame([(r["chunk_id"], r["document_id"], r["content"], r.get("source"), float(r["score"])) for r in results], "chunk_id string, document_id string, content string, source string, score double")
        built = context.build(rows, options.max_context_tokens, metadata=options.include_metadata).first()[0]
        return self.generate(fill(PROMPT, context=built))

    def statistics(self) -> DataFrame:
        from tessera.operators.store import statistics

        return statistics(self._rows())


def _filled(template: str, **values: str) -> str:
    for k, v in values.items():
        template = template.replace("{" + k + "}", v)
    return template


def search_tool(pipeline: Pipeline, query: str, limit: int = 5, min_score: float | None = None) -> list[dict[str, Any]]:
    """Rows of a search, those below min_score (kept within 0 to 1) left out after the limit."""
    threshold = None if min_score is None else min(max(min_score, 0.0), 1.0)
    found = pipeline.retrieve(query, limit)
    return [r.asDict() for r in (found if threshold is None else found.where(F.col("score") >= threshold)).drop("vector").collect()]


def query_tool(pipeline: Pipeline, question: str, limit: int = 5) -> dict[str, Any]:
    answer = pipeline.query(question, QueryOptions(retrieval_limit=limit))
    mean = sum(s["score"] for s in answer.sources) / len(answer.sources) if answer.sources else 0.0
    label = "high" if mean > 0.8 else "medium" if mean > 0.5 else "low"
    cut = lambda t: t[:500] + "..." if len(t) > 500 else t
    return {"answer": answer.text, "confidence": label, "sources": [{"content": cut(s["content"]), "score": s["score"]} for s in answer.sources]}


def summarize_tool(pipeline: Pipeline, topic: str, limit: int = 10) -> str:
    return pipeline.query(topic, QueryOptions(retrieval_limit=limit), synthesis="tree").text


def ingest_tool(pipeline: Pipeline, texts: Sequence[str], source: str = "direct") -> int:
    spark = pipeline.store.spark
    rows = spark.createDataFrame([(f"{source}#{i}", t, source) for i, t in enumerate(texts)], "doc_id string, content string, source string")
    pipeline.ingest(rows)
    return len(texts)


def multi_index_tool(pipelines: dict[str, Pipeline], query: str, names: Sequence[str] | None = None, limit: int = 3) -> dict[str, list[dict[str, Any]] | str]:
    """Results of each index; an index that fails gives its error."""
    out: dict[str, list[dict[str, Any]] | str] = {}
    for name in pipelines if names is None else [n for n in names if n in pipelines]:
        try:
            out[name] = search_tool(pipelines[name], query, limit)
        except Exception as e:  # noqa: BLE001 - an index's failure is a result
            out[name] = f"error: {e}"
    return out


__all__ = ["Answer", "Pipeline", "chain", "decompose", "expand", "fill_template", "hypothetical", "ingest_tool", "multi_index_tool", "query_tool", "rephrase", "search_tool", "summarize_tool", "validated"]
