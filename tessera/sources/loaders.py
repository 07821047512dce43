"""Loaders: files to rows of schema.DOCUMENT. Paths are read by Spark; content is parsed in Arrow batches or by Spark.

Loaders by extension are kept in a registry, so a folder of mixed files is one plan: a listing, each file's loader, and
a union. ``custom`` is a JSON object with sorted keys; use parse_json on it for a VARIANT.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.schema import DOCUMENT
from tessera.sources import parse

Rows = Iterator[dict[str, Any]]
Parser = Callable[[bytes], Rows]
NAMES = [c.split(" ")[0] for c in DOCUMENT.split(", ")]


def _row(content: str, found: dict[str, Any] | None = None, **more: Any) -> dict[str, Any]:
    found = (found or {}) | more
    custom = found.pop("custom", None) or {}
    return {"content": content, **found, "custom": json.dumps(custom, sort_keys=True, ensure_ascii=False, separators=(",", ":"))}


def text_rows(data: bytes) -> Rows:
    yield _row(parse.decode(data))


def markdown_rows(data: bytes, front_matter: bool = True) -> Rows:
    text = parse.decode(data)
    found, body = parse.front_matter(text) if front_matter else ({}, text)
    yield _row(body, title=found.pop("title", None), author=found.pop("author", None), custom=found)


def html_rows(data: bytes, selectors: tuple[str, ...] = (), excluded: tuple[str, ...] = parse.EXCLUDED) -> Rows:
    yield _row(*parse.page(data.decode("utf-8"), selectors, excluded))


def json_rows(data: bytes, content: str | None = None, metadata: tuple[str, ...] = ()) -> Rows:
    yield _row(*parse.json_document(json.loads(parse.decode(data)), content, metadata))


def json_array_rows(data: bytes, content: str | None = None, metadata: tuple[str, ...] = ()) -> Rows:
    """A document for each element, with its index."""
    items = json.loads(parse.decode(data))
    if not isinstance(items, list):
        raise ValueError("the file holds no JSON array")
    for i, item in enumerate(items):
        text, found = parse.json_document(item, content, metadata)
        found["custom"] = found["custom"] | {"arrayIndex": i}
        yield _row(text, found)


def no_pdf(data: bytes) -> Rows:
    raise ValueError("PDF files can't be read here: no library for them is installed")
    yield {}


@dataclass(frozen=True)
class Loader:
    parser: Parser
    extensions: tuple[str, ...]
    mime: str


DEFAULTS = (
    Loader(text_rows, ("txt", "text"), "text/plain"),
    Loader(markdown_rows, ("md", "markdown"), "text/markdown"),
    Loader(html_rows, ("html", "htm"), "text/html"),
    Loader(json_rows, ("json",), "application/json"),
    Loader(text_rows, ("csv", "tsv"), "text/csv"),
    Loader(no_pdf, ("pdf",), "application/pdf"),
)


@dataclass
class Registry:
    """Loaders by extension; the last one registered wins."""

    loaders: dict[str, Loader] = field(default_factory=dict)

    @staticmethod
    def default() -> Registry:
        out = Registry()
        for loader in DEFAULTS:
            out.register(loader)
        return out

    def register(self, loader: Loader) -> None:
        for e in loader.extensions:
            self.loaders[e.lower().lstrip(".")] = loader

    def can_load(self, path: str) -> bool:
        return self.for_path(path) is not None

    def for_path(self, path: str) -> Loader | None:
        name = path.rsplit("/", 1)[-1]
        return self.loaders.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None


def _stem(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] if "." in name[1:] else name


def _parsed(files: DataFrame, registry: Registry) -> DataFrame:
    """Documents of rows (path, modificationTime, content) of binary files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"created_at": pa.timestamp("us", "UTC")}
        for batch in batches:
            for path, when, data in zip(*(batch.column(c).to_pylist() for c in ("path", "modificationTime", "content")), strict=True):
                loader = registry.for_path(path)
                if loader is None:
                    continue
                try:
                    rows = list(loader.parser(data))
                except Exception as e:
                    raise ValueError(f"{path} can't be loaded: {e}") from e
                base = {"url": path, "mime_type": loader.mime, "created_at": when}
                rows = [base | {k: v for k, v in r.items() if v is not None} for r in rows]
                for i, r in enumerate(rows):
                    r.setdefault("source", _stem(path))
                    r["doc_id"] = path if len(rows) == 1 else f"{path}#{i}"
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in NAMES], names=NAMES)

    return files.select("path", "modificationTime", "content").mapInArrow(run, DOCUMENT)


def _wanted(path: Column, extensions: Sequence[str] | None, excluded: Sequence[str], root: str) -> Column:
    """Files by extension, none of whose components below root is hidden or matches an excluded pattern."""
    below = F.regexp_replace(path, "^[a-z]+:/*" + re.escape(root.split(":", 1)[-1].lstrip("/").rstrip("/")) + "/?", "")
    parts = F.split(below, "/")
    keep = ~F.exists(parts, lambda p: F.startswith(p, F.lit(".")))
    for pattern in excluded:
        like = "^" + ".*".join(map(re.escape, pattern.split("*"))) + "$"
        keep &= ~(F.element_at(parts, -1).rlike(like) | F.array_contains(parts, pattern))
    if extensions is not None:
        keep &= F.lower(F.regexp_extract(path, "\\.([^./]*)$", 1)).isin(*[e.lower().lstrip(".") for e in extensions])
    return keep


def directory(spark: SparkSession, path: str, registry: Registry | None = None, extensions: Sequence[str] | None = None, excluded: Sequence[str] = (), recursive: bool = True) -> DataFrame:
    """Documents of all files that the registry knows. The first file that can't be parsed fails the query."""
    registry = registry or Registry.default()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    known = list(registry.loaders) if extensions is None else [e for e in extensions if e.lower().lstrip(".") in registry.loaders]
    return _parsed(files.where(_wanted(F.col("path"), known, excluded, path)), registry)


def _single(parser: Parser, extensions: tuple[str, ...], mime: str) -> Callable[[SparkSession, str], DataFrame]:
    def load(spark: SparkSession, path: str, **options: Any) -> DataFrame:
        registry = Registry()
        registry.register(Loader(partial(parser, **options) if options else parser, extensions, mime))
        return _parsed(spark.read.format("binaryFile").load(path), registry)

    return load


load_text = _single(text_rows, ("txt", "text"), "text/plain")
load_markdown = _single(markdown_rows, ("md", "markdown"), "text/markdown")
load_html = _single(html_rows, ("html", "htm"), "text/html")
load_json = _single(json_rows, ("json",), "application/json")
load_json_array = _single(json_array_rows, ("json",), "application/json")
load_csv = _single(text_rows, ("csv", "tsv"), "text/csv")


def load_csv_rows(spark: SparkSession, path: str, content: str | None = None, metadata: Sequence[str] = (), header: bool = True, separator: str = ",") -> DataFrame:
    """A document for each row with any value: one column, or all joined again; listed metadata columns as strings."""
    rows = spark.read.csv(path, header=header, sep=separator, quote='"', escape='"', multiLine=True, enforceSchema=False)
    rows = rows.withColumn("_path", F.col("_metadata.file_path")).withColumn("_at", F.col("_metadata.file_modification_time"))
    names = [c for c in rows.columns if c not in ("_path", "_at")]
    if not header:
        rows = rows.select(*[F.col(f"`{c}`").alias(str(i)) for i, c in enumerate(names)], "_path", "_at")
        names = [str(i) for i in range(len(names))]
    if content is not None and content not in names:
        raise ValueError(f"no column {content!r}")
    cell = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    kept = rows.where(F.concat(*[cell(c) for c in names]) != "")
    text = cell(content) if content is not None else F.concat_ws(separator, *[cell(c) for c in names])
    custom = F.to_json(F.struct(*[cell(c).alias(c) for c in sorted(metadata) if c in names])) if any(c in names for c in metadata) else F.lit("{}")
    number = F.row_number().over(_file_order())
    none = F.lit(None).cast("string")
    out = kept.withColumn("_i", F.monotonically_increasing_id()).withColumn("_n", number - 1)
    return out.select(
        F.concat("_path", F.lit("#"), F.col("_n").cast("string")).alias("doc_id"),
        text.alias("content"),
        F.regexp_extract("_path", "([^/]+?)(\\.[^./]*)?$", 1).alias("source"),
        none.alias("title"),
        none.alias("author"),
        F.col("_path").alias("url"),
        F.lit("text/csv").alias("mime_type"),
        custom.alias("custom"),
        F.col("_at").cast("timestamp").alias("created_at"),
    )


def _file_order():
    from pyspark.sql import Window

    return Window.partitionBy("_path").orderBy("_i")


def html_table(pages: DataFrame, id_: str = "page_id", html: str = "html", selectors: tuple[str, ...] = (), excluded: tuple[str, ...] = parse.EXCLUDED, unclosed: bool = True) -> DataFrame:
    """(id, title, content) of pages that are already in a table."""
    kind = pages.schema[id_].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [parse.page(t or "", selectors, excluded, unclosed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m["title"] for _, m in got], pa.string()), pa.array([c for c, _ in got], pa.string())], names=[id_, "title", "content"])

    return pages.select(id_, html).mapInArrow(run, f"{id_} {kind}, title string, content string")


def document_schema(spark: SparkSession) -> StructType:
    return spark.createDataFrame([], DOCUMENT).schema
