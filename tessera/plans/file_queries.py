"""Queries of the loaders: files are written from whole tables into the shared folder, then loaded."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.queries import query, read
from tessera.session import shared_folder
from tessera.sources import loaders

COUNTRIES = "(SELECT n_nationkey AS k, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _write(spark: SparkSession, files: Iterable[tuple[str, bytes]]) -> str:
    """A folder of these files; there are as many as nations, at any size of the tables."""
    folder = _folder(spark)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for name, data in files:
        path = hadoop(f"{folder}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(data))
        out.close()
    return folder


def _countries(spark: SparkSession, sf_dir: str) -> list[tuple[int, str, str]]:
    nations, regions = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    rows = nations.join(regions, nations.n_regionkey == regions.r_regionkey).select("n_nationkey", "n_name", "r_name").orderBy("n_nationkey")
    return [tuple(r) for r in rows.collect()]  # 25 rows


@query("load_text", f"SELECT 'n' || k AS source, name || chr(10) || 'é ' || region AS content, 'text/plain' AS mime_type FROM {COUNTRIES}")
def load_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In UTF-8, UTF-8 with a mark, UTF-16 with a mark, and Latin-1, by turns."""
    kinds = ("utf-8", "utf-8-sig", "utf-16", "latin-1")
    folder = _write(spark, ((f"n{k}.txt", f"{name}\né {region}".encode(kinds[k % 4])) for k, name, region in _countries(spark, sf_dir)))
    return loaders.load_text(spark, folder).select("source", "content", "mime_type")


@query("load_markdown", f"SELECT 'n' || k AS source, name AS title, CASE WHEN k % 2 = 0 THEN region END AS author, '{{\"rank\":\"' || k || '\"}}' AS custom, '# ' || name || chr(10) || chr(10) || 'Of ' || region || '.' AS content FROM {COUNTRIES}")
def load_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    author = lambda k, region: f"author: {region}\n" if k % 2 == 0 else ""
    folder = _write(spark, ((f"n{k}.md", f"---\ntitle: {name}\nrank: {k}\n{author(k, region)}---\n\n# {name}\n\nOf {region}.\n".encode()) for k, name, region in _countries(spark, sf_dir)))
    return loaders.load_markdown(spark, folder).select("source", "title", "author", "custom", "content")


@query("load_html", f"SELECT 'n' || k AS source, name || ' & co' AS title, region AS author, name || ' lies in ' || region AS content FROM {COUNTRIES}")
def load_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = "<html><head><title>{0} &amp; co</title><meta name='author' content='{1}'><style>p {{}}</style></head><body><nav>menu</nav><p>{0} lies\n in <b>{1}</b></p><script>x()</script></body></html>"
    folder = _write(spark, ((f"n{k}.html", page.format(name, region).encode()) for k, name, region in _countries(spark, sf_dir)))
    return loaders.load_html(spark, folder).select("source", "title", "author", "content")


@query("load_html_selected", f"SELECT 'n' || k AS source, name || ' ' || region AS content FROM {COUNTRIES}")
def load_html_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = "<body><div class='main big'><p>{0}</p><p class='ad'>buy</p></div><div>other</div><p id='where'>{1}</p></body>"
    folder = _write(spark, ((f"n{k}.html", page.format(name, region).encode()) for k, name, region in _countries(spark, sf_dir)))
    return loaders.load_html(spark, folder, selectors=(".main", "p#where"), excluded=(".ad",)).select("source", "content")


def _object(k: int, name: str, region: str) -> dict:
    return {"title": name, "body": {"parts": [f"{name} is number {k}", "more"]}, "region": region, "size": k, "large": k > 12}


@query("load_json", f"SELECT 'n' || k AS source, name AS title, name || ' is number ' || k AS content, '{{\"large\":\"' || (k > 12) || '\",\"region\":\"' || region || '\",\"size\":\"' || k || '\"}}' AS custom FROM {COUNTRIES}")
def load_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _write(spark, ((f"n{k}.json", json.dumps(_object(k, name, region)).encode()) for k, name, region in _countries(spark, sf_dir)))
    return loaders.load_json(spark, folder, content="body.parts.0", metadata=("title", "region", "size", "large", "none.such")).select("source", "title", "content", "custom")


@query("load_json_array", f"SELECT '{{\"arrayIndex\":' || (row_number() OVER (ORDER BY k) - 1) || ',\"region\":\"' || region || '\"}}' AS custom, name || ' is number ' || k AS content, 'all' AS source FROM {COUNTRIES}")
def load_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _write(spark, [("all.json", json.dumps([_object(*row) for row in _countries(spark, sf_dir)]).encode())])
    return loaders.load_json_array(spark, folder, content="body.parts.0", metadata=("region",)).select("custom", "content", "source")


@query("load_csv", f"SELECT 'k,name' || chr(10) || string_agg(k || ',' || name, chr(10) ORDER BY k) AS content, 'text/csv' AS mime_type, region AS source FROM {COUNTRIES} GROUP BY region")
def load_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file as one document."""
    by_region: dict[str, list[str]] = {}
    for k, name, region in _countries(spark, sf_dir):
        by_region.setdefault(region, []).append(f"{k},{name}")
    folder = _write(spark, ((f"{region}.csv", "\n".join(["k,name", *lines]).encode()) for region, lines in by_region.items()))
    return loaders.load_csv(spark, folder).select("content", "mime_type", "source")


@query("load_csv_rows", "SELECT coalesce(text, '') AS content, '{\"lang\":\"' || coalesce(lang, '') || '\",\"source\":\"' || coalesce(source, '') || '\"}' AS custom, 'text/csv' AS mime_type FROM documents WHERE doc_id IS NOT NULL OR coalesce(lang, source, text) IS NOT NULL")
def load_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with their quotes, commas and line ends, through CSV files and back."""
    folder = _folder(spark)
    read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text").write.option("quoteAll", "true").option("escape", '"').csv(folder, header=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return loaders.load_csv_rows(spark, folder, content="text", metadata=("source", "lang")).select("content", "custom", "mime_type")


@query("load_csv_columns", "SELECT o_orderkey || ';' || o_orderstatus || ';' || coalesce(o_orderpriority, '') AS content FROM orders")
def load_csv_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a content column: all columns, joined again by the separator."""
    folder = _folder(spark)
    read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").write.csv(folder, header=True, sep=";")
    return loaders.load_csv_rows(spark, folder, separator=";").select("content")


@query("load_directory", f"SELECT CASE k % 3 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/markdown' ELSE 'application/json' END AS mime_type, 'n' || k AS source, name AS content FROM {COUNTRIES} WHERE k % 5 <> 4")
def load_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of mixed files at two depths: each by its loader, but for unknown, hidden and excluded ones."""
    files = []
    for k, name, _ in _countries(spark, sf_dir):
        at = f"drafts/n{k}" if k % 5 == 4 else f"deep/n{k}" if k % 2 else f"n{k}"
        files.append((f"{at}.{('txt', 'md', 'json')[k % 3]}", (name if k % 3 < 2 else json.dumps(name)).encode()))
        files += [(f"n{k}.zzz", b"unknown"), (f".n{k}.txt", b"hidden"), (f"n{k}-old.txt", b"excluded")]
    return loaders.directory(spark, _write(spark, files), excluded=("drafts", "*-old.txt")).select("mime_type", "source", "content")


@query("load_directory_kinds", f"SELECT 'n' || k AS source FROM {COUNTRIES} WHERE k % 3 = 1")
def load_directory_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of some extensions only, by a registry of one's own, in the top folder only."""
    registry = loaders.Registry()
    registry.register(loaders.Loader(loaders.text_rows, ("note", ".MEMO"), "text/x-note"))
    folder = _write(spark, ((f"n{k}.{('txt', 'memo', 'note')[k % 3]}", name.encode()) for k, name, _ in _countries(spark, sf_dir)))
    return loaders.directory(spark, folder, registry, extensions=("memo", "txt"), recursive=False).select("source")


@query("stream_directory", f"SELECT 'n' || k AS source, name AS content FROM {COUNTRIES}")
def stream_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as a stream, of which all that is there is written as chunks."""
    from tessera import streaming
    from tessera.operators import chunking

    folder = _write(spark, ((f"n{k}.txt", name.encode()) for k, name, _ in _countries(spark, sf_dir)))
    out = _folder(spark)
    chunker = lambda docs: chunking.fixed_size(docs.withColumn("doc_id", F.col("source")))
    streaming.ingest(streaming.directory_stream(spark, folder), chunker, f"{out}/rows", f"{out}/progress").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select(F.col("document_id").alias("source"), "content")


@query("ingest_rate_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def ingest_rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: rates in tumbling windows, by the plan that streams use as well."""
    from tessera import streaming

    return streaming.rates(read(spark, sf_dir, "events"), by=("event_type",)).withColumn("start", F.col("start").cast("timestamp_ntz"))
