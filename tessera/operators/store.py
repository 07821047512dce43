"""A store of chunks with vectors: upsert, deletion, lookups, statistics, and a Parquet-backed form."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.filters import Fields, Filter, compile_filter
from tessera.functions.vector import is_finite


class InvalidRows(ValueError):
    """Rows that may not be stored."""


class Conflict(RuntimeError):
    """Another writer came first."""


def check(rows: DataFrame, dimensions: int | None = None, vector: str = "vector", id_: str = "chunk_id") -> int | None:
    """Raises unless all vectors have one number of dimensions and are finite, and no id is null; returns that number."""
    size = F.size(vector)
    bad = F.col(vector).isNull() | ~F.coalesce(is_finite(F.col(vector)), F.lit(False))
    n, low, high, wrong, unnamed = rows.agg(F.count("*"), F.min(size), F.max(size), F.sum(bad.cast("int")), F.sum(F.col(id_).isNull().cast("int"))).first()
    if not n:
        return dimensions
    if wrong:
        raise InvalidRows(f"{wrong} vectors are missing or not finite")
    if unnamed:
        raise InvalidRows(f"{unnamed} rows without id")
    if low != high or dimensions not in (None, low):
        raise InvalidRows(f"vectors of {low} to {high} dimensions; {dimensions or low} are wanted")
    return low


def upsert(existing: DataFrame, new: DataFrame, id_: str = "chunk_id") -> DataFrame:
    """new in the place of rows with the same id. Of rows of new with the same id the last stays."""
    return existing.join(new.select(id_), id_, "left_anti").unionByName(last_of_each(new, id_))


def last_of_each(rows: DataFrame, id_: str = "chunk_id") -> DataFrame:
    """Of rows with the same id the last, in the order in which they are read."""
    numbered = rows.withColumn("_place", F.monotonically_increasing_id())
    return numbered.groupBy(id_).agg(F.max_by(F.struct(*rows.columns), "_place").alias("_row")).select("_row.*")


def delete_ids(existing: DataFrame, ids: DataFrame, id_: str = "chunk_id") -> DataFrame:
    return existing.join(ids.select(id_), id_, "left_anti")


def delete_where(existing: DataFrame, condition: Filter | Column, fields: Fields | None = None) -> DataFrame:
    """Without the rows that match; a condition that is null keeps the row."""
    column = condition if isinstance(condition, Column) else compile_filter(condition, fields)
    return existing.where(~F.coalesce(column, F.lit(False)))


def chunks_of(chunks: DataFrame, document_id: object) -> DataFrame:
    return chunks.where(F.col("document_id") == F.lit(document_id)).orderBy("chunk_index")


def documents_of(chunks: DataFrame) -> DataFrame:
    return chunks.select("document_id").distinct()


def statistics(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count_distinct("document_id").alias("document_count"), F.count("*").alias("chunk_count"))


def orphans(chunks: DataFrame, embeddings: DataFrame, id_: str = "chunk_id") -> DataFrame:
    """(id, missing) of chunks without embedding and embeddings without chunk."""
    one = chunks.select(id_).join(embeddings.select(id_), id_, "left_anti").withColumn("missing", F.lit("embedding"))
    return one.unionByName(embeddings.select(id_).join(chunks.select(id_), id_, "left_anti").withColumn("missing", F.lit("chunk")))


class ParquetStore:
    """Rows (chunk_id, ..., vector) in versions, folders beside each other, each named by a numbered file.

    A change writes a folder, then the file of the next number, which names it; a file is never replaced, so of two
    writers that start from one version the second fails. Readers take the highest number that is there: the old rows or
    the new, never a mix or none. The ``keep`` last versions stay, for readers that are still at them.
    """

    def __init__(self, spark: SparkSession, folder: str, dimensions: int | None = None, id_: str = "chunk_id", most: int | None = None, keep: int = 3):
        """most: rows that the store may hold, any number by default."""
        self.spark, self.folder, self.dimensions, self.id, self.most, self.keep = spark, folder.rstrip("/"), dimensions, id_, most, keep

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _versions(self) -> list[tuple[int, str]]:
        """(number, folder) of all versions, the current one first. A file still empty is no version yet."""
        fs, root = self._fs("")
        if not fs.exists(root):
            return []
        names = (x.getPath().getName() for x in fs.listStatus(root))
        out = []
        for number in sorted((int(n[2:]) for n in names if n.startswith("v-")), reverse=True):
            text = self.spark.read.text(str(self._fs(f"v-{number:012d}")[1].toString())).head()
            if text:
                out.append((number, text[0]))
        return out

    def read(self) -> DataFrame | None:
        versions = self._versions()
        return self.spark.read.parquet(f"{self.folder}/{versions[0][1]}") if versions else None

    def _write(self, rows: DataFrame) -> None:
        old, name = self._versions(), f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        fs, file = self._fs(f"v-{(old[0][0] if old else 0) + 1:012d}")
        try:
            out = fs.create(file, False)
        except Exception as e:
            fs.delete(self._fs(name)[1], True)
            raise Conflict(f"{self.folder} was changed by another writer") from e
        out.write(bytearray(name.encode()))
        out.close()
        for number, folder in old[max(0, self.keep - 1) :]:
            fs.delete(self._fs(f"v-{number:012d}")[1], False)
            fs.delete(self._fs(folder)[1], True)

    def vacuum(self) -> None:
        """Deletes what no version names: folders of writers that broke off."""
        fs, root = self._fs("")
        named = {folder for _, folder in self._versions()}
        for status in fs.listStatus(root) if fs.exists(root) else ():
            name = status.getPath().getName()
            if name.startswith("data-") and name not in named:
                fs.delete(status.getPath(), True)

    def add(self, rows: DataFrame) -> None:
        self.dimensions = check(rows, self.dimensions, id_=self.id)
        existing = self.read()
        wanted = last_of_each(rows, self.id) if existing is None else upsert(existing, rows, self.id)
        if self.most is not None and (n := wanted.count()) > self.most:
            raise InvalidRows(f"{n} rows are more than the {self.most} that the store may hold")
        self._write(wanted)

    def delete(self, ids: DataFrame) -> None:
        if (existing := self.read()) is not None:
            self._write(delete_ids(existing, ids, self.id))

    def delete_where(self, condition: Filter | Column, fields: Fields | None = None) -> None:
        if (existing := self.read()) is not None:
            self._write(delete_where(existing, condition, fields))

    def get(self, id_: object) -> DataFrame | None:
        existing = self.read()
        return None if existing is None else existing.where(F.col(self.id) == F.lit(id_))

    def contains(self, id_: object) -> bool:
        found = self.get(id_)
        return found is not None and not found.isEmpty()

    def count(self) -> int:
        existing = self.read()
        return 0 if existing is None else existing.count()

    def is_empty(self) -> bool:
        return self.count() == 0

    def clear(self) -> None:
        """No rows; the number of dimensions stays."""
        if (existing := self.read()) is not None:
            self._write(existing.limit(0))


def save_json(chunks: DataFrame, embeddings: DataFrame, folder: str) -> None:
    """Both tables as JSON lines."""
    chunks.write.mode("overwrite").json(f"{folder}/chunks")
    embeddings.write.mode("overwrite").json(f"{folder}/embeddings")


def load_json(spark: SparkSession, folder: str, chunk_schema: str, embedding_schema: str, id_: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """What save_json wrote; raises if a chunk lacks its embedding or the other way round."""
    chunks, embeddings = spark.read.schema(chunk_schema).json(f"{folder}/chunks"), spark.read.schema(embedding_schema).json(f"{folder}/embeddings")
    if bad := orphans(chunks, embeddings, id_).head(3):
        raise InvalidRows(f"rows without their counterpart, such as {[tuple(r) for r in bad]}")
    return chunks, embeddings


class Memory:
    """A namespace of a store, as an agent's memory: ids carry the namespace, and a search sees only its rows."""

    def __init__(self, store: ParquetStore, namespace: str, most: int = 100_000):
        self.store, self.namespace, self.most = store, namespace, most

    def _own(self) -> DataFrame | None:
        rows = self.store.read()
        return None if rows is None else rows.where(F.col("document_id") == self.namespace)

    def count(self) -> int:
        rows = self._own()
        return 0 if rows is None else rows.count()

    def add(self, rows: DataFrame) -> None:
        """rows: chunk_id, content, vector."""
        if self.count() + rows.count() > self.most:
            raise InvalidRows(f"a memory holds at most {self.most} rows")
        self.store.add(rows.withColumn("chunk_id", F.concat(F.lit(f"{self.namespace}_"), F.col("chunk_id").cast("string"))).withColumn("document_id", F.lit(self.namespace)))

    def search(self, query: list[float], limit: int = 5, min_score: float | None = None) -> DataFrame | None:
        from tessera.operators.retrieval import vector_topk

        if min_score is not None and not abs(min_score) < float("inf"):
            raise ValueError("min_score must be finite")
        rows = self._own()
        if rows is None:
            return None
        plain = rows.withColumn("chunk_id", F.expr(f"substring(chunk_id, {len(self.namespace) + 2})"))
        return vector_topk(plain, query, limit, threshold=min_score)

    def clear(self) -> None:
        self.store.delete_where(F.col("document_id") == self.namespace)


def make_store(spark: SparkSession, kind: str, folder: str, **parameters: object) -> ParquetStore | Memory:
    """A store by name: "parquet" in a folder, or "memory", a namespace of one."""
    if kind == "parquet":
        return ParquetStore(spark, folder, **parameters)  # type: ignore[arg-type]
    if kind == "memory":
        return Memory(ParquetStore(spark, folder), **parameters)  # type: ignore[arg-type]
    raise ValueError(f"unknown store {kind!r}; parquet and memory are known")
