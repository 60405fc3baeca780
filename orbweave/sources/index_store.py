"""Stored indexes: an ordered multimap and TF-IDF postings, as batches below a folder.

A batch is written under a name that readers skip and renamed when it is whole.  Batches
are numbered; what a later one says about a pair or document replaces what earlier ones
say.  ``rebuild`` merges all batches into one that is range-partitioned and sorted by key, so
that searches read the row groups of their keys only.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import text_index
from .files import children, remove, rename

_BATCH = re.compile(r"batch=(\d+)$")


class _Batches:
    """Numbered batch folders of one schema."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def numbers(self) -> list[int]:
        return sorted(int(m[1]) for name, _ in children(self.spark, self.path) if (m := _BATCH.match(name)))

    def read(self) -> DataFrame:
        """Rows with their batch number."""
        found = [f"{self.path}/batch={n}" for n in self.numbers()]
        schema = f"{self.schema}, batch long"
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def write(self, rows: DataFrame, *order: str, number: int | None = None) -> int:
        """One more batch, sorted by order; its number."""
        own = number if number is not None else max(self.numbers(), default=0) + 1
        pending = f"{self.path}/_new-{uuid.uuid4().hex}"
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(pending)
        if not rename(self.spark, pending, f"{self.path}/batch={own}"):
            raise OSError(f"could not commit a batch to {self.path}")
        return own

    def drop(self, numbers: list[int]) -> None:
        for n in numbers:
            remove(self.spark, f"{self.path}/batch={n}")

    def files(self) -> DataFrame:
        return self.read().groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"))


class OrderedIndex:
    """A multimap of string keys to value ids; inserting a pair twice keeps one."""

    def __init__(self, spark: SparkSession, path: str):
        self.batches = _Batches(spark, path, "key string, value_id long, live boolean")

    def insert(self, pairs: DataFrame) -> None:
        self.batches.write(pairs.select(F.col("key").cast("string"), F.col("value_id").cast("long"), F.lit(True).alias("live")).distinct(), "key", "value_id")

    def delete(self, pairs: DataFrame) -> None:
        """Marks pairs as gone; unknown ones change nothing."""
        self.batches.write(pairs.select(F.col("key").cast("string"), F.col("value_id").cast("long"), F.lit(False).alias("live")).distinct(), "key", "value_id")

    def _current(self, rows: DataFrame) -> DataFrame:
        if len(self.batches.numbers()) > 1:
            rows = rows.groupBy("key", "value_id").agg(F.max_by("live", "batch").alias("live"))
        return rows.filter("live").select("key", "value_id")

    def pairs(self) -> DataFrame:
        return self._current(self.batches.read())

    def lookup(self, key: str) -> DataFrame:
        """key and value_id of one key, in order."""
        return self._current(self.batches.read().filter(F.col("key") == key)).orderBy("value_id")

    def range_scan(self, start: str, end: str) -> DataFrame:
        """key and value_id from start to end, both included, in order."""
        return self._current(self.batches.read().filter(F.col("key").between(start, end))).orderBy("key", "value_id")

    def count(self) -> int:
        """The number of distinct keys."""
        return self.pairs().select("key").distinct().count()

    def fragmentation(self, target_rows: int) -> float:
        """1 - rows / (files x target_rows), 0 for an empty index."""
        files, rows = self.batches.files().agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        return max(0.0, 1 - rows / (files * target_rows)) if files else 0.0

    def rebuild(self) -> None:
        old = self.batches.numbers()
        if old:
            self.batches.write(self.pairs().withColumn("live", F.lit(True)), "key", "value_id")
            self.batches.drop(old)


class PostingsIndex:
    """Postings of documents; re-indexing a document replaces its postings (D18)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.postings = _Batches(spark, f"{path}/postings", "term string, doc_id long, freq long, tf double")
        self.docs = _Batches(spark, f"{path}/docs", "doc_id long, live boolean")

    def index(self, docs: DataFrame, version: str | None = None) -> None:
        """Adds a batch of (doc_id, text); of several rows of one id the last ``version`` counts."""
        rows = docs if version is None else text_index.latest_documents(docs, version)
        rows = rows.select(F.col("doc_id").cast("long"), "text")
        number = max([*self.docs.numbers(), *self.postings.numbers()], default=0) + 1
        self.postings.write(text_index.postings(rows), "term", "doc_id", number=number)
        # The document list makes the batch count; without it searches see nothing of it.
        self.docs.write(rows.select("doc_id", F.lit(True).alias("live")).distinct(), "doc_id", number=number)

    def delete(self, ids: DataFrame) -> None:
        self.docs.write(ids.select(F.col("doc_id").cast("long"), F.lit(False).alias("live")).distinct(), "doc_id", number=max([*self.docs.numbers(), *self.postings.numbers()], default=0) + 1)

    def _documents(self) -> DataFrame:
        return self.docs.read().groupBy("doc_id").agg(F.max("batch").alias("batch"), F.max_by("live", "batch").alias("live")).filter("live").select("doc_id", "batch")

    def current(self, terms: list[str] | None = None) -> DataFrame:
        """Postings of the last version of each document, of some terms or all."""
        # A batch of postings counts once its documents are listed.
        found = self.postings.read().filter(F.col("batch").isin(self.docs.numbers() or [0]))
        if terms is not None:
            found = found.filter(F.col("term").isin(terms or [""]))
        if len(self.docs.numbers()) > 1:
            found = found.join(self._documents(), ["doc_id", "batch"], "left_semi")
        return found.select("term", "doc_id", "freq", "tf")

    def count(self) -> int:
        """The number of documents."""
        return self._documents().count()

    def vocabulary_size(self) -> int:
        return text_index.distinct_terms(self.current()).first()[0]

    def search(self, query: str, k: int) -> DataFrame:
        """doc_id and score of the best k documents; only row groups with the query's terms are read."""
        return text_index.search(self.current(text_index.query_terms(self.spark, query)), self.count(), query, k)

    def rebuild(self) -> None:
        old_postings, old_docs = self.postings.numbers(), self.docs.numbers()
        if not old_docs:
            return
        number = max(old_postings + old_docs) + 1
        self.postings.write(self.current(), "term", "doc_id", number=number)
        self.docs.write(self._documents().select("doc_id", F.lit(True).alias("live")), "doc_id", number=number)
        self.docs.drop(old_docs)
        self.postings.drop(old_postings)


class IndexManager:
    """The stored indexes of an engine: ordered ones by name, and one of postings."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.postings = PostingsIndex(spark, f"{self.root}/text")

    def ordered(self, name: str) -> OrderedIndex:
        if not re.fullmatch(r"\w+", name):
            raise ValueError(f"not an index name: {name!r}")
        return OrderedIndex(self.spark, f"{self.root}/ordered/{name}")

    def names(self) -> list[str]:
        return sorted(name for name, _ in children(self.spark, f"{self.root}/ordered"))

    def fragmentation(self, target_rows: int) -> float:
        """The largest fragmentation of the ordered indexes."""
        return max((self.ordered(n).fragmentation(target_rows) for n in self.names()), default=0.0)

    def rebuild(self) -> None:
        for name in self.names():
            self.ordered(name).rebuild()
        self.postings.rebuild()
