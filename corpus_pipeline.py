"""The corpus pipeline: quality rules, near-duplicates, repeated lines, personal data, packing.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it wrote, and
returns a DataFrame.  All but the last return the columns of the input documents; a stage
that changes a text also sets ``n_chars`` to its new length.  Rows whose id is null pass
through every stage; rows equal in id and text are one document, of which the row stays
whose other columns are the first as JSON.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import near_dup, packing, pii, quality, substring
from orbweave.llm.common import prepare, row_key, shared_dir, table
from orbweave.sources import files

TOKENIZER = "byte_bpe_50k.json"


def _put_back(found: DataFrame, columns: list[str]) -> DataFrame:
    """The input's columns out of ``row``, with the new text and its length."""
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("text").isNotNull(), F.length("text").cast("long"))}
    return found.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table keeps; the verdict is part of the same projection."""
    prepare(spark)
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    prepare(spark)
    found = near_dup.near_duplicates(docs).filter("kept").select(F.col("key").alias("_key")).distinct()
    rest = F.to_json(F.struct(*[c for c in docs.columns if c != "text"]))
    d = docs.select(F.unhex(row_key(F.col("doc_id").cast("long"), F.col("text"))).alias("_key"), F.struct(*docs.columns).alias("row"), rest.alias("rest"))
    return d.join(found, "_key", "left_semi").groupBy("_key").agg(F.min_by("row", "rest").alias("row")).select("row.*")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines and passages that an earlier document has."""
    prepare(spark)
    return _put_back(substring.remove_repeats(docs), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and terms that disclose it, replaced."""
    prepare(spark)
    return _put_back(pii.sanitise(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 tokens."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_lines", repeated_lines),
    ("personal_data", personal_data),
    ("packed", packed),
]

#: Near-duplicate components and token ids cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder, read again, and removed after the next one."""
    prepare(spark)
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            files.remove(spark, f"{folder}/{before}")
        before = name
    return docs
