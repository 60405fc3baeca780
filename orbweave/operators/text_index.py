"""TF-IDF postings and search, and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import numbered


def latest_documents(docs: DataFrame, version: str) -> DataFrame:
    """Each document's row of the largest version (D18); rows of one id and version are ordered by their text."""
    row = F.struct(*[F.col(c) for c in docs.columns])
    last = docs.groupBy("doc_id").agg(F.max_by(row, F.struct(version, "text")).alias("r"))
    return last.select("r.*")


def _counted(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of its terms and the largest of them; a document is one row, so nothing is shuffled."""
    d = docs.select("doc_id", T.counted(T.index_terms(F.col("text"))).alias("terms"))
    # Before terms are spread over rows, or each row would look for the largest again.
    return d.select("doc_id", "terms", F.array_max(F.transform("terms", lambda t: t["n"])).alias("most"))


def term_counts(docs: DataFrame) -> DataFrame:
    """doc_id, term and freq of documents with one row each; ``latest_documents`` reduces several versions."""
    return _counted(docs).select("doc_id", F.inline("terms")).select("doc_id", F.col("value").alias("term"), F.col("n").alias("freq"))


def postings(docs: DataFrame, version: str | None = None) -> DataFrame:
    """term, doc_id, freq and tf = freq / largest freq of the document.

    With a ``version`` column only the last version of each document counts (D18).
    """
    d = _counted(docs if version is None else latest_documents(docs, version)).select("doc_id", "most", F.inline("terms"))
    return d.select(F.col("value").alias("term"), "doc_id", F.col("n").alias("freq"), (F.col("n") / F.col("most")).alias("tf"))


def postings_of(docs: DataFrame, terms: list[str]) -> DataFrame:
    """postings() of some terms, for a search without an index: other terms are counted inside the row only."""
    d = _counted(docs).select("doc_id", "most", F.filter("terms", lambda t: t["value"].isin(terms or [""])).alias("terms"))
    d = d.select("doc_id", "most", F.inline("terms"))
    return d.select(F.col("value").alias("term"), "doc_id", F.col("n").alias("freq"), (F.col("n") / F.col("most")).alias("tf"))


def distinct_terms(posting: DataFrame) -> DataFrame:
    """The number of distinct terms as ``terms``, one row."""
    return posting.groupBy("term").agg(F.lit(1).alias("one")).agg(F.count("*").alias("terms"))


def idf(posting: DataFrame, total: int) -> DataFrame:
    """term, df and idf = ln(N / (df + 1)) + 1."""
    return posting.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log(F.lit(float(total)) / (F.col("df") + 1)) + 1)


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """The index tokenizer on a constant; repeated terms stay (they multiply)."""
    return list(spark.range(1).select(T.index_terms(F.lit(query))).first()[0])


def search(posting: DataFrame, total: int, query: str, k: int) -> DataFrame:
    """doc_id and score of the best k documents; any term matches, ties by id (D19)."""
    terms = query_terms(posting.sparkSession, query)
    found = posting.filter(F.col("term").isin(terms or [""]))
    times = F.create_map(*[F.lit(x) for t in dict.fromkeys(terms) for x in (t, terms.count(t))]) if terms else None
    df = idf(found, total)
    weight = times[F.col("term")] if terms else F.lit(0)
    scored = found.join(F.broadcast(df), "term").groupBy("doc_id").agg(F.round(F.sum(F.col("tf") * F.col("idf") * weight), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(k)


def document_vocabulary(docs: DataFrame) -> DataFrame:
    """doc_id, token and token_id: first-seen order within each document, from 1 (D20)."""
    words = F.array_distinct(T.embedding_tokens(F.col("text")))
    return docs.select("doc_id", F.posexplode(words).alias("pos", "token")).select("doc_id", "token", (F.col("pos") + 1).cast("long").alias("token_id"))


def corpus_vocabulary(docs: DataFrame) -> DataFrame:
    """token and token_id over the whole corpus in order of the first (doc_id, position).

    Ids are ranks over ranges of (doc_id, position), so the documents that bring most new
    tokens are split like any others.
    """
    words = docs.select("doc_id", F.posexplode(F.array_distinct(T.embedding_tokens(F.col("text")))).alias("pos", "token"))
    first = words.groupBy("token").agg(F.min(F.struct("doc_id", "pos")).alias("at")).select("token", "at.doc_id", "at.pos")
    return numbered(first, "doc_id", "pos", "token", name="token_id").select("token", "token_id")
