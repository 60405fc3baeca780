"""Quality rules: a threshold table compiled into one projection.

Every measure is a built-in expression over the whole text, so a pass is one scan
without a shuffle or user function.  A null or empty text has no words and is not
kept.  A null id stays null; repeated rows are judged alike; other columns of the
input are not read, so their names cannot clash.  Repeated windows are found by the
64-bit hashes of their words: two different windows of one text of a million words share
one with a probability below 1e-7.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, prepare, table

#: The white space between words, and the frequent words by language.
SPACE = " \t\n\x0b\f\r"
STOP_WORDS = {
    "en": "a an and are as at be by for from in is it of on or that the this to was with",
    "de": "als auch auf das dem den der des die ein eine für im in ist mit nicht sich und von zu",
    "fr": "au avec dans de des du elle en est et il la le les par pas pour que qui sur un une",
    "es": "a al como con de del el en es la las lo los más no para por que se su un una y",
}

WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20

#: (measure, least, most); None leaves a side open.
THRESHOLDS: list[tuple[str, float | None, float | None]] = [
    ("mean_word_length", 2.0, 14.0),
    ("symbols_per_word", None, 0.10),
    ("marks_per_word", None, 0.10),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.40),
]


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t\n\x0B\f\r]+"))


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more, each word once."""
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        def twice(x: Column, k: Column) -> Column:
            before, after = F.get(s, k - 1)["h"], F.get(s, k + 1)["h"]
            return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

        return F.array_sort(F.transform(F.filter(s, twice), lambda x: x["i"]))

    first = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(
        let(ordered, starts),
        first,
        lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + WINDOW - F.greatest(acc["end"] - p, F.lit(0))).alias("n")),
        lambda acc: acc["n"],
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *carried: Column) -> DataFrame:
    """doc_id, the carried columns, the counts and the ratios of each text."""
    stop = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    has_word = rf"[^{SPACE}]"
    d = docs.select(*carried, F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    first = d.columns[:-1]
    d = d.select(
        *first,
        "text",
        _words(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(has_word)).alias("lines"),
    )
    d = d.select(
        *first,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[!?]", ""))).cast("long").alias("n_marks"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop_words"),
        F.when(
            F.size("words") > WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size("words") - WINDOW),
                lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(WINDOW)]),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("windows"),
    )
    d = d.withColumn(
        "n_repeat_words",
        F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0))
        .otherwise(_covered(F.col("windows")))
        .cast("long"),
    ).drop("windows")
    words = F.greatest(F.col("n_words"), F.lit(1))
    return d.withColumns(
        {
            "mean_word_length": F.col("word_chars") / words,
            "symbols_per_word": F.col("n_symbols") / words,
            "marks_per_word": F.col("n_marks") / words,
            # One more than there are, so that a text of a few words is not judged by their absence.
            "stop_word_ratio": (F.col("n_stop_words") + 1) / words,
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        }
    )


def verdict(thresholds=None) -> Column:
    """The threshold table as one boolean expression over measure()'s columns."""
    ok = F.lit(True)
    for name, least, most in THRESHOLDS if thresholds is None else thresholds:
        if least is not None:
            ok = ok & (F.col(name) >= F.lit(float(least)))
        if most is not None:
            ok = ok & (F.col(name) <= F.lit(float(most)))
    return ok


def judge(docs: DataFrame, thresholds=None, *carried: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """measure() with base_failed and kept.

    The rows come out of a generator, which no filter is pushed below: a filter there would
    evaluate the measures' arrays again for every element.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    d = measure(docs, id_col, text_col, *carried).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(thresholds))
    return d.select(F.inline(F.array(F.struct(*d.columns))))


def keep(docs: DataFrame, thresholds=None, **columns) -> DataFrame:
    """The rows that are kept, with all their own columns and no other."""
    return judge(docs, thresholds, F.struct("*").alias("row"), **columns).filter("kept").select("row.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines", "n_marks"
    )


def oracle() -> str:
    """The same rows in DuckDB SQL."""
    stop = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words.split()}))
    bounds = " and ".join(
        f"{name} {op} {float(x)}" for name, lo, hi in THRESHOLDS for op, x in ((">=", lo), ("<=", hi)) if x is not None
    )
    return f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from d),
g as (select doc_id, i, words[i:i+{WINDOW - 1}] as gram from (select doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) as i from w)),
r as (select doc_id, i from (select *, count(*) over (partition by doc_id, gram) as n from g) where n > 1),
c as (select doc_id, count(distinct i + k) as n from r, range({WINDOW}) t(k) group by doc_id),
m as (select w.doc_id, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  (length(text) - length(regexp_replace(text, '[!?]', '', 'g')))::bigint as n_marks, len(lines)::bigint as n_lines,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
  len(list_filter(words, lambda x: lower(x) in ({stop})))::bigint as n_stop_words from w left join c using (doc_id)),
q as (select *, word_chars / greatest(n_words, 1) as mean_word_length, n_symbols / greatest(n_words, 1) as symbols_per_word,
  n_marks / greatest(n_words, 1) as marks_per_word, (n_stop_words + 1) / greatest(n_words, 1) as stop_word_ratio,
  n_dup_lines / greatest(n_lines, 1) as dup_line_ratio, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {bounds} as kept,
  n_stop_words, n_lines, n_marks from q"""
