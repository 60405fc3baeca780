"""URL filters: host and path rules, then boosted trees on lexical features.

The longest rule that fits a URL decides.  Any other URL is judged by gradient-boosted
trees trained on the labelled URLs, which are those that a rule decides: their features
are lengths, depth, digit ratio, entropy, parameter counts and how often URLs of the same
suffix are blocked.  The fitted trees are compiled into one built-in expression, so the
scoring pass is a projection.

Suffix statistics are counted over all labelled URLs and joined to the rows; a training
row takes those of the other ``FOLDS`` - 1 folds of URLs, so that no label is a feature of
its own row.  Training takes at most ``TRAIN_ROWS`` labelled URLs, chosen by the order of a
hash of id and URL; every URL is scored.
A null URL or one without ``://`` has an empty host and path, fits no rule and is scored
like any other.  If the labelled URLs are all alike, or there are none, the trees are
replaced by that verdict, or ``allow``.  Ids may be null or repeated.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, prepare, table

#: The rules of the contract as (verdict, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
TRAIN_ROWS = 20_000
FOLDS = 5
#: Weight of the overall share in the share of a suffix, in URLs.
PRIOR_URLS = 5
#: Suffixes whose statistics may be broadcast; more are joined by a shuffle.
BROADCAST_SUFFIXES = 50_000
TREES, DEPTH = 12, 4
FEATURES = ["url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "hyphens", "entropy", "parameters", "has_fragment", "suffix_blocked"]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def by_rules(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict, null where none fits.

    Length is that of host and path together; of two as long, the longer host wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(RULES if rules is None else rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _entropy(url: Column) -> Column:
    """Bits a character over letters, digits and the marks that URLs use."""
    n = F.greatest(F.length(url), F.lit(1))
    total = F.lit(0.0)
    for c in "abcdefghijklmnopqrstuvwxyz0123456789-./_?=&#%":
        p = F.length(url) - F.length(F.replace(url, F.lit(c), F.lit("")))
        total = total + F.when(p > 0, -(p / n) * F.log2(p / n)).otherwise(0.0)
    return total


def lexical(pages: DataFrame) -> DataFrame:
    """Adds the features that need one URL only, and its suffix."""
    url = F.coalesce(F.col("url"), F.lit(""))
    low = F.lower(url)
    count = lambda c, pattern: F.length(c) - F.length(F.regexp_replace(c, pattern, ""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return pages.select(
        "*",
        F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("suffix"),
        F.length(url).cast("double").alias("url_length"),
        F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        count(F.col("host"), r"\.").cast("double").alias("host_depth"),
        count(F.col("path"), "/").cast("double").alias("path_depth"),
        (count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1))).alias("digit_ratio"),
        count(url, "-").cast("double").alias("hyphens"),
        F.round(_entropy(low), 6).alias("entropy"),
        F.when(query == "", 0.0).otherwise(count(query, "&") + 1.0).alias("parameters"),
        F.when(url.contains("#"), 1.0).otherwise(0.0).alias("has_fragment"),
    )


def _share(blocked: Column, n: Column, prior: float) -> Column:
    return F.round((blocked + PRIOR_URLS * prior) / (n + PRIOR_URLS), 6)


def _fold() -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(FOLDS))


def _tree(node) -> Column:
    """A fitted tree as nested conditions; the trees only split on thresholds."""
    if node.numDescendants() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    left = F.col(FEATURES[split.featureIndex()]) <= F.lit(float(split.threshold()))
    return F.when(left, _tree(node.leftChild())).otherwise(_tree(node.rightChild()))


def fit(labelled: DataFrame, seed: int = 7):
    """(share of blocked URLs by suffix, prior, margin expression or None, fitted model or None) from rows of lexical() with a verdict."""
    rows = labelled.withColumn("label", F.when(F.col("verdict") == "block", 1.0).otherwise(0.0)).withColumn("fold", _fold())
    counts = rows.groupBy("suffix", "fold").agg(F.count("*").alias("n"), F.sum("label").alias("b"))
    counts = cut(counts)
    n, blocked = counts.agg(F.sum("n"), F.sum("b")).first()
    if not n or blocked in (0, n):
        return None, float(bool(n and blocked)), None, None
    prior = blocked / n
    both = counts.groupBy("suffix").agg(F.sum("n").alias("all"), F.sum("b").alias("all_b"))
    share = both.select("suffix", _share(F.col("all_b"), F.col("all"), prior).alias("suffix_blocked"))
    others = counts.join(both, "suffix").select("suffix", "fold", _share(F.col("all_b") - F.col("b"), F.col("all") - F.col("n"), prior).alias("suffix_blocked"))
    order = F.xxhash64("page_id", "url")
    sample = rows.withColumn("order", order).orderBy("order", "page_id", "url").limit(TRAIN_ROWS).join(others, ["suffix", "fold"])
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample).select("features", "label").cache()
    try:
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=seed, stepSize=0.3, maxBins=32).fit(vectors)
    finally:
        vectors.unpersist()
    margin = F.lit(0.0)
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        margin = margin + F.lit(float(weight)) * _tree(tree._call_java("rootNode"))
    return share, prior, margin, model


def with_share(urls: DataFrame, share: DataFrame, prior: float) -> DataFrame:
    """Rows of lexical() with the share of their suffix, or the prior."""
    share = cut(share)
    share = F.broadcast(share) if share.count() <= BROADCAST_SUFFIXES else share.hint("merge")
    return urls.join(share, "suffix", "left").withColumn("suffix_blocked", F.coalesce("suffix_blocked", F.lit(prior)))


def filter_urls(pages: DataFrame, rules=None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and block_score (0 to 1) of each row."""
    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = parts(F.col("url"))
    d = d.withColumns({"host": host, "path": path})
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    d = d.withColumns({"rule": rule, "verdict": verdict})
    share, prior, margin, _ = fit(lexical(d.filter("verdict is not null and url is not null")))
    if margin is None:
        score = F.lit(prior)
    else:
        d = with_share(lexical(d), share, prior)
        score = 1 / (1 + F.exp(-2 * margin))
    return d.select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.when(score > 0.5, "block").otherwise("allow")).alias("verdict"), F.round(score, 6).alias("block_score")
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return filter_urls(table(spark, sf_dir, "pages"))
