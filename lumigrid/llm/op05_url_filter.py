"""URL filter: rules first, gradient-boosted trees for the rest, by DataFrame functions and Spark ML.

The labelled URLs are those that a rule judges: block is 1, allow 0. Trees learn from lexical features
of all of them: lengths, depth, digit ratio, character entropy, parameter counts, and statistics of the host's
suffix over the table (its share of URLs, their mean length, and the labels' smoothed mean). The labels' mean is taken out of fold:
``FOLDS`` folds by the hash of the host's last two names, and a URL's mean comes from the other folds, so that neither a URL's own label nor
those of its site reach its features. URLs that no rule fits get the trees' verdict. ``evaluate`` scores trees on a fold held out.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule; its
features are those of its text. Very long urls are taken whole. Repeated rows are judged alike. Without labels of both kinds the
method's verdict is that kind, or allow. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, stash, table

#: (verdict, host, start of the path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: At most about so many labelled URLs train the trees, chosen by hash of the URL.
TRAIN_ROWS = 200_000
TREES, DEPTH, PRIOR, FOLDS = 20, 4, 20, 5
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "host_digits", "digit_ratio", "mark_ratio", "entropy", "parameters",
    "query_length", "longest_label", "suffix_share", "suffix_length", "suffix_rate",
)
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        url.alias("url"),
        F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER).alias("host"),
        F.regexp_extract(url, _PARTS, 2).alias("path"),
    )


def ruled(rules=RULES) -> Column:
    """A struct (rule, verdict) of the longest rule that fits ``host`` and ``path``, or null."""
    out = None
    for verdict, host, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(start)
        made = F.struct(F.lit(host + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out


def _count(text: str, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def entropy(text: Column) -> Column:
    """Bits for each character."""
    def bits(t: Column) -> Column:
        each = F.transform(F.array_distinct(F.split(t, "")), lambda c: (F.length(t) - F.length(F.replace(t, c, F.lit("")))) / F.length(t))
        return F.aggregate(F.filter(each, lambda p: p > 0), F.lit(0.0), lambda s, p: s - p * F.log2(p))

    return F.when(F.length(text) == 0, 0.0).otherwise(F.get(F.transform(F.array(text), bits), F.lit(0)))


def featured(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path, label or null) with ``FEATURES``."""
    n = F.greatest(F.length("url"), F.lit(1)).cast("double")
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    u = urls.withColumns({
        "suffix": F.substring_index("host", ".", -1),
        "fold": F.pmod(F.xxhash64(F.substring_index("host", ".", -2)), F.lit(FOLDS)).cast("int"),
        "url_length": F.length("url").cast("double"),
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "depth": _count("path", "/").cast("double"),
        "labels": F.size(F.split("host", r"\.")).cast("double"),
        "host_digits": _count("host", "[0-9]").cast("double"),
        "digit_ratio": _count("url", "[0-9]") / n,
        "mark_ratio": _count("url", r"[^\p{L}\p{N}]") / n,
        "entropy": entropy(F.col("url")),
        "parameters": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
        "query_length": F.length(query).cast("double"),
        "longest_label": F.array_max(F.transform(F.split("host", r"\."), F.length)).cast("double"),
    })
    u = stash(u, "urls")
    total = u.agg(F.count("*").alias("n"), F.avg("label").alias("rate")).first()
    rate = 0.5 if total["rate"] is None else total["rate"]
    by = u.groupBy("suffix", "fold").agg(
        F.count("*").alias("held"), F.sum("url_length").alias("long"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("bad"), F.count("label").alias("known")
    )
    by = stash(by, "suffixes")  # a few rows for each suffix
    whole = by.groupBy("suffix").agg(*[F.sum(c).alias(f"all_{c}") for c in ("held", "long", "bad", "known")])
    by = by.join(whole, "suffix").select(
        "suffix", "fold", "held",
        (F.col("all_held") / F.lit(float(max(total["n"], 1)))).alias("suffix_share"),
        (F.col("all_long") / F.col("all_held")).alias("suffix_length"),
        ((F.col("all_bad") - F.col("bad") + PRIOR * rate) / (F.col("all_known") - F.col("known") + PRIOR)).alias("suffix_rate"),
    )
    return hot_join(u, stash(by, "suffixes"), ["suffix", "fold"], "held").drop("held")


def _labelled(pages: DataFrame, rules) -> DataFrame:
    u = parsed(pages).withColumn("r", ruled(rules))
    u = u.withColumn("label", F.when(F.col("r.verdict") == "block", 1.0).when(F.col("r.verdict") == "allow", 0.0))
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(stash(featured(u), "features"))


def _trees() -> GBTClassifier:
    return GBTClassifier(labelCol="label", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, seed=5, maxBins=64)


def evaluate(pages: DataFrame, rules=RULES) -> tuple[int, float | None]:
    """Labelled URLs that were held out, and the share of them that trees of the other folds judge as the rules do.

    Each fold, so each site, is held out once, if URLs of both labels are left to train on.
    """
    known = _labelled(pages, rules).where("label IS NOT NULL")
    n = right = 0
    for fold in range(FOLDS):
        train, test = known.where(F.col("fold") != fold), known.where(F.col("fold") == fold)
        if test.isEmpty() or train.select("label").distinct().count() < 2:
            continue
        a, b = _trees().fit(train).transform(test).agg(F.count("*"), F.sum((F.col("prediction") == F.col("label")).cast("long"))).first()
        n, right = n + a, right + b
    return n, right / n if n else None


def judge(pages: DataFrame, rules=RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score (of the trees, null where a rule judges)."""
    u = _labelled(pages, rules)
    kinds = {r["label"]: r["count"] for r in u.where("label IS NOT NULL").groupBy("label").count().collect()}
    rest, known = u.where("label IS NULL"), u.where("label IS NOT NULL")
    base = known.select("page_id", "host", "path", "r.rule", "r.verdict", F.lit(None).cast("double").alias("block_score"))
    if len(kinds) == 2:
        share = min(1.0, train_rows / sum(kinds.values()))
        train = known.where(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < int(share * 1_000_000))
        trees = _trees().fit(train)
        judged = trees.transform(rest).withColumn("block_score", F.element_at(_second(), 1))
        verdict = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    else:
        judged = rest.withColumn("block_score", F.lit(None).cast("double"))
        verdict = F.lit("block" if kinds.get(1.0) else "allow")
    return base.unionByName(judged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), verdict.alias("verdict"), "block_score"))


def _second() -> Column:
    from pyspark.ml.functions import vector_to_array

    return F.slice(vector_to_array(F.col("probability")), 2, 1)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
