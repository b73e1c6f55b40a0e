"""SpotSigs document fingerprints, by DataFrame functions only.

A text is cut into words (runs of letters, digits and marks, lower-cased). At each common word
(``ANCHORS``) starts a chain of the next ``CHAIN`` words that are not common; anchor and chain make
one signature. The beginning of a text is an anchor too, and a chain that meets the end of the
text is kept if it has any word, so that each text with a content word has a signature. The
fingerprint is the set of signatures; ``fingerprint`` is its digest. Likeness is the Jaccard
similarity of two sets; ``pairs`` partitions sets by their length and compares only sets whose
lengths allow the threshold and which share one of their rarest signatures.

Defined results: null and empty texts, and texts without content words, have the empty set; two empty
sets have likeness 1, an empty and another 0. Documents are followed by the next in ascending
(doc_id, text), nulls first, the last by the first; a single document follows itself. Repeated rows are taken
one by one. Very long texts are taken whole. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import places, range_count, table

#: Common words of four languages, in natural order. Fixed values.
ANCHORS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "not", "of", "on", "or", "that", "the",
    "this", "to", "was", "with", "auf", "das", "den", "der", "des", "die", "ein", "eine", "für", "im", "ist", "mit", "nicht", "sich",
    "und", "von", "zu", "au", "dans", "de", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur",
    "un", "une", "con", "del", "el", "es", "las", "los", "no", "para", "por", "se", "su", "y",
)
CHAIN = 2
#: Steps of the doc_ids' distribution that the driver gets.
QUANTILES = 1000


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The sorted distinct signatures of a text, as an array of string."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    common = lambda w: w.isin(*ANCHORS)

    def chains(all_words: Column) -> Column:
        def anchored(content: Column) -> Column:
            spots = F.filter(F.transform(all_words, lambda w, i: F.when(common(w), F.struct(w.alias("w"), i.alias("i")))), lambda s: s.isNotNull())
            # Before the k-th common word, at position i, stand i - k content words.
            made = F.transform(
                spots, lambda s, k: F.when(s["i"] - k < F.size(content), F.concat_ws(" ", s["w"], *[F.get(content, s["i"] - k + c) for c in range(chain)]))
            )
            first = F.when(F.size(content) > 0, F.concat_ws(" ", F.lit("^"), *[F.get(content, F.lit(c)) for c in range(chain)]))
            return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(first), made))))

        # A transform of one element binds a value to a name, so that it is computed once.
        return F.get(F.transform(F.array(F.filter(all_words, lambda w: ~common(w))), anchored), F.lit(0))

    return F.get(F.transform(F.array(words), chains), F.lit(0))


def digest(signature_set: Column) -> Column:
    return F.sha2(F.array_join(signature_set, ","), 256)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets (arrays of distinct elements)."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def _numbers(values: list[int]) -> Column:
    """A constant array; one literal in the plan, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _below(edges: list[int], x: Column) -> Column:
    """How many of the sorted edges are less than ``x``, by bisection; 0 for null."""
    if not edges:
        return F.lit(0)
    table = _numbers(edges)
    steps = F.array(*[F.lit(1 << k) for k in range(len(edges).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= len(edges)) & (F.get(table, low + step - 1) < x), low + step).otherwise(low))


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, text and next_text, through ranges of doc_id that are about equal in count; their number grows with the bytes of the texts.

    A range's rows are ordered in one task of its own; the first row of the next range comes along as a copy. The driver
    gets quantiles and the first doc_id of each range.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    share = F.array(*[F.lit(k / QUANTILES) for k in range(QUANTILES + 1)])
    found, total = d.agg(F.percentile_approx("doc_id", share, F.lit(20 * QUANTILES)), F.sum(F.octet_length("text").cast("long"))).first()
    ranges = ranges or range_count(spark, total)
    # Range r holds the doc_ids above edges[r - 1] up to edges[r]; nulls are in range 0.
    at = [k * QUANTILES / ranges for k in range(1, ranges)] if found else []
    edges = sorted({int(found[int(p)] + (found[min(int(p) + 1, QUANTILES)] - found[int(p)]) * (p - int(p))) for p in at})
    d = d.withColumn("range", _below(edges, F.col("doc_id")))
    heads = dict(sorted((r["range"], r["head"]["doc_id"]) for r in d.groupBy("range").agg(F.min(F.struct("doc_id")).alias("head")).collect()))
    if not heads:
        return d.select("doc_id", "text", F.lit("").alias("next_text"))
    # The head of each range also closes the range before; the first head closes the last range.
    full = list(heads)
    before = {r: full[k - 1] for k, r in enumerate(full)}
    n = len(edges) + 1
    # What is no head's number, in an empty range or that of null heads, is the number of another range.
    first = [heads.get(r) if heads.get(r) is not None else (edges[0] + 1 if r == 0 and edges else edges[0] if edges else 0) for r in range(n)]
    null_head = full[0] == 0 and heads[0] is None
    own = F.lit(False) if n == 1 and null_head else F.col("doc_id") == F.get(_numbers(first), F.col("range"))
    is_head = (own | F.col("doc_id").isNull()) if null_head else own
    after = F.when(is_head, F.get(_numbers([before.get(r, r) for r in range(n)]), F.col("range")).cast("int"))
    rows = F.array_compact(F.array(F.struct(F.col("range").alias("r"), F.lit(0).alias("copy")), F.when(after.isNotNull(), F.struct(after.alias("r"), F.lit(1).alias("copy")))))
    dealt = d.select("doc_id", "text", F.explode(rows).alias("p")).select("doc_id", "text", F.col("p.r").alias("r"), F.col("p.copy").alias("copy"))
    dealt = dealt.withColumn("place", F.get(_numbers(places(spark, n)), F.col("r")).cast("int")).repartition(n, "place")
    order = Window.partitionBy("place", "r").orderBy("copy", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)).where("copy = 0").select("doc_id", "text", "next_text")


def compared(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each document with its edited text, the fingerprints of both, and two likenesses."""
    d = with_next(docs, ranges)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    d = d.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.concat(F.expr("substring(text, 1, char_length(text) - int(floor(char_length(text) / 2)))"), F.expr("substring(next_text, 1, int(floor(char_length(text) / 2)))")).alias("edited"),
        "text",
        "next_text",
    )
    d = d.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.transform(F.array("text", "edited", "next_text"), lambda t: signatures(t)).alias("s"),
    )
    return d.select("doc_id", "n_chars", "edited_sha256", F.col("s")[0].alias("own"), F.col("s")[1].alias("edited"), F.col("s")[2].alias("next"))


def pairs(docs: DataFrame, threshold: float = 0.8, base: float | None = None) -> DataFrame:
    """Pairs of fingerprint classes with likeness of at least ``threshold``: a, b (smallest doc_ids), likeness.

    Equal sets are one class. Lengths fall into partitions whose ends grow by 1 / threshold, so a set meets those
    of its own partition and the one above. Within a partition, sets are joined on the signatures of their
    prefix: ordered by frequency, the rarest, as many as a pair at the threshold must share one of.
    """
    import math

    sets = docs.select(F.col("doc_id").cast("long").alias("doc_id"), signatures(F.col("text")).alias("s")).where("size(s) > 0 AND doc_id IS NOT NULL")
    classes = sets.groupBy("s").agg(F.min("doc_id").alias("id"))
    step = math.log(base or 1 / threshold)
    # A hair lower in the bounds, as 100 * 0.55 is a little more than 55; the last test is exact.
    bound = threshold - 1e-9
    classes = classes.withColumns({"n": F.size("s"), "part": F.floor(F.log(F.size("s").cast("double")) / step).cast("int")})
    tokens = classes.select("id", "n", "part", F.explode("s").alias("t"))
    count = tokens.groupBy("t").agg(F.count("*").alias("df"))
    ranked = tokens.join(count, "t").groupBy("id", "n", "part").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("o"))
    prefix = F.slice("o", 1, F.col("n") - F.ceil(F.col("n") * bound).cast("int") + 1)
    rare = ranked.select("id", "n", "part", F.explode(prefix).alias("x")).select("id", "n", "part", F.col("x.t").alias("t"))
    up = rare.select(F.col("id").alias("b"), F.col("n").alias("m"), F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"), "t")
    found = rare.select(F.col("id").alias("a"), "n", "part", "t").join(up, ["part", "t"])
    found = found.where((F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") < F.col("b"))))
    found = found.where(F.col("n") >= F.col("m") * bound).select("a", "b").distinct()
    left, right = classes.select(F.col("id").alias("a"), F.col("s").alias("sa")), classes.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    out = found.join(left, "a").join(right, "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness"))
    return out.where(F.col("likeness") >= threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        digest(F.col("own")).alias("fingerprint"),
        digest(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


_COMMON = "(" + ", ".join(f"'{w}'" for w in ANCHORS) + ")"
OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, length(text) // 2 AS half, coalesce(lead(text) OVER (ORDER BY doc_id, text), first_value(text) OVER (ORDER BY doc_id, text)) AS next FROM d),
e AS (SELECT *, substr(text, 1, length(text) - half) || substr(next, 1, half) AS edited FROM n),
t AS (SELECT doc_id, k, lower([text, edited, next][k]) AS t FROM e, range(1, 4) q(k)),
w AS (SELECT doc_id, k, list_filter(regexp_split_to_array(t, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM t),
c AS (SELECT *, list_filter(w, lambda x: x NOT IN {_COMMON}) AS c, list_filter(range(1, len(w) + 1), lambda i: w[i] IN {_COMMON}) AS s FROM w),
m AS (SELECT doc_id, k, list_sort(list_distinct(list_filter(list_concat([CASE WHEN len(c) > 0 THEN concat_ws(' ', '^', c[1], c[2]) END],
  list_transform(range(1, len(s) + 1), lambda j: CASE WHEN s[j] - j < len(c) THEN concat_ws(' ', w[s[j]], c[s[j] - j + 1], c[s[j] - j + 2]) END)), lambda x: x IS NOT NULL))) AS g FROM c),
p AS (SELECT doc_id, any_value(g) FILTER (WHERE k = 1) AS a, any_value(g) FILTER (WHERE k = 2) AS b, any_value(g) FILTER (WHERE k = 3) AS c FROM m GROUP BY doc_id),
i AS (SELECT *, len(list_intersect(a, b)) AS ab, len(list_intersect(a, c)) AS ac FROM p)
SELECT e.doc_id AS doc_id, length(e.text) AS n_chars, sha256(e.edited) AS edited_sha256, sha256(array_to_string(a, ',')) AS fingerprint, sha256(array_to_string(b, ',')) AS edited_fingerprint,
  CASE WHEN len(a) + len(b) = ab THEN 1.0 ELSE ab / (len(a) + len(b) - ab)::DOUBLE END::DOUBLE AS near_edited,
  CASE WHEN len(a) + len(c) = ac THEN 1.0 ELSE ac / (len(a) + len(c) - ac)::DOUBLE END::DOUBLE AS near_next
FROM e JOIN i USING (doc_id)
"""
