"""n-gram Jaccard join by chosen paths.

Each text becomes the set of its shingles of five words (lower-cased runs of letters and digits; a
text of fewer words has one shingle). Texts with equal sets are one class. From a class a sketch of
64 minima is kept: the element at a position is a token of the set sampled at random, shared by two
sets with their Jaccard similarity as probability. A run starts all sets at a root; at each node one
position, or two in a quarter of the nodes, so 1/0.8 on average, are sampled from the node's hash and
the sets are split by the token there. Buckets of up to ``LEAF`` sets are compared by brute force on
their sketches; in a larger one all sets are compared with a pivot, those so near to it that
all their neighbours must be candidates of the pivot too leave, and the rest is split again. Runs
repeat until a pair at the threshold is found with probability ``RECALL`` at the greatest number of splits. Candidates (estimates of
at least ``threshold - SLACK``) are joined to groups by components; inside a group all pairs are
compared exactly, in tiles, and only link counts and spanning links leave a task. Joins by a bucket, a pivot or a class are by
``hot_join``, as a bucket or a class may hold a third of all rows.

Defined results: null and empty texts, and texts without words, have no set and link with nothing.
Rows that repeat a doc_id or a text count as further copies; of a class one row is kept, the first by (doc_id, text hash), and with
it those that repeat both. A null doc_id is kept and links with nothing. Very long texts are taken whole. Of equal similarities
none is preferred: all at the threshold link. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .common import each_group, hot_join, keyed_texts, release, small_batches, stash, table, unused
from .components import components
from .setsim import TILE, as_sets, forest, tiled, verified

POSITIONS = 64
LEAF = 64
RECALL = 0.999
#: Allowed to the estimate of a pair at the threshold: five standard deviations of 64 positions.
SLACK = 0.25
#: Splits of a large bucket; what is left of it then is compared in tiles.
DEPTH = 6
#: Sets whose estimate with a pivot is at least LEAVE leave the bucket; all from LINK on are its candidates. Estimates are shares of
#: equal positions, so one of at least 0.65 (three standard deviations below 0.8) with a set that leaves has at least
#: 0.6 + 0.65 - 1 = LINK with the pivot.
LEAVE, LINK = 0.6, 0.25


def run_recall(threshold: float, splits: int = DEPTH + 1) -> float:
    """The chance that a pair at the threshold is still together somewhere after the root's split and all others of a run."""
    together = 1.0
    for _ in range(splits):
        once = threshold * together
        together = 0.75 * once + 0.25 * (1 - (1 - once) ** 2)
    return together


def runs_for(threshold: float, recall: float = RECALL) -> int:
    """Runs that find a pair at the threshold with ``recall``, even if its buckets are split to the greatest depth."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(run_recall(threshold), 1 - 1e-9))))


def sketches(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, h, digest (null without words), size, sketch (array of 64 int)."""

    def run(frames):
        for frame in frames:
            texts = frame["text"].tolist()
            values, begin = hashing.shingles(*hashing.unit_words(texts), width)
            low = hashing.min_hashes(values, begin, POSITIONS).view(np.int32)
            sets = [np.unique(values[a:b]) for a, b in zip(begin[:-1], begin[1:])]
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"].astype("Int64"),
                    "h": frame["h"],
                    "digest": pd.array([hashing.set_digest(s) if len(s) else None for s in sets], dtype="Int64"),
                    "size": [len(s) for s in sets],
                    "sketch": list(low),
                }
            )

    return keyed_texts(docs).mapInPandas(run, "doc_id long, h long, digest long, size long, sketch array<int>")


def _sampled(key: Column) -> list[Column]:
    """Positions sampled at a node: one always, another in a quarter of the nodes (else null)."""
    first = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(POSITIONS))
    step = F.pmod(F.xxhash64(key, F.lit(2)), F.lit(POSITIONS - 1)) + 1
    second = F.when(F.pmod(F.xxhash64(key, F.lit(3)), F.lit(4)) == 0, F.pmod(first + step, F.lit(POSITIONS)))
    return [first.cast("int"), second.cast("int")]


def _children(key: Column) -> Column:
    """Keys of a set's child buckets."""
    return F.filter(
        F.array(*[F.when(p.isNotNull(), F.xxhash64(key, p, F.get(F.col("sketch"), p))) for p in _sampled(key)]),
        lambda k: k.isNotNull(),
    )


def _leaf_links(rows: DataFrame, least: float) -> DataFrame:
    """Spanning links (a, b) of each bucket, by brute force over its sketches."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        ids, s = frame["id"].to_numpy(), np.stack(frame["sketch"].to_numpy())
        near = (s[:, None, :] == s[None, :, :]).sum(axis=2) >= least * POSITIONS
        np.fill_diagonal(near, False)
        pairs = forest(near)
        return pd.DataFrame({"a": [ids[i] for i, _ in pairs], "b": [ids[r] for _, r in pairs]}, dtype="int64")

    return each_group(rows, ["key"], work, "a long, b long")


def candidates(classes: DataFrame, threshold: float = 0.8, recall: float = RECALL, leaf: int = LEAF) -> DataFrame:
    """Links (a, b) among classes (id, sketch) that connect, with ``recall``, all similar pairs."""
    least = max(0.0, threshold - SLACK)
    roots = F.array(*[F.lit(r).cast("long") for r in range(runs_for(threshold, recall))])
    level = classes.select("id", F.explode(F.flatten(F.transform(roots, _children))).alias("key"))
    found, used = [], []
    for depth in range(DEPTH):
        level = stash(level, "level")
        used.append(level)
        size = level.groupBy("key").agg(F.count("*").alias("n"), F.min_by("id", F.xxhash64("id", "key")).alias("pivot"))
        size = stash(size.where("n > 1"), "sizes")
        level = stash(hot_join(level, size, ["key"], "n").join(classes, "id"), "paths")
        used += [size, level]
        found.append(stash(_leaf_links(level.where(F.col("n") <= leaf).select("key", "id", "sketch"), least), "pairs"))
        large = level.where(F.col("n") > leaf)
        if large.isEmpty():
            break
        pivot = large.where("id = pivot").select("key", F.col("sketch").alias("mark"), F.col("n").alias("held")).dropDuplicates(["key"])
        pivot = stash(pivot, "pivots")
        same = F.aggregate(F.zip_with("sketch", "mark", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
        large = stash(hot_join(large, pivot, ["key"], "held").withColumn("same", same).drop("mark", "held"), "paths")
        used += [pivot, large]
        found.append(large.where((F.col("same") >= LINK * POSITIONS) & (F.col("id") != F.col("pivot"))).selectExpr("id AS a", "pivot AS b"))
        rest = large.where(F.col("same") < LEAVE * POSITIONS)
        level = rest.select("id", F.explode(_children(F.col("key"))).alias("key"))
    else:  # sets that no split tells apart: all pairs of tiles
        n = tiled(stash(level.join(classes, "id").select(F.col("key").alias("grp"), "id", "sketch"), "rest"), "grp", "id")
        n = n.select(F.xxhash64("grp", "t1", "t2").alias("key"), "id", "sketch")
        found.append(_leaf_links(n, least))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    made = stash(links.distinct(), "candidates")
    release(*used, *[f for f in found if hasattr(f, "_lumigrid_path")])
    return made


def decided(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = RECALL) -> DataFrame:
    """doc_id, h (hash of the text), n_links, class_id and kept of each row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    base = stash(sketches(docs, width), "sketches")
    real = base.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = real.groupBy("digest").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.count("*").alias("weight"), F.first("sketch").alias("sketch"))
    classes = stash(classes.withColumnRenamed("digest", "id"), "classes")
    loose = candidates(classes.select("id", "sketch"), threshold, recall)
    groups = components(loose)
    members = groups.join(classes.select(F.col("id").alias("node"), "first", "weight"), "node").select("node", "component", "weight", "first.*")
    # The text of one document stands for each class that has candidates.
    texts = members.join(keyed_texts(docs), ["doc_id", "h"]).select(F.col("component").alias("grp"), F.col("node").alias("id"), "weight", "text")
    sets = stash(as_sets(texts, width), "sets")
    found = stash(verified(tiled(sets, "grp", "id", TILE), threshold), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("others"))
    joined = components(found.selectExpr("id AS a", "root AS b"))
    per_class = (
        classes.select("id", "first", "weight")
        .join(links, "id", "left")
        .join(joined.withColumnRenamed("node", "id"), "id", "left")
        .select("id", "first", "weight", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    )
    low = per_class.groupBy("component").agg(F.min("first").alias("head"))
    per_class = stash(per_class.join(low, "component").select(F.col("id").alias("digest"), "weight", "n_links", "head"), "decisions")
    some = hot_join(base.where("digest IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "h", "digest"), per_class, ["digest"], "weight").select(
        "doc_id", "h", F.col("n_links").cast("long").alias("n_links"), F.col("head.doc_id").alias("class_id"), (F.struct("doc_id", "h") == F.col("head")).alias("kept")
    )
    none = base.where("digest IS NULL OR doc_id IS NULL").select("doc_id", "h", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    release(classes, loose, groups, sets, found, joined)
    return some.unionByName(none)


def join(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = RECALL) -> DataFrame:
    """doc_id, n_links (other documents at or above the threshold), class_id (smallest doc_id that
    links reach) and kept (the first of its class)."""
    return decided(docs, threshold, width, recall).drop("h")


def keep_first(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the first, by (doc_id, text hash), once; columns as they were.

    Rows with a null doc_id and texts without words stay, those that repeat both doc_id and text too, if they have no words or no doc_id.
    """
    made = stash(decided(docs, threshold, width, recall), "decided")
    doc, h = unused(docs, "own_doc", "own_hash")
    mine = (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(h))
    gone = made.where("NOT kept").select(F.col("doc_id").alias(doc), F.col("h").alias(h)).distinct()
    left = docs.join(gone, mine, "left_anti")
    again = made.where("kept AND n_links > 0").groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1")
    again = stash(again.select(F.col("doc_id").alias(doc), F.col("h").alias(h)), "again")
    if again.isEmpty():
        return left
    keep = [F.first(F.col(f"`{c}`")).alias(c) for c in docs.columns]
    once = left.join(again, mine).groupBy(doc, h).agg(*keep).drop(doc, h)
    return left.join(again, mine, "left_anti").unionByName(once)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


#: Words are runs of ASCII letters and digits and of code points from 128 on.
OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])) END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE k * 9 >= 4 * (x.n + y.n)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a), k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT doc_id, coalesce(k.n, 0)::BIGINT AS n_links, c AS class_id, c = doc_id AS kept FROM documents LEFT JOIN k ON k.a = doc_id JOIN c ON c.a = doc_id
"""
