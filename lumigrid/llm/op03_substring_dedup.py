"""Substring dedup: paragraph MinHash banding for near copies of lines, windows of words for repeats anywhere.

Two kinds of units are cut. The first are paragraphs, lines of at least ``MIN_WORDS`` words. Paragraphs with
equal sets of five-word shingles are one class. Each class gets banded minima, the bands tuned so
that a pair at the threshold collides with probability ``RECALL``; classes that collide in a band are
linked to the smallest of the band, components of those links are candidate groups, and inside a
group all pairs are verified by exact Jaccard similarity, in tiles. Components of the verified links
are clusters: the first occurrence of each, by (doc_id, text hash, line), stays, and the others are cut out.

The second are all windows of ``RUN`` successive words of the text without those lines, whatever its line ends. Of equal
windows the first, by (doc_id, text hash, word), stays, and the words of the others are cut; a later window that overlaps the
first one in its own document stays too. So each run of over 50 words that repeats word for word is cut (not one that arises
only where a cut line stood between its words, and near copies of less than a line stay). A window's key is the
smallest hash of the ``GRAM``-word runs in it, equal for equal windows and for most neighbours; only windows whose key occurs in
several places are hashed and compared.

A line or window that a third of all texts hold is one row of narrow tables, and joins by such keys are by ``hot_join``.

Defined results: null texts stay null and empty texts stay empty. Lines that are left keep their order and their
newlines; a line that loses all its words goes. A repeat inside one document is cut out too. Rows are told apart by doc_id and text:
several texts of one doc_id are documents of their own; rows that repeat both are one, and each loses what that one loses. Rows with a
null doc_id keep their text. Very long texts are taken whole, one batch of bounded bytes at a time. An empty table gives an empty
result. Other columns pass through, whatever their names; a column named like an added one is replaced by it.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .common import hot_join, keyed_texts, release, small_batches, stash, table, unused
from .components import components
from .setsim import TILE, as_sets, tiled, verified

#: Planted and natural repeats of over 50 words are meant; near copies may lose some of them.
MIN_WORDS = 40
RECALL = 0.999
MAX_BANDS = 12
#: Words of a window, the shortest repeat cut, and of the runs whose smallest hash is its key.
RUN, GRAM = 51, 25


def tuned_bands(threshold: float = 0.8, recall: float = RECALL, most: int = MAX_BANDS) -> tuple[int, int]:
    """(bands, rows): the most rows for which ``most`` bands or fewer reach the recall, with the fewest bands."""
    best = (most, 1)
    for rows in range(1, 17):
        miss = 1 - threshold**rows
        bands = next((b for b in range(1, most + 1) if 1 - miss**b >= recall), None)
        if bands:
            best = (bands, rows)
    return best


def paragraphs(docs: DataFrame, threshold: float = 0.8, width: int = 5, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, h, line, id (digest of the shingle set), bands (array of band keys) of the long lines of ``docs`` (doc_id, h, text)."""
    bands, rows = tuned_bands(threshold)

    def run(frames):
        for frame in frames:
            lines, doc, at = [], [], []
            for i, text in enumerate(frame["text"]):
                for k, line in enumerate(text.split("\n")):
                    if len(line) > 2 * min_words - 2:
                        lines.append(line)
                        doc.append(i)
                        at.append(k)
            words, begin = hashing.unit_words(lines)
            values, places = hashing.shingles(words, begin, width)
            low = hashing.min_hashes(values, places, bands * rows).astype(np.uint64).reshape(len(lines), bands, rows)
            with np.errstate(over="ignore"):
                keys = np.full((len(lines), bands), 0, np.uint64) + hashing.stream(11, bands)
                for r in range(rows):
                    keys = hashing.mix(keys + low[:, :, r])
            keys = keys.view(np.int64)
            long = np.flatnonzero(np.diff(begin) >= min_words)
            if not len(long):
                continue
            doc = np.array(doc)[long]
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"].to_numpy()[doc],
                    "h": frame["h"].to_numpy()[doc],
                    "line": np.array(at, np.int32)[long],
                    "id": np.array([hashing.set_digest(np.unique(values[places[u] : places[u + 1]])) for u in long], np.int64),
                    "bands": [keys[u] for u in long],
                }
            )

    return docs.mapInPandas(run, "doc_id long, h long, line int, id long, bands array<long>")


def clusters(docs: DataFrame, threshold: float = 0.8, width: int = 5, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, h, line, cluster, first (struct of doc_id, h, line that stays) of all paragraphs in clusters of two or more."""
    small_batches(docs.sparkSession)
    found = stash(paragraphs(docs, threshold, width, min_words), "paragraphs")
    classes = stash(
        found.groupBy("id").agg(F.min(F.struct("doc_id", "h", "line")).alias("first"), F.count("*").alias("weight"), F.first("bands").alias("bands")), "classes"
    )
    banded = classes.select("id", F.explode("bands").alias("key"))
    low = stash(banded.groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("n")).where("n > 1"), "bands")
    groups = components(hot_join(banded, low, ["key"], "n").where("id <> low").selectExpr("id AS a", "low AS b"))
    chosen = groups.join(classes.select(F.col("id").alias("node"), "first"), "node").select("node", "component", "first.*")
    texts = chosen.join(docs, ["doc_id", "h"]).select(
        F.col("component").alias("grp"), F.col("node").alias("id"), F.lit(1).alias("weight"), F.get(F.split("text", "\n"), F.col("line")).alias("text")
    )
    sets = stash(as_sets(texts, width), "sets")
    linked = stash(verified(tiled(sets, "grp", "id", TILE), threshold), "links")
    joined = components(linked.selectExpr("id AS a", "root AS b"))
    named = classes.select("id", "first", "weight").join(joined.withColumnRenamed("node", "id"), "id", "left")
    named = named.select("id", "first", "weight", F.coalesce("component", "id").alias("cluster"))
    several = named.groupBy("cluster").agg(F.min("first").alias("first"), F.sum("weight").alias("n")).where("n > 1").drop("n")
    named = stash(named.select("id", "weight", "cluster").join(several, "cluster"), "clusters")
    made = stash(hot_join(found.select("doc_id", "h", "line", "id"), named, ["id"], "weight").select("doc_id", "h", "line", "cluster", "first"), "clusters")
    release(found, classes, low, groups, sets, linked, joined, named)
    return made


def repeats(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, h, at (first word), source (doc_id of the window that stays) of the windows to cut.

    ``lines``: doc_id, h, removed_lines; no window that touches one of these takes part.
    """
    small_batches(docs.sparkSession)

    def keyed(frames):
        for frame in frames:
            words, begin = hashing.unit_words(frame["text"].tolist())
            keys, at = hashing.window_keys(words, begin, RUN, GRAM)
            if not len(at):
                continue
            doc = np.searchsorted(begin, at, side="right") - 1
            first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])]))
            n = np.diff(np.append(first, len(at)))
            doc, at = doc[first], at[first]
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"].to_numpy()[doc], "h": frame["h"].to_numpy()[doc],
                    "at": (at - begin[doc]).astype(np.int32), "n": n.astype(np.int32), "key": keys[first].view(np.int64),
                }
            )

    keys = stash(docs.mapInPandas(keyed, "doc_id long, h long, at int, n int, key long"), "keys")
    # One place of a key holds two windows apart from each other only if it is a long run, as of one word.
    several = stash(keys.groupBy("key").agg(F.count("*").alias("places"), F.max("n").alias("most")).where(f"places > 1 OR most > {RUN}").drop("most"), "several")
    spots = hot_join(keys, several, ["key"], "places").groupBy("doc_id", "h").agg(F.collect_set(F.struct("at", "n")).alias("spots"))
    spots = spots.join(lines, ["doc_id", "h"], "left")

    def hashed(frames):
        for frame in frames:
            words, begin = hashing.unit_words(frame["text"].tolist())
            hashes = hashing.runs(words, RUN)
            for k, (doc, h, text, spot, gone) in enumerate(zip(frame["doc_id"], frame["h"], frame["text"], frame["spots"], frame["removed_lines"])):
                at = np.unique(np.concatenate([np.arange(s["at"], s["at"] + s["n"]) for s in spot]))
                if gone is not None and len(gone):
                    line = word_lines(text)[2]
                    held = np.concatenate([[0], np.cumsum(np.isin(line, gone))])
                    at = at[held[at + RUN] == held[at]]
                if len(at):
                    yield pd.DataFrame({"doc_id": doc, "h": h, "at": at.astype(np.int32), "window": hashes[begin[k] + at].view(np.int64)})

    rows = docs.join(spots, ["doc_id", "h"]).select("doc_id", "h", "text", "spots", "removed_lines")
    rows = stash(rows.mapInPandas(hashed, "doc_id long, h long, at int, window long"), "windows")
    first = rows.groupBy("window").agg(F.min(F.struct("doc_id", "h", "at")).alias("first"), F.count("*").alias("places")).where("places > 1")
    first = stash(first, "first")
    cut = hot_join(rows, first, ["window"], "places").where(f"doc_id <> first.doc_id OR h <> first.h OR at >= first.at + {RUN}")
    cut = stash(cut.select("doc_id", "h", "at", F.col("first.doc_id").alias("source")), "cut")
    release(keys, several, rows, first)
    return cut


def word_lines(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end, in bytes, and line number of each word of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    start, end = hashing.word_places(raw)
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
    return start, end, np.searchsorted(breaks, start)


def without(text: str, lines, at) -> str:
    """A text without some lines and the words of the windows that start at ``at``.

    Marks and blanks that follow a cut word go with it, up to the next word; newlines stay.
    """
    start, end, line = word_lines(text)
    edge = np.zeros(len(start) + 1, np.int64)
    at = np.asarray(at, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + RUN, -1)
    cut = np.cumsum(edge)[:-1] > 0
    raw, gone, out = text.encode("utf-8", "surrogatepass"), set(lines), []
    past_line = -1
    for k, part in enumerate(raw.split(b"\n")):
        begin, past_line = past_line + 1, past_line + 1 + len(part)
        a, b = np.searchsorted(line, [k, k + 1])
        here = cut[a:b]
        if k not in gone and not (len(here) and here.all()):
            if here.any():
                kept, done = [], begin
                past = np.append(start[a + 1 : b], past_line)
                for w in np.flatnonzero(here):
                    kept.append(raw[done : start[a + w]])
                    done = end[a + w] + re.match(rb"\S*\s*", raw[end[a + w] : past[w]]).end()
                part = b"".join(kept) + raw[done:past_line]
            out.append(part)
    return b"\n".join(out).decode("utf-8", "surrogatepass")


ADDED = ("removed_lines", "removed_windows", "repeats_of")


def dedup(docs: DataFrame, threshold: float = 0.8, width: int = 5, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without what repeats an earlier paragraph or run of words; other columns as they were.

    Added: ``removed_lines`` (array of int), ``removed_windows`` (array of int: first words of the windows cut
    besides) and ``repeats_of`` (array of doc_id whose text stays for one of these).
    """
    texts = keyed_texts(docs).where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = clusters(texts, threshold, width, min_words)
    cut = found.where("struct(doc_id, h, line) <> first").groupBy("doc_id", "h")
    lines = stash(cut.agg(F.sort_array(F.collect_set("line")).alias("removed_lines"), F.collect_set("first.doc_id").alias("sources")), "cuts")
    release(found)
    windows = repeats(texts, lines.drop("sources"))
    per_doc = windows.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("at")).alias("removed_windows"), F.collect_set("source").alias("more"))
    own = dict(zip(("doc_id", "h", *ADDED), unused(docs, "own_doc", "own_hash", "own_lines", "own_windows", "own_sources")))
    ids, ints = F.array().cast("array<long>"), F.array().cast("array<int>")
    per_doc = stash(
        lines.join(per_doc, ["doc_id", "h"], "full").select(
            F.col("doc_id").alias(own["doc_id"]),
            F.col("h").alias(own["h"]),
            F.coalesce("removed_lines", ints).alias(own["removed_lines"]),
            F.coalesce("removed_windows", ints).alias(own["removed_windows"]),
            F.array_sort(F.array_union(F.coalesce("sources", ids), F.coalesce("more", ids))).alias(own["repeats_of"]),
        ),
        "changes",
    )
    release(lines, windows)
    same = (F.col("doc_id").cast("long") == F.col(own["doc_id"])) & (F.xxhash64(F.col("text").cast("string")) == F.col(own["h"]))
    out = docs.join(per_doc, same, "left")

    @F.pandas_udf("string")
    def left(text: pd.Series, lines: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([without(t, k, w) for t, k, w in zip(text, lines, at)], dtype=object)

    lines, windows = F.col(own["removed_lines"]), F.col(own["removed_windows"])
    text = F.col("text").cast("string")
    # An if in SQL would still send each row through Python; rows without cuts go with an empty text and take the old one back.
    changed = F.col(own["doc_id"]).isNotNull()
    text = F.when(changed, left(F.when(changed, text).otherwise(""), F.coalesce(lines, ints), F.coalesce(windows, ints))).otherwise(text)
    return out.select(
        *[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ADDED],
        *[F.coalesce(own[c], ids if c == "repeats_of" else ints).alias(c) for c in ADDED],
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
