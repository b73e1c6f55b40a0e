"""Connected components of a graph in a DataFrame.

A graph of at most ``ONE_TASK`` edges, counted beforehand, is solved in one task of bounded memory; a
larger one by alternating large and small stars, joins of narrow rows. Both give the same rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, small_batches, stash

#: 16 bytes an edge: 32 MB.
ONE_TASK = 2_000_000


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a graph and the smallest node that each reaches."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for ends in (a, b, label[a], label[b]):
            np.minimum.at(new, ends, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def components(edges: DataFrame, rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """``node``, ``component``: the smallest node that each node of ``edges`` (a, b: long) reaches.

    Edges with a null end and loops are left out. Of the graph only a count and a checksum of each round come
    to the driver. No edges: no rows.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = stash(now, "edges")
    if now.count() <= one_task:
        small_batches(edges.sparkSession)

        def solve(frames):
            parts = [(f["u"].to_numpy(), f["v"].to_numpy()) for f in frames if len(f)]
            if parts:
                nodes, low = smallest(*(np.concatenate(x) for x in zip(*parts)))
                for k in range(0, len(nodes), 50_000):
                    yield pd.DataFrame({"node": nodes[k : k + 50_000], "component": low[k : k + 50_000]})

        made = stash(now.repartition(1).mapInPandas(solve, "node long, component long"), "components")
    else:
        made = stash(_by_stars(now.distinct(), rounds), "components")
    release(now)
    return made


def _by_stars(now: DataFrame, rounds: int) -> DataFrame:
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        star = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        joined = star.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, stash(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        if hasattr(before, "_lumigrid_path"):
            release(before)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("u").agg(F.min("v").alias("v")).selectExpr("u AS node", "v AS component").unionByName(
        now.selectExpr("v AS node", "v AS component").distinct()
    )
