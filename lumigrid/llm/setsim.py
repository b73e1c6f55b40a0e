"""Exact Jaccard links inside candidate groups, with groups of any size cut into tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_group, hot_join, stash
from .hashing import set_digest, text_sets

#: Members of a tile. Two tiles meet in one task, so a task holds twice as many at once.
TILE = 256
_COLUMNS = 4096


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a list of sorted distinct arrays."""
    n = len(sets)
    inter = np.zeros((n, n), np.float32)
    if n == 2:
        inter[0, 1] = inter[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return inter
    member = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    rank = np.full(len(count), -1, np.int64)
    rank[shared] = np.arange(len(shared))
    column = rank[column]
    keep = column >= 0
    order = np.argsort(column[keep], kind="stable")
    member, column = member[keep][order], column[keep][order]
    for a in range(0, len(shared), _COLUMNS):
        b = min(a + _COLUMNS, len(shared))
        lo, hi = np.searchsorted(column, [a, b])
        block = np.zeros((n, b - a), np.float32)
        block[member[lo:hi], column[lo:hi] - a] = 1
        inter += block @ block.T
    return inter


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of non-empty sets have a Jaccard similarity of at least ``threshold``."""
    inter = overlaps(sets)
    size = np.array([len(s) for s in sets], np.float64)
    near = inter * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) - 1e-6
    near &= (size[:, None] > 0) & (size[None, :] > 0)
    np.fill_diagonal(near, False)
    return near


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a graph given as a matrix: (member, first member of its component)."""
    n = len(near)
    root = np.where(near.any(axis=1), -1, np.arange(n))
    for s in np.flatnonzero(root < 0):
        if root[s] >= 0:
            continue
        todo = np.zeros(n, bool)
        todo[s] = True
        root[s] = s
        while todo.any():
            reach = near[todo].any(axis=0) & (root < 0)
            root[reach] = s
            todo = reach
    return [(i, int(r)) for i, r in enumerate(root) if r != i]


def tiled(members: DataFrame, group: str, id: str, tile: int = TILE) -> DataFrame:
    """Rows of ``members`` with the tile pair (``t1`` <= ``t2``) in which each takes part.

    A group of up to ``tile`` members is one tile; a larger one is dealt by hash into tiles, and each
    member goes to all pairs with its own tile, marked in ``own``. Rows: size / tile for each member.
    """
    count = members.groupBy(group).agg(F.count("*").alias("tile_rows"))
    dealt = hot_join(members, stash(count, "tiles"), [group], "tile_rows")
    dealt = dealt.withColumn("tiles", F.ceil(F.col("tile_rows") / F.lit(tile)).cast("int")).withColumn("own", F.pmod(F.xxhash64(id), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return dealt.select("*", F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2")).drop("other", "tiles", "tile_rows")


def as_sets(texts: DataFrame, width: int) -> DataFrame:
    """The same rows with ``members``, the sorted shingle hashes of ``text``, instead of the text.

    An id is the digest of its set; rows whose text has another digest are left out.
    """
    rest = [c for c in texts.columns if c != "text"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.select(*rest).schema)

    def run(frames):
        for frame in frames:
            sets = text_sets(frame["text"].tolist(), width)
            right = np.array([set_digest(s) == i for s, i in zip(sets, frame["id"])], bool)
            made = frame.loc[right, rest]
            yield made.assign(members=[s.view(np.int64) for s, r in zip(sets, right) if r])

    return texts.select(*rest, "text").mapInPandas(run, f"{kinds}, members array<long>")


def verified(rows: DataFrame, threshold: float) -> DataFrame:
    """Links among the members of each group, without a row for each pair.

    ``rows``: grp, own, t1, t2, id, weight, members (sorted hashes). Result rows: ``id``, ``root`` (a member it is connected with in
    this tile pair, or itself) and ``links``, the summed weights of the members it is similar to. Repeated ids are left out.
    """

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("id").sort_values("id", kind="stable")
        if len(frame) < 2:
            return pd.DataFrame({"id": [], "root": [], "links": []}).astype("int64")
        near = similar([m.view(np.uint64) for m in frame["members"]], threshold)
        own = frame["own"].to_numpy()
        if frame["t1"].iloc[0] != frame["t2"].iloc[0]:
            near &= own[:, None] != own[None, :]
        links = near @ frame["weight"].to_numpy(np.int64)
        ids = frame["id"].to_numpy()
        root = ids.copy()
        for i, r in forest(near):
            root[i] = ids[r]
        keep = links > 0
        return pd.DataFrame({"id": ids[keep], "root": root[keep], "links": links[keep].astype(np.int64)})

    return each_group(rows, ["grp", "t1", "t2"], work, "id long, root long, links long")
