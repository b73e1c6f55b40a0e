"""Embedding near-dedup by int8 tile products with rigorous error bounds.

Vectors are compared only within a label. Equal vectors are one class with a weight. Of a class its unit vector u is kept
as s*q + e, q in int8, with |e| computed in double precision. The classes of a label are dealt by hash into tiles; each pair of tiles is
one task, and what travels there is q, s and |e|, an eighth of the vector. The product of two tiles of q bounds
the cosine from above by s*t*(q.r) + |e| + (1 + |e|)*|f|. Only vectors of a tile pair with some bound that reaches the
threshold come to it in full, and only pairs whose bound reaches it are computed again, in double precision. Link counts and spanning links
leave a task, never pairs. The work grows with the square of a label's classes; exact links have that price.

Defined results: a vector that is null, empty or zero or has null or non-finite components, a null
label and a null vec_id link with nothing; vectors of unequal length do not link. Vectors are scaled by a power of two first, so that very large
and very small components do not overflow. Repeated rows count as further vectors, and so do different vectors of one vec_id. All pairs at
the threshold link, so ties need no order. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import each_group, hot_join, release, small_batches, stash, table
from .components import components
from .setsim import forest, tiled

#: Vectors of a tile; two tiles meet in one task.
TILE = 1024
_SLACK = 1e-9
_CHUNK = 1 << 16


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that their largest components are between 1/2 and 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and the norms of what the codes miss."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(unit - codes * scale[:, None], axis=1)


def possible(codes: np.ndarray, scale: np.ndarray, miss: np.ndarray, threshold: float):
    """Blocks (i, j) of the pairs i < j whose cosine may reach the threshold."""
    kind = np.float32 if codes.shape[1] * 127 * 127 < 1 << 24 else np.float64  # exact for these integers
    codes = codes.astype(kind)
    for a in range(0, len(codes), 512):
        b = min(a + 512, len(codes))
        bound = (codes[a:b] @ codes.T) * scale[a:b, None] * scale[None, :]
        bound += miss[a:b, None] + (1 + miss[a:b, None]) * miss[None, :] + _SLACK
        i, j = np.nonzero(bound >= threshold)
        keep = i + a < j
        yield i[keep] + a, j[keep]


def near_pairs(x: np.ndarray, threshold: float) -> np.ndarray:
    """A matrix of the pairs of rows with cosine of at least ``threshold`` in double precision."""
    x = scaled(x)
    norm = np.linalg.norm(x, axis=1)
    near = np.zeros((len(x), len(x)), bool)
    for i, j in possible(*quantised(x / norm[:, None]), threshold):
        for c in range(0, len(i), _CHUNK):
            p, q = i[c : c + _CHUNK], j[c : c + _CHUNK]
            cosine = np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q])
            hit = cosine >= threshold
            near[p[hit], q[hit]] = True
    return near | near.T


def link(vectors: DataFrame, threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of ``vectors`` (vec_id, embedding, label)."""
    small_batches(vectors.sparkSession)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), "label")
    sound = F.size("x") > 0
    sound &= ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    sound &= F.exists("x", lambda c: c != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    kind = F.when(sound, F.concat_ws(":", F.col("label").cast("string"), F.size("x").cast("string")))
    v = v.withColumn("grp", kind)
    v = v.withColumns({"h1": F.when(F.col("grp").isNotNull(), F.xxhash64(F.lit(1), "x")), "h2": F.when(F.col("grp").isNotNull(), F.xxhash64(F.lit(2), "x"))})
    v = stash(v, "vectors")
    key = ["grp", "h1", "h2"]
    classes = v.where("grp IS NOT NULL").groupBy(*key).agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"), F.first("x").alias("x"))
    classes = stash(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # written once, so the ids hold

    def coded(frames):
        for _, frame in ((k, g) for f in frames for k, g in f.groupby("grp", sort=False)):  # vectors of one length
            x = scaled(np.stack(frame["x"].to_numpy()).astype(np.float64))
            codes, scale, miss = quantised(x / np.linalg.norm(x, axis=1, keepdims=True))
            yield pd.DataFrame({"grp": frame["grp"], "id": frame["id"], "codes": [c.tobytes() for c in codes], "scale": scale, "miss": miss})

    def flag(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        codes = np.stack([np.frombuffer(c, np.int8) for c in frame["codes"]])
        own, hit = frame["own"].to_numpy(), np.zeros(len(frame), bool)
        apart = frame["t1"].iloc[0] != frame["t2"].iloc[0]
        for i, j in possible(codes, frame["scale"].to_numpy(), frame["miss"].to_numpy(), threshold):
            if apart:
                i, j = i[own[i] != own[j]], j[own[i] != own[j]]
            hit[i] = hit[j] = True
        return frame.loc[hit, ["grp", "t1", "t2", "id", "own"]]

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        near = near_pairs(np.stack(frame["x"].to_numpy()).astype(np.float64), threshold)
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

    tile_key = ["grp", "t1", "t2"]
    codes = stash(classes.select("grp", "id", "x").mapInPandas(coded, "grp string, id long, codes binary, scale double, miss double"), "codes")
    flagged = stash(each_group(tiled(codes, "grp", "id", tile), tile_key, flag, "grp string, t1 int, t2 int, id long, own int"), "flagged")
    found = stash(each_group(flagged.join(classes.select("id", "weight", "x"), "id"), tile_key, work, "id long, root long, links long"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("others"))
    joined = components(found.selectExpr("id AS a", "root AS b"))
    per_class = classes.drop("x").join(links, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left").select(
        *key, "first", "weight", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")
    )
    low = per_class.groupBy("component").agg(F.min("first").alias("component_id"))
    per_class = stash(per_class.join(low, "component").select(*key, "weight", "n_links", "component_id"), "decisions")
    release(classes, codes, flagged, found, joined)
    some = hot_join(v.where("grp IS NOT NULL").select("vec_id", *key), per_class, key, "weight")
    some = some.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("component_id") == F.col("vec_id")).alias("kept"))
    none = v.where("grp IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return some.unionByName(none)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.93::DOUBLE),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept FROM v LEFT JOIN n ON n.a = vec_id JOIN c ON c.a = vec_id
"""
