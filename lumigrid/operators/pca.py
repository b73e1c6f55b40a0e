"""Principal components from exact moments: matrix products on executors, centred scores as column arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(pixels: DataFrame, bands: str = "bands") -> DataFrame:
    """i, j, n, sum_i, sum_j, sum_ij over the rows without nulls (i <= j).

    Each task adds up X'X by matrix products over Arrow batches and gives bands * (bands + 1) / 2 rows, so what is
    shuffled depends on the numbers of bands and tasks alone. Exploding the pairs of each pixel would make about
    90,000 rows a pixel of 425 bands. Arrays of different lengths are added up apart and meet in the shuffle.
    """
    rows = pixels.where(~F.exists(bands, lambda v: v.isNull() | F.isnan(v.cast("double")))).select(F.transform(bands, lambda v: v.cast("double")).alias("b"))

    def run(batches):
        sums: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            lists = batch.column(0)
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            values, begin = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])
            for length in np.unique(size):
                x = values[begin[:-1][size == length][:, None] + np.arange(length)]
                n, first, second = sums.get(int(length), (0, 0.0, 0.0))
                sums[int(length)] = (n + len(x), first + x.sum(axis=0), second + x.T @ x)
        for length, (n, first, second) in sums.items():
            i, j = np.triu_indices(length)
            made = [i.astype(np.int32), j.astype(np.int32), np.full(len(i), n, np.int64), first[i], first[j], second[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], ["i", "j", "n", "sum_i", "sum_j", "sum_ij"])

    p = rows.mapInArrow(run, "i int, j int, n long, sum_i double, sum_j double, sum_ij double")
    return p.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sum_i", "sum_j", "sum_ij")])


def covariance(pixels: DataFrame, bands: str = "bands") -> DataFrame:
    """i, j, cov (i <= j), with n - 1."""
    m = moments(pixels, bands)
    return m.select("i", "j", ((F.col("sum_ij") - F.col("sum_i") * F.col("sum_j") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))).alias("cov"))


@dataclass
class PCAModel:
    """Mean, components (rows, of length 1, largest loading positive) and variances."""

    mean: np.ndarray
    components: np.ndarray
    variance: np.ndarray
    whiten: bool = False

    def scores(self, bands: Column) -> Column:
        """Array of centred scores; null where the pixel has a null band."""
        centred = F.zip_with(bands, F.lit([float(m) for m in self.mean]), lambda v, m: v.cast("double") - m)
        one = lambda row: F.aggregate(F.zip_with(centred, F.lit([float(c) for c in row]), lambda v, c: v * c), F.lit(0.0), lambda s, p: s + p)
        scale = np.sqrt(np.maximum(self.variance, 1e-300)) if self.whiten else np.ones(len(self.variance))
        made = F.array(*[one(row) / float(s) for row, s in zip(self.components, scale)])
        return F.when(bands.isNotNull() & ~F.exists(bands, lambda v: v.isNull()), made)

    def transform(self, pixels: DataFrame, bands: str = "bands") -> DataFrame:
        return pixels.withColumn("pca", self.scores(F.col(bands)))


def fit(pixels: DataFrame, k: int, bands: str = "bands", whiten: bool = False) -> PCAModel:
    """Pixels with any null band are left out. bands * (bands + 1) / 2 rows come to the driver."""
    return solve([tuple(r) for r in moments(pixels, bands).collect()], k, whiten)


def solve(rows: list[tuple], k: int, whiten: bool = False) -> PCAModel:
    size = max(r[1] for r in rows) + 1
    cov, mean = np.zeros((size, size)), np.zeros(size)
    for i, j, n, si, sj, sij in rows:
        cov[i, j] = cov[j, i] = (sij - si * sj / n) / max(n - 1, 1)
        mean[i], mean[j] = si / n, sj / n
    value, vector = np.linalg.eigh(cov)
    order = np.argsort(value)[::-1][:k]
    parts = vector[:, order].T
    parts *= np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(axis=1)])[:, None]
    return PCAModel(mean, parts, value[order], whiten)


def combined(a: DataFrame, b: DataFrame) -> DataFrame:
    """Moments of two batches together."""
    return a.unionByName(b).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sum_i", "sum_j", "sum_ij")])
