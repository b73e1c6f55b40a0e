"""Incremental principal components: moments of batches merged into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import pca


def merge_batches(stream: DataFrame, folder: str, checkpoint: str, bands: str = "bands"):
    """Write each micro-batch's moments to ``folder/batch=N``; a batch that runs again replaces its own."""

    def one(batch: DataFrame, number: int) -> None:
        pca.moments(batch, bands).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)


def model(spark, folder: str, k: int, whiten: bool = False) -> pca.PCAModel:
    """The components of all batches so far."""
    from pyspark.sql import functions as F

    m = spark.read.parquet(folder).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sum_i", "sum_j", "sum_ij")])
    return pca.solve([tuple(r) for r in m.collect()], k, whiten)
