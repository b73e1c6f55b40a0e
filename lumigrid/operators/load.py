"""Scenes of an area and a date range on one grid: the whole chain as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import geometry, pixels


def select_scenes(lines: DataFrame, area, dates: tuple[str, str]) -> DataFrame:
    """Flight lines (date, time, minx..maxy) in the range that contain, or else meet, the area, ranked in time."""
    found = geometry.scenes_for(lines.where(F.col("date").between(*dates)), area)
    if found.isEmpty():
        raise ValueError("no scene of the date range meets the area")
    return found


def load(scenes: DataFrame, sensor: DataFrame, glt: DataFrame, grid: DataFrame | None = None, edges: DataFrame | None = None, method="first") -> tuple[DataFrame, DataFrame]:
    """(pixels by time, row, col; sensor pixels of scenes without lookup table).

    ``scenes``: scene_id, time. ``sensor``: scene_id, y, x, v. ``glt``: scene_id, row, col, src_y, src_x
    (0-based, on the common grid). Order of a merge is the scenes' time.
    """
    chosen = sensor.join(scenes.select("scene_id", "time"), "scene_id")
    known = glt.select("scene_id").distinct()
    cells = glt.join(scenes.select("scene_id", "time"), "scene_id")
    values = cells.join(chosen.drop("time").withColumnsRenamed({"y": "src_y", "x": "src_x"}), ["scene_id", "src_y", "src_x"])
    if edges is not None:
        points = values.select("row", "col", F.concat_ws(":", "row", "col").alias("cell"), F.col("col").cast("double").alias("px"), F.col("row").cast("double").alias("py"))
        inside = geometry.clip(points.distinct(), edges, "cell").select("row", "col")
        values = values.join(inside, ["row", "col"], "left_semi")
    out = pixels.mosaic(values.withColumn("day", F.to_date("time")), method, ("day", "row", "col"), "v", "time")
    if grid is not None:
        out = pixels.align(out.withColumnRenamed("day", "time"), out.select(F.col("day").alias("time")).distinct(), grid).withColumnRenamed("time", "day")
    return out, chosen.join(known, "scene_id", "left_anti")
