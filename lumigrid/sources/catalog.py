"""The catalog of scenes: what a listing of files tells, and lookups in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars

DATASETS = ("rfl", "rdn", "igm", "obs")


def scenes(files: DataFrame) -> DataFrame:
    """date, time, dataset, path of the files (path) that follow the layout."""
    line = scalars.line_id(F.col("path"))
    s = files.select("path", line.alias("line"), scalars.dataset_of(F.regexp_replace("path", r"\.hdr$", "")).alias("dataset")).where("line <> ''")
    return s.select(F.substring("line", 4, 8).alias("date"), F.substring("line", 13, 6).alias("time"), "dataset", "path")


def dates_times(files: DataFrame) -> DataFrame:
    """Each date folder with its times in order."""
    date = F.regexp_extract("path", r"/(\d{8})/", 1)
    time = F.regexp_extract(scalars.basename(F.col("path")), r"(?<!\d)\d{6}(?!\d)", 0)
    return files.select(date.alias("date"), time.alias("time")).where("date <> '' AND time <> ''").groupBy("date").agg(F.sort_array(F.collect_set("time")).alias("times"))


def between(lines: DataFrame, start: str, end: str) -> DataFrame:
    """Flight lines of a date range, ends included; dates compare as text."""
    return lines.where(F.col("date").between(start, end))


def between_or_fail(lines: DataFrame, start: str, end: str) -> DataFrame:
    """The same; an error if there are none."""
    found = between(lines, start, end)
    if found.isEmpty():
        raise ValueError("Invalid date range")
    return found


def all_equal(table: DataFrame, column: str) -> bool:
    """Whether a column, such as the scenes' EPSG code, has at most one value."""
    return table.agg(F.count_distinct(column)).first()[0] <= 1


def paths(lines: DataFrame, root: str, datasets) -> DataFrame:
    """date, time, dataset, path of every dataset of every flight line, each once."""
    unknown = set(datasets) - set(DATASETS) - {"glt"}
    if unknown:
        raise ValueError(f"unknown datasets: {sorted(unknown)}")
    d = lines.select("date", "time", F.explode(F.array(*map(F.lit, datasets))).alias("dataset"))
    return d.withColumn("path", scalars.dataset_path(root, F.col("date"), F.col("time"), F.col("dataset"))).distinct()


def by_line(found: DataFrame) -> DataFrame:
    """date, line, n, paths in order: the datasets of a flight line together."""
    return found.groupBy("date", scalars.line_id(F.col("path")).alias("line")).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("path")).alias("paths"))


def listed(spark, root: str) -> DataFrame:
    """path of all files below a folder, by Spark's own listing: no file is opened, no list comes to the driver."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"))


def existing(found: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose path exists below the root, and those that are missing, by a join with the listing."""
    there = listed(found.sparkSession, root)
    return found.join(there, "path", "left_semi"), found.join(there, "path", "left_anti")
