"""What the operators of this subpackage share: storage, tables, streaming by group."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is missing, a temporary folder is used on a local master (as in tests); a cluster needs the setting.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = getattr(spark.sparkContext, "_lumigrid_dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="lumigrid-")
        spark.sparkContext._lumigrid_dir = own
    return own


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder path below the shared one; removed when the driver ends."""
    path = f"{shared_dir(spark)}/lumigrid-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session has ended before
            return


@contextmanager
def settings(spark: SparkSession, **conf: str):
    """Session settings (``__`` stands for a dot) that are put back afterwards."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: computed once, survives lost executors.

    What the write shuffled goes with it, as the written table stands in for it.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._lumigrid_path = path
    return made


def release(*stashed: DataFrame) -> None:
    """Remove what ``stash`` wrote for frames that no plan reads any more."""
    for df in stashed:
        remove(df.sparkSession, df._lumigrid_path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


#: A key with more than one in so many of the rows is joined by broadcast: there are fewer such keys than this.
HOT = 1000
_LEAST = 100


def hot_join(rows: DataFrame, table: DataFrame, on: list[str], count: str) -> DataFrame:
    """``rows`` JOIN ``table``, which has one row for each key, however unevenly ``rows`` are spread over the keys.

    ``count`` is a column of ``table``: how many of ``rows`` have the key. Keys with over 1/HOT of all (at most HOT keys)
    are broadcast, so that their rows stay where they are; the others meet by a shuffle. ``table`` and ``rows`` are read twice.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > max(total // HOT, _LEAST)
    few = table.where(hot)
    if few.isEmpty():
        return rows.join(table, on)
    rest = rows.join(F.broadcast(few.select(*on)), on, "left_anti").join(table.where(~hot), on)
    return rows.join(F.broadcast(few), on).unionByName(rest)


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, h, text: rows of one doc_id are told apart by ``h``, a hash of the text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Make ready for Python workers: send the package, bound their Arrow batches in rows and bytes."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text that a range of rows is meant to hold.
RANGE_BYTES = 64 << 20


def range_count(spark: SparkSession, total: int | None) -> int:
    """Ranges for so many bytes of text: their number grows with the data, so that a range does not."""
    return max(shuffle_partitions(spark), -(-(total or 0) // RANGE_BYTES), 1)


def places(spark: SparkSession, n: int) -> list[int]:
    """For each partition, a number that ``repartition(n, column)`` sends there; a range then has a partition of its own."""
    tried = spark.range(0, n * (8 + 2 * n.bit_length())).select(F.col("id").cast("int").alias("v"))
    found = {r["p"]: r["v"] for r in tried.groupBy(F.pmod(F.hash("v"), F.lit(n)).alias("p")).agg(F.min("v").alias("v")).collect()}
    return [found.get(p, p) for p in range(n)]


def groups(frames: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Cut a stream of frames, sorted by ``key``, into one frame for each key."""
    held: list[pd.DataFrame] = []
    last = None
    for frame in frames:
        if not len(frame):
            continue
        keys = frame[key]
        change = (keys != keys.shift()).any(axis=1).to_numpy()
        cuts = [i for i in change.nonzero()[0] if i > 0]
        for a, b in zip([0, *cuts], [*cuts, len(frame)]):
            part = frame.iloc[a:b]
            this = tuple(part[key].iloc[0])
            if held and this != last:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
            last = this
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def each_group(df: DataFrame, key: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, flush: int = 5000) -> DataFrame:
    """Apply ``work`` to the rows of each key, streaming through sorted partitions.

    The caller bounds the size of a group; only one is held at a time.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, n = [], 0
        for group in groups(frames, key):
            made = work(group)
            if len(made):
                out.append(made)
                n += len(made)
            if n >= flush:
                yield pd.concat(out)
                out, n = [], 0
        if out:
            yield pd.concat(out)

    return df.repartition(*key).sortWithinPartitions(*key).mapInPandas(run, schema)


def base32_sha1(column: F.Column) -> F.Column:
    """Upper-case base32 of the SHA-1 of a binary column, by DataFrame functions."""
    digest = F.sha1(column)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
