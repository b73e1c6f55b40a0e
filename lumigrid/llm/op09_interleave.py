"""Sharding by proportional stratified interleaving, by DataFrame functions only.

Rows of each source are ordered by a seeded hash of doc_id, text and source; the r-th of n rows of a source has the
fractional rank (r - 1/2) / n. All rows are ordered by that and cut into runs of equal count, so each
shard has every source in proportion. Ranks are counted in two steps: rows fall into
``BUCKETS`` equal steps of their key, the steps' counts are summed up in order, and rows are numbered
inside a step; no source and no table is ordered in one task.

The law is ``rows``: counts of shards differ by one at most. Defined results: a null text has size 1
and CRC 0, a null source is a source, a null doc_id is ordered by its text. Repeated rows are dealt one
by one. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

SHARDS, BUCKETS, SEED = 16, 4096, "interleave"
_BITS = 60


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    doc_id = F.col("doc_id").cast("long")
    crc = F.crc32(raw)
    name = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    named = F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string"), crc.cast("string"), name).cast("binary"))
    base = docs.select(
        doc_id.alias("doc_id"),
        name.alias("stratum"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.conv(F.substring(named, 1, _BITS // 4), 16, 10).cast("long").alias("key"),
    )
    step = F.shiftrightunsigned(F.col("key"), _BITS - BUCKETS.bit_length() + 1)
    base = stash(base.withColumn("step", step), "strata")
    count = base.groupBy("stratum", "step").agg(F.count("*").alias("c"))
    in_source = Window.partitionBy("stratum")
    before = F.sum("c").over(in_source.orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    count = count.select("stratum", "step", F.coalesce(before, F.lit(0)).alias("before"), F.sum("c").over(in_source).alias("n"))
    ties = [F.col("key"), F.col("stratum"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    rank = F.row_number().over(Window.partitionBy("stratum", "step").orderBy(*ties)) + F.col("before")
    ranked = base.join(count, ["stratum", "step"]).withColumn("at", (rank - 0.5) / F.col("n"))
    ranked = stash(ranked.drop("before", "n", "step").withColumn("step", F.floor(F.col("at") * BUCKETS)), "ranks")
    # A row for each of the BUCKETS steps at most is ordered here.
    whole = Window.partitionBy()
    count = ranked.groupBy("step").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    count = count.select("step", F.coalesce(before, F.lit(0)).alias("before"), F.sum("c").over(whole).alias("n"))
    place = F.row_number().over(Window.partitionBy("step").orderBy("at", *ties)) - 1 + F.col("before")
    out = ranked.join(count, "step").withColumn("place", place).withColumn("shard", F.expr(f"int(place * {shards} div n)"))
    return out.select(
        "doc_id",
        F.when(F.col("stratum") != "n", F.expr("substring(stratum, 2)")).alias("source"),
        "size",
        "text_crc32",
        "shard",
        F.expr(f"place - (shard * n + {shards - 1}) div {shards}").alias("slot"),
    )


def op9_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


OP9_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
raw AS (
  SELECT doc_id, 's' || source AS source, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g'), ' ')[:-2],
      lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS text_crc32
  FROM documents, crc_table),
keyed AS (
  SELECT *, ('0x' || substr(md5(concat_ws(':', '{SEED}', doc_id::VARCHAR, text_crc32::VARCHAR, source)), 1, 15))::BIGINT AS key FROM raw),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY key, doc_id, text_crc32, size) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS frac FROM keyed),
placed AS (SELECT *, row_number() OVER (ORDER BY frac, key, source, doc_id, text_crc32, size) - 1 AS place, count(*) OVER () AS n FROM ranked)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (place * {SHARDS} // n)::INT AS shard,
  (place - ((place * {SHARDS} // n) * n + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard
FROM placed
"""
