"""The store's operators on a change log made from ``events``, with their SQL.

``kvlog``: key ``/user/<user_id>/<event_id % 16>``, value ``props``, a delete for each error event, ``event_id`` as sequence number.
``tiered``: the log cut by age into three sources, 0 the newest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import buffered_size, entry_size, range_may_hold_key, range_may_hold_prefix
from emberlog.operators import as_of, get_many, merge_tagged, newest_wins, run_statistics, scan, shadowed_by_deletes, visible

Query = Callable[[SparkSession, str], DataFrame]
PREFIX, KEY = "/user/0000000001", "/user/00000000004/03"
WANTED = ["/user/00000000001/00", "/user/00000000002/01", "/user/00000000003/02", KEY, "/nope"]


def kvlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    key = F.concat(F.lit("/user/"), F.lpad(F.col("user_id").cast("string"), 11, "0"), F.lit("/"), F.lpad((F.col("event_id") % 16).cast("string"), 2, "0"))
    gone = F.col("event_type") == "error"
    return events.select(key.alias("key"), F.when(gone, F.lit(None)).otherwise(F.col("props")).alias("value"), gone.alias("deleted"), F.col("event_id").alias("seq"))


def cut_points(spark: SparkSession, sf_dir: str) -> tuple[Column, Column]:
    """Sequence numbers at which the middle and the newest source begin; subqueries of the plan, not jobs of their own."""
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_id").alias("m"))
    at = lambda share: last.select(F.floor(F.col("m") * share).alias("at")).scalar()
    return at(0.6), at(0.9)


def tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    middle, newest = cut_points(spark, sf_dir)
    return kvlog(spark, sf_dir).withColumn("prec", F.when(F.col("seq") < middle, 2).when(F.col("seq") < newest, 1).otherwise(0))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source folded, with its place in ``prec``."""
    first = tiered(spark, sf_dir)
    return newest_wins(first.withColumn("_k", F.struct("prec", "key")), F.col("seq").desc(), key="_k").drop("_k")


def _older(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two older sources."""
    return tiered(spark, sf_dir).where(F.col("prec") > 0)


def kv_scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(kvlog(spark, sf_dir))


def kv_scan_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(kvlog(spark, sf_dir), PREFIX)


def kv_scan_prefix_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(kvlog(spark, sf_dir), "/items/")


def kv_scan_with_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest_wins(kvlog(spark, sf_dir)).select("key", "value", "deleted")


def kv_get_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.range(1).select(F.explode(F.array(*map(F.lit, WANTED))).alias("key"))
    return get_many(kvlog(spark, sf_dir), wanted)


def kv_delete_shadowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shadowed_by_deletes(kvlog(spark, sf_dir)).agg(F.coalesce(F.sum("n_shadowed"), F.lit(0)).alias("n_shadowed"))


def kv_compact_keep_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_tagged(_older(spark, sf_dir)).select("key", "value", "deleted")


def kv_compact_final_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible(merge_tagged(_older(spark, sf_dir))).select("key", "value")


def kv_compact_reversed_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_tagged(_older(spark, sf_dir), F.col("prec").desc()).select("key", "value", "deleted")


def kv_tiered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible(merge_tagged(tiered(spark, sf_dir))).select("key", "value")


def kv_run_key_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_statistics(runs(spark, sf_dir), "prec")


def kv_memtable_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupBy("prec").agg(F.sum(buffered_size(F.col("key"), F.col("value"))).alias("n_bytes"))


def kv_entry_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest_wins(kvlog(spark, sf_dir)).select("key", entry_size(F.col("key"), F.col("value")).alias("entry_size"))


def kv_prune_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_statistics(runs(spark, sf_dir), "prec").where(range_may_hold_key(F.col("smallest"), F.col("largest"), KEY)).select("prec")


def kv_prune_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_statistics(runs(spark, sf_dir), "prec").where(range_may_hold_prefix(F.col("smallest"), F.col("largest"), PREFIX)).select("prec")


def kv_snapshot_at_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_of(kvlog(spark, sf_dir), cut_points(spark, sf_dir)[1]).where(~F.col("deleted")).select("key", "value")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        kv_scan_all, kv_scan_prefix, kv_scan_prefix_none, kv_scan_with_tombstones, kv_get_many, kv_delete_shadowed, kv_compact_keep_tombstones, kv_compact_final_level,
        kv_compact_reversed_precedence, kv_tiered_scan, kv_run_key_ranges, kv_memtable_size, kv_entry_size, kv_prune_get, kv_prune_prefix, kv_snapshot_at_seq,
    )
}

_WITH = """
WITH kvlog AS (
  SELECT '/user/' || lpad(CAST(user_id AS VARCHAR), 11, '0') || '/' || lpad(CAST(event_id % 16 AS VARCHAR), 2, '0') AS key,
    CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value, event_type = 'error' AS deleted, event_id AS seq FROM events),
folded AS (SELECT key, value, deleted, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM kvlog) WHERE rn = 1),
b AS (SELECT max(seq) AS m FROM kvlog),
tiered AS (SELECT key, value, deleted, seq, CASE WHEN seq < CAST(floor(m * 0.6) AS BIGINT) THEN 2 WHEN seq < CAST(floor(m * 0.9) AS BIGINT) THEN 1 ELSE 0 END AS prec FROM kvlog, b),
runs AS (SELECT key, value, deleted, seq, prec FROM (SELECT *, row_number() OVER (PARTITION BY prec, key ORDER BY seq DESC) AS rn FROM tiered) WHERE rn = 1),
l01 AS (SELECT key, value, deleted, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY prec) AS rn FROM runs WHERE prec IN (1, 2)) WHERE rn = 1)
"""
_WANTED = ", ".join(f"('{k}')" for k in WANTED)
ORACLE_SQL: dict[str, str] = {
    name: _WITH + body
    for name, body in {
        "kv_scan_all": "SELECT key, value FROM folded WHERE NOT deleted",
        "kv_scan_prefix": f"SELECT key, value FROM folded WHERE NOT deleted AND starts_with(key, '{PREFIX}')",
        "kv_scan_prefix_none": "SELECT key, value FROM folded WHERE NOT deleted AND starts_with(key, '/items/')",
        "kv_scan_with_tombstones": "SELECT key, value, deleted FROM folded",
        "kv_get_many": f"SELECT p.key, f.value, f.key IS NOT NULL AS found FROM (VALUES {_WANTED}) p(key) LEFT JOIN folded f ON f.key = p.key AND NOT f.deleted",
        "kv_delete_shadowed": "SELECT count(*) AS n_shadowed FROM kvlog k JOIN folded f ON k.key = f.key WHERE f.deleted AND k.seq < f.seq AND NOT k.deleted",
        "kv_compact_keep_tombstones": "SELECT key, value, deleted FROM l01",
        "kv_compact_final_level": "SELECT key, value FROM l01 WHERE NOT deleted",
        "kv_compact_reversed_precedence": "SELECT key, value, deleted FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY prec DESC) AS rn FROM runs WHERE prec IN (1, 2)) WHERE rn = 1",
        "kv_tiered_scan": "SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY prec) AS rn FROM (SELECT key, value, deleted, prec FROM runs WHERE prec = 0 UNION ALL SELECT key, value, deleted, 1 FROM l01)) WHERE rn = 1 AND NOT deleted",
        "kv_run_key_ranges": "SELECT prec, min(key) AS smallest, max(key) AS largest, count(*) AS n_entries FROM runs GROUP BY prec",
        "kv_memtable_size": "SELECT prec, CAST(sum(octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0)) AS BIGINT) AS n_bytes FROM runs GROUP BY prec",
        "kv_entry_size": "SELECT key, CAST(9 + octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0) AS BIGINT) AS entry_size FROM folded",
        "kv_prune_get": f"SELECT prec FROM (SELECT prec, min(key) AS s, max(key) AS l FROM runs GROUP BY prec) WHERE '{KEY}' BETWEEN s AND l",
        "kv_prune_prefix": f"SELECT prec FROM (SELECT prec, min(key) AS s, max(key) AS l FROM runs GROUP BY prec) WHERE (starts_with(s, '{PREFIX}') OR '{PREFIX}' >= s) AND (starts_with(l, '{PREFIX}') OR '{PREFIX}' <= l)",
        "kv_snapshot_at_seq": "SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM kvlog, b WHERE seq < CAST(floor(m * 0.9) AS BIGINT)) WHERE rn = 1 AND NOT deleted",
    }.items()
}
