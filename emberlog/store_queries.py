"""Queries that run the change log of ``events`` through a whole store: logs, buffers, runs, manifest, compaction, reopening, streams, files.

Each fills a fresh store in the shared folder in the order of the changes: the oldest source and the middle one as runs (``put_all``), the
newest one entry by entry through the log. What comes out must be the fold of the log, so the SQL is that of ``queries``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.config import StoreConfig
from emberlog.functions import has_prefix
from emberlog.operators import newest_wins
from emberlog.queries import _WITH, KEY, ORACLE_SQL, PREFIX, WANTED, Query, kvlog, tiered
from emberlog.shared import fresh_path, materialize
from emberlog.sources.lsm_files import read_database, write_database
from emberlog.store import KVStore
from emberlog.streaming import ingest

#: Small enough that the log's newest source fills several buffers and levels overflow by themselves.
CONFIG = StoreConfig(max_active_memtable_size=16 << 10, max_frozen_memtables=2, level_base_max_size=100_000, level_base_max_sstables=2)
#: Changes under one ``fsync``.
GROUP = 500


def _source(spark: SparkSession, sf_dir: str, prec: int) -> DataFrame:
    return tiered(spark, sf_dir).where(F.col("prec") == prec).drop("prec")


def _groups(changes: DataFrame) -> Iterator[list[tuple[str, bytes | None]]]:
    """The changes by age, a group at a time; the driver holds a partition."""
    rows = changes.orderBy("seq").toLocalIterator()
    while group := list(islice(rows, GROUP)):
        yield [(r["key"], None if r["deleted"] else (r["value"] or "").encode()) for r in group]


def _put_newest(store: KVStore, spark: SparkSession, sf_dir: str) -> None:
    for group in _groups(_source(spark, sf_dir, 0)):
        store.put_many(group)


def _put_older(store: KVStore, spark: SparkSession, sf_dir: str) -> None:
    for prec in (2, 1):
        store.put_all(_source(spark, sf_dir, prec).withColumn("at", F.col("seq")), order_by=F.col("at"))


def _open(spark: SparkSession, root: str, config: StoreConfig = CONFIG) -> KVStore:
    return KVStore.open(spark, root, config)


def _filled(spark: SparkSession, sf_dir: str) -> KVStore:
    store = _open(spark, fresh_path(spark, "store"))
    _put_older(store, spark, sf_dir)
    _put_newest(store, spark, sf_dir)
    return store


def _as_text(df: DataFrame) -> DataFrame:
    """Values as text, written to the shared folder: the store is closed before the caller reads them."""
    return materialize(df.withColumn("value", F.col("value").cast("string")), "store-rows")


def store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buffers, frozen buffers, level 0 and lower levels in one scan."""
    with _filled(spark, sf_dir) as s:
        return _as_text(s.scan())


def store_scan_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _filled(spark, sf_dir) as s:
        return _as_text(s.scan(PREFIX))


def store_scan_after_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All in one last level, by merging level after level, and without the files that are no longer named."""
    with _filled(spark, sf_dir) as s:
        s.flush()
        for level in range(len(s.levels())):
            s.compact(level)
        s.vacuum()
        return _as_text(s.scan())


def store_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point reads, one by one."""
    with _filled(spark, sf_dir) as s:
        found = [(k, s.get(k)) for k in WANTED]
    return spark.createDataFrame([(k, None if v is None else v.decode(), v is not None) for k, v in found], "key string, value string, found boolean")


def store_get_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key that the log holds, and one that it doesn't."""
    wanted = kvlog(spark, sf_dir).select("key").unionByName(spark.createDataFrame([("/nope",)], "key string"))
    with _filled(spark, sf_dir) as s:
        return _as_text(s.get_many(wanted))


def store_delete_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes from a DataFrame and one by one, then a merge that must not bring anything back."""
    with _filled(spark, sf_dir) as s:
        s.delete_all(kvlog(spark, sf_dir).where(has_prefix(PREFIX)).select("key"))
        s.delete(KEY)
        s.flush()
        s.compact(0)
        return _as_text(s.scan())


def store_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed and opened in the middle of the newest source and after it: what was not flushed comes from the logs."""
    root = fresh_path(spark, "store")
    with _open(spark, root) as s:
        _put_older(s, spark, sf_dir)
    for group in _groups(_source(spark, sf_dir, 0)):
        if s._closed:
            s = _open(spark, root)
        s.put_many(group)
        if len(s._frozen) == CONFIG.max_frozen_memtables:
            s.close()
    s.close()
    with _open(spark, root) as s:
        return _as_text(s.scan())


def store_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan of the version before the newest source was written."""
    with _open(spark, fresh_path(spark, "store")) as s:
        _put_older(s, spark, sf_dir)
        version = s.version
        _put_newest(s, spark, sf_dir)
        return _as_text(s.scan(version=version))


def store_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key range and entries of each run: the oldest source merged down two levels, the middle one in level 1 with its tombstones, the newest in level 0."""
    with _open(spark, fresh_path(spark, "store"), StoreConfig()) as s:
        for prec, merges in ((2, (0, 1)), (1, (0,)), (0, ())):
            s.put_all(_source(spark, sf_dir, prec).withColumn("at", F.col("seq")), order_by=F.col("at"))
            for level in merges:
                s.compact(level)
        # a level below the first is one run, in however many writes its files were made
        by = F.when(F.col("level") == 0, F.col("run")).alias("run")
        return s.segments().groupBy("level", by).agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.sum("n_entries").alias("n_entries")).drop("run")


def store_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries of the two older sources after a merge into a level that is not the last: tombstones stay."""
    with _open(spark, fresh_path(spark, "store"), StoreConfig()) as s:
        s.put_all(_source(spark, sf_dir, 2).withColumn("at", F.col("seq")), order_by=F.col("at"))
        s.compact(0)
        s.put_all(_source(spark, sf_dir, 1).withColumn("at", F.col("seq")), order_by=F.col("at"))
        return _as_text(newest_wins(s.entries()).select("key", "value", "deleted"))


def store_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three sources arrive as files of a stream, one after another, each a micro-batch."""
    folder, checkpoint = fresh_path(spark, "stream"), fresh_path(spark, "stream-state")
    with _open(spark, fresh_path(spark, "store")) as s:
        for prec in (2, 1, 0):
            _source(spark, sf_dir, prec).write.mode("append").parquet(folder)
            changes = spark.readStream.schema("key string, value string, deleted boolean, seq long").parquet(folder)
            ingest(changes.withColumnRenamed("seq", "at"), s, "feed", checkpoint, order_by=F.col("at")).awaitTermination()
        return _as_text(s.scan())


def store_foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three sources as a database of the embedded store's own files, written and read back."""
    root = fresh_path(spark, "foreign")
    write_database([newest_wins(_source(spark, sf_dir, prec)) for prec in (0, 1, 2)], root, n_ranges=4)
    return read_database(spark, root).where(~F.col("deleted")).select("key", F.col("value").cast("string").alias("value"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (store_scan, store_scan_prefix, store_scan_after_compact, store_get, store_get_many, store_delete_all, store_reopen, store_snapshot, store_levels, store_tombstones, store_stream, store_foreign)
}

_LEVELS = """
SELECT 2 AS level, min(key) AS smallest, max(key) AS largest, count(*) AS n_entries FROM runs WHERE prec = 2 AND NOT deleted
UNION ALL SELECT CASE prec WHEN 1 THEN 1 ELSE 0 END, min(key), max(key), count(*) FROM runs WHERE prec < 2 GROUP BY prec
"""
_OLDEST = "lowest AS (SELECT * FROM runs WHERE prec = 2 AND NOT deleted)"
ORACLE_SQL_STORE: dict[str, str] = {
    "store_scan": ORACLE_SQL["kv_scan_all"],
    "store_scan_prefix": ORACLE_SQL["kv_scan_prefix"],
    "store_scan_after_compact": ORACLE_SQL["kv_scan_all"],
    "store_get": ORACLE_SQL["kv_get_many"],
    "store_get_many": _WITH + "SELECT p.key, f.value, f.key IS NOT NULL AS found FROM (SELECT DISTINCT key FROM kvlog UNION SELECT '/nope') p LEFT JOIN folded f ON f.key = p.key AND NOT f.deleted",
    "store_delete_all": _WITH + f"SELECT key, value FROM folded WHERE NOT deleted AND NOT starts_with(key, '{PREFIX}') AND key <> '{KEY}'",
    "store_reopen": ORACLE_SQL["kv_scan_all"],
    "store_snapshot": ORACLE_SQL["kv_snapshot_at_seq"],
    "store_levels": _WITH + f"SELECT * FROM ({_LEVELS}) WHERE n_entries > 0",
    # the oldest source alone was in the last level when it was merged, so its own tombstones are gone
    "store_tombstones": _WITH + f", {_OLDEST} SELECT key, value, deleted FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY prec) AS rn FROM (SELECT * FROM runs WHERE prec = 1 UNION ALL SELECT * FROM lowest)) WHERE rn = 1",
    "store_stream": ORACLE_SQL["kv_scan_all"],
    "store_foreign": ORACLE_SQL["kv_scan_all"],
}
