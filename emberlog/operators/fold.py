"""The fold: for each key the newest entry; if that is a tombstone the key is absent.

Everything a store answers is this operator on some runs. It is a window with rank 1, which Spark runs as a partial limit before
the shuffle and a final one after it, so a key with very many versions sends one row from each task. Filters on ``key`` go through it
into the scan. Filters on anything else do not, and are applied after it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions import has_prefix, key_is


def newest_wins(entries: DataFrame, *order: Column, key: str = "key") -> DataFrame:
    """One row for each key: the first by ``order`` (default: highest ``seq``). Tombstones stay."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*(order or (F.col("seq").desc(),))))
    return entries.withColumn("_rank", first).where(F.col("_rank") == 1).drop("_rank")


def visible(folded: DataFrame) -> DataFrame:
    """Drops tombstones. Only right after a fold over everything older."""
    return folded.where(~F.col("deleted"))


def merge_runs(runs: Sequence[DataFrame]) -> DataFrame:
    """Folded runs as one folded run; an earlier run wins over a later one."""
    if not runs:
        raise ValueError("no runs")
    tagged = [r.withColumn("prec", F.lit(i)) for i, r in enumerate(runs)]
    return newest_wins(reduce(lambda a, b: a.unionByName(b), tagged), F.col("prec")).drop("prec")


def merge_tagged(entries: DataFrame, *newest_first: Column) -> DataFrame:
    """The same from one DataFrame with a column ``prec`` (0 the newest run), folded or not: one scan and one exchange for all runs."""
    return newest_wins(entries, *(newest_first or (F.col("prec"),)), F.col("seq").desc()).drop("prec")


def compacted(runs: Sequence[DataFrame], final: bool) -> DataFrame:
    """The merge of ``runs``, newest first; tombstones go only if nothing older lies below."""
    out = merge_runs(runs)
    return visible(out) if final else out


def scan(entries: DataFrame, prefix: str = "", order: Sequence[Column] = ()) -> DataFrame:
    """Live pairs under a prefix, not sorted."""
    return visible(newest_wins(entries.where(has_prefix(prefix)), *order)).select("key", "value")


def get(entries: DataFrame, key: str) -> DataFrame:
    """No row or one: the live value of a key."""
    return visible(newest_wins(entries.where(key_is(key)))).select("key", "value")


def get_many(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """Each distinct key of ``keys`` with its live value and whether it is found."""
    wanted = keys.select("key").distinct()
    live = visible(newest_wins(entries.join(wanted, "key", "left_semi"))).select("key", "value", F.lit(True).alias("_hit"))
    return wanted.join(live, "key", "left").select("key", "value", F.coalesce("_hit", F.lit(False)).alias("found"))


def as_of(entries: DataFrame, before: int | Column) -> DataFrame:
    """The fold of the changes with ``seq`` below a bound: a snapshot."""
    return newest_wins(entries.where(F.col("seq") < before))


def shadowed_by_deletes(entries: DataFrame) -> DataFrame:
    """key and n_shadowed: how many versions the delete that a key ends with hides; keys that end otherwise have no row.

    The last entry has the highest ``seq``, so all versions of the key lie before it. Aggregated before the shuffle.
    """
    each = entries.groupBy("key").agg(F.max_by("deleted", "seq").alias("_gone"), F.count(F.when(~F.col("deleted"), 1)).alias("n_shadowed"))
    return each.where("_gone").select("key", "n_shadowed")


def run_statistics(runs: DataFrame, *by: str) -> DataFrame:
    """Key range and size of each run."""
    return runs.groupBy(*by).agg(F.min("key").alias("smallest"), F.max("key").alias("largest"), F.count(F.lit(1)).alias("n_entries"))
