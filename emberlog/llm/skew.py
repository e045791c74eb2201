"""Joins whose one side may hold most of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys of so many rows at least are split, and so many keys at most: both bounds hold whatever the input.
LEAST, MOST = 256, 2000


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], least: int = LEAST, counted: DataFrame | None = None) -> DataFrame:
    """The inner join of ``left`` and ``right``, in which no task gets more than max(``least``, rows / ``MOST``) rows of a key of ``left``.

    A key with more rows is dealt into parts of that size by a hash of the row, and its rows of ``right`` go to each part. There are fewer than
    ``MOST`` such keys, so their table is broadcast. Rows are counted in ``counted`` (default: ``left``), a written table that has the keys
    of ``left`` as often. Null keys join nothing.
    """
    counted = left if counted is None else counted
    size = max(least, counted.count() // MOST)
    hot = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > size).select(*keys, F.ceil(F.col("_rows") / size).cast("int").alias("_parts"))
    names = [c for c, kind in left.dtypes if kind in ("bigint", "int", "string", "binary")]
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*names), F.col("_parts"))).cast("int")).drop("_parts")
    spread = right.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(spread, [*keys, "_salt"]).drop("_salt")
