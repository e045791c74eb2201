"""Schemas and aliases."""

from __future__ import annotations

from pyspark.sql import types as T

Key = str
Value = bytes

#: A change: ``value`` is null exactly if ``deleted``; an empty value is present. ``seq`` is the order of changes.
ENTRY = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("deleted", T.BooleanType(), False),
        T.StructField("seq", T.LongType(), False),
    ]
)
#: What a scan returns.
PAIR = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("value", T.BinaryType(), True)])
#: A live file in the manifest.
SEGMENT = T.StructType(
    [
        T.StructField("level", T.IntegerType(), False),
        T.StructField("run", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("smallest", T.StringType(), False),
        T.StructField("largest", T.StringType(), False),
        T.StructField("n_entries", T.LongType(), False),
        T.StructField("n_bytes", T.LongType(), False),
    ]
)
