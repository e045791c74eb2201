"""Sorted runs of entries as Parquet files with disjoint, ordered key ranges.

Runs of any size are written by Spark. What is small and bounded (a buffer, a merge of a few small files) is written and merged on the driver: a job
for each of them would cost far more than the work.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.errors import SegmentOpenError
from emberlog.plans.manifest import Segment
from emberlog.schema import ENTRY
from emberlog.sources.files import Files


#: One task writes about so many entries, and so many bytes of keys and values, whatever the size of files that is aimed at.
TASK_ENTRIES, TASK_BYTES = 1 << 20, 64 << 20
#: Up to so many entries and bytes of keys and values are merged on the driver.
LOCAL_ENTRIES, LOCAL_BYTES = 1 << 20, 32 << 20


def files_for(size: int, target: int, n_entries: int, n_raw: int) -> int:
    """Files for a run of ``size`` bytes as stored: each of about ``target`` bytes, and none more than a task should hold."""
    return max(1, math.ceil(size / target), math.ceil(n_entries / TASK_ENTRIES), math.ceil(n_raw / TASK_BYTES))


def write_run(files: Files, folded: DataFrame, n_files: int, block_bytes: int, expected_keys: int | None = None) -> list[Segment]:
    """Write a folded run in ``n_files`` key ranges under a name that nothing has used; no file for an empty run.

    Files are sorted by key, so Parquet's statistics skip row groups, and carry a Bloom filter on it for point reads.
    Ranges, counts and lengths are read from the written files.
    """
    run = uuid.uuid4().hex
    rows = folded.select(*[F.col(f.name).cast(f.dataType) for f in ENTRY])
    dealt = rows.repartitionByRange(n_files, "key") if n_files > 1 else rows.coalesce(1)
    writer = dealt.sortWithinPartitions("key").write.mode("errorifexists").option("parquet.block.size", max(block_bytes, 1 << 16)).option("parquet.bloom.filter.enabled#key", "true")
    if expected_keys:
        writer = writer.option("parquet.bloom.filter.expected.ndv#key", str(expected_keys))
    name = f"segments/{run}"
    writer.parquet(files.url(name))
    sizes = files.sizes(name)
    if not any(f.endswith(".parquet") for f in sizes):
        return []
    raw = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    held = (
        folded.sparkSession.read.schema(ENTRY)
        .parquet(files.url(name))
        .groupBy(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))
        .agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count(F.lit(1)).alias("n"), F.sum(raw.cast("long")).alias("raw"))
    )
    found = [Segment(run, f"{name}/{r['file']}", r["a"], r["b"], r["n"], sizes.get(r["file"], 0), r["raw"]) for r in held.collect()]
    return sorted(found, key=lambda s: (s.smallest, s.largest))


def _arrow_schema():
    import pyarrow as pa

    return pa.schema([pa.field("key", pa.string(), False), pa.field("value", pa.binary()), pa.field("deleted", pa.bool_(), False), pa.field("seq", pa.int64(), False)])


def _raw_bytes(table) -> int:
    import pyarrow.compute as pc

    return sum((pc.sum(pc.binary_length(table[c])).as_py() or 0) for c in ("key", "value"))


def _write_sorted(files: Files, table, n_files: int, block_bytes: int) -> list[Segment]:
    """Like ``write_run``, for a sorted table on the driver. Its files have an index of their pages instead of a Bloom filter."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    run, out, each = uuid.uuid4().hex, [], max(1, math.ceil(table.num_rows / n_files))
    for i, begin in enumerate(range(0, table.num_rows, each)):
        part = table.slice(begin, each)
        raw, sink, path = _raw_bytes(part), pa.BufferOutputStream(), f"segments/{run}/part-{i:05d}.parquet"
        group = max(1, min(part.num_rows, part.num_rows * max(block_bytes, 1 << 16) // max(1, raw)))
        pq.write_table(part, sink, compression="snappy", row_group_size=group, write_page_index=True)
        content = sink.getvalue().to_pybytes()
        files.create(path, content)
        out.append(Segment(run, path, part["key"][0].as_py(), part["key"][-1].as_py(), part.num_rows, len(content), raw))
    return out


def write_rows(files: Files, rows: Sequence[tuple], block_bytes: int) -> list[Segment]:
    """Write a buffer's rows, sorted by key, as one file."""
    import pyarrow as pa

    schema = _arrow_schema()
    columns = list(zip(*rows)) or [[]] * len(schema)
    return _write_sorted(files, pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema), 1, block_bytes)


def is_small(segments: Sequence[Segment]) -> bool:
    """Whether the entries of some segments fit on the driver."""
    return all(s.n_raw >= 0 for s in segments) and sum(s.n_entries for s in segments) <= LOCAL_ENTRIES and sum(s.n_raw for s in segments) <= LOCAL_BYTES


def merge_small(files: Files, segments: Sequence[Segment], drop_deleted: bool, n_files: int, block_bytes: int) -> list[Segment]:
    """The fold (``newest_wins`` and, with ``drop_deleted``, ``visible``) of small segments as a new run, on the driver."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    schema = _arrow_schema()
    parts = []
    for s in segments:
        try:
            parts.append(pq.read_table(pa.BufferReader(files.read(s.path)), columns=schema.names).cast(schema))
        except Exception as e:
            raise SegmentOpenError(s.path, str(e).splitlines()[0]) from e
    table = pa.concat_tables(parts).sort_by([("key", "ascending"), ("seq", "descending")]).combine_chunks()
    if table.num_rows > 1:
        key = table["key"]
        table = table.filter(pa.chunked_array([pa.array([True]), *pc.not_equal(key.slice(1), key.slice(0, table.num_rows - 1)).chunks]))
    if drop_deleted:
        table = table.filter(pc.invert(table["deleted"]))
    return _write_sorted(files, table, n_files, block_bytes)


def read_segments(spark: SparkSession, files: Files, segments: list[Segment]) -> DataFrame:
    """The entries of some segments, in one scan."""
    if not segments:
        return spark.createDataFrame([], ENTRY)
    try:
        return spark.read.schema(ENTRY).parquet(*[files.url(s.path) for s in segments])
    except Exception as e:
        raise SegmentOpenError(segments[0].path, str(e).splitlines()[0]) from e
