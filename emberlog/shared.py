"""What the driver and all executors share: a folder, tables written there, and this package."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from emberlog.errors import InvalidRootPath

#: Application id -> folder, where none is configured (one machine only).
_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where that is unset and the master is local (tests on one machine), a temporary folder is made and remembered for
    the application. On a cluster an unset folder is an error: executors could not read what others wrote.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.split("[")[0] == "local":
            raise InvalidRootPath("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _FOLDERS:
            _FOLDERS[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="emberlog-")
        return _FOLDERS[context.applicationId]
    if "://" in found:
        return found
    # a path without a scheme means the session's default file system
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/emberlog/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, rows: int | None = None, rows_a_file: int = 100_000) -> DataFrame:
    """Write ``df`` once into the shared folder and return it as read from there.

    The files survive the loss of any executor, so nothing above them is computed again. If it is known that ``df`` has at most so many narrow
    ``rows``, they go to no more files than that needs (its last stage then has no more tasks either).
    """
    path = fresh_path(df.sparkSession, name)
    held = df if rows is None else df.coalesce(max(1, -(-rows // rows_a_file)))
    held.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> None:
    """Delete all that this application has written into the shared folder. Results that still read from there fail after it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that they need no installation of it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="emberlog-code-")) / "emberlog_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED[context.applicationId] = str(archive)
