"""Small files on any file system that Spark reaches: by way of Hadoop's API, or directly where they lie in a folder of this machine.

A call to Hadoop's API costs several round trips to the JVM, which a store that commits often would spend most of its time on.
"""

from __future__ import annotations

import os
import shutil
import stat
from pathlib import Path

from pyspark.sql import SparkSession

from emberlog.errors import StoreIOError


def open_uri(uri: str, mode: str):
    """A file of any file system that pyarrow knows, on an executor: ``w`` makes its folders."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(uri)
    if mode == "w":
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        return system.open_output_stream(inner)
    return system.open_input_stream(inner)


class Files:
    """Operations under one root. Paths are relative to it."""

    def __new__(cls, spark: SparkSession, root: str) -> "Files":
        if cls is Files:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
            if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() == "file":
                cls = LocalFiles
        return super().__new__(cls)

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        path = self._path(root)
        self.fs = path.getFileSystem(conf)
        self.root = self.fs.makeQualified(path).toString().rstrip("/")
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        self._overwrite = self._jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        self._overwrite[0] = rename.OVERWRITE

    def path(self, name: str = ""):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def url(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.path(name))

    def is_dir(self, name: str = "") -> bool:
        return self.exists(name) and self.fs.getFileStatus(self.path(name)).isDirectory()

    def make_dirs(self, name: str = "") -> None:
        self.fs.mkdirs(self.path(name))

    def read(self, name: str) -> bytes:
        size = self.fs.getFileStatus(self.path(name)).getLen()
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))
        finally:
            stream.close()

    def create(self, name: str, content: bytes, overwrite: bool = False) -> None:
        """Write a file; without ``overwrite`` it must not exist."""
        try:
            stream = self.fs.create(self.path(name), overwrite)
        except Exception as e:
            raise StoreIOError(f"cannot create {name}: {str(e).splitlines()[0]}") from e
        try:
            stream.write(content)
            stream.hsync()
        finally:
            stream.close()

    def replace(self, name: str, content: bytes) -> None:
        """Write a file so that a reader sees the old content or the new, never a part."""
        self.create(f"{name}.tmp", content, overwrite=True)
        self._context.rename(self.path(f"{name}.tmp"), self.path(name), self._overwrite)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def sizes(self, name: str) -> dict[str, int]:
        """Names and sizes of the entries of a folder."""
        return {s.getPath().getName(): s.getLen() for s in self.fs.listStatus(self.path(name))} if self.exists(name) else {}


class LocalFiles(Files):
    """The same in a folder of this machine (or one mounted on it). Hadoop's checksum files beside replaced files go, as they no longer fit."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        super().__init__(spark, root)
        # a Hadoop path without escapes: file:/a or file:///a
        self._folder = Path("/" + self.root.removeprefix("file:").lstrip("/"))

    def _at(self, name: str) -> Path:
        return self._folder / name if name else self._folder

    def exists(self, name: str = "") -> bool:
        return self._at(name).exists()

    def is_dir(self, name: str = "") -> bool:
        return self._at(name).is_dir()

    def make_dirs(self, name: str = "") -> None:
        self._at(name).mkdir(parents=True, exist_ok=True)

    def read(self, name: str) -> bytes:
        return self._at(name).read_bytes()

    def create(self, name: str, content: bytes, overwrite: bool = False) -> None:
        path = self._at(name)
        try:
            path.parent.mkdir(parents=True, exist_ok=True)
            with open(path, "wb" if overwrite else "xb") as f:
                f.write(content)
                f.flush()
                os.fsync(f.fileno())
            path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
        except OSError as e:
            raise StoreIOError(f"cannot create {name}: {e}") from e

    def replace(self, name: str, content: bytes) -> None:
        path = self._at(name)
        self.create(f"{name}.tmp", content, overwrite=True)
        os.replace(path.with_name(f"{path.name}.tmp"), path)
        path.with_name(f".{path.name}.crc").unlink(missing_ok=True)

    def delete(self, name: str) -> None:
        path = self._at(name)
        if path.is_dir() and not path.is_symlink():
            shutil.rmtree(path)
        else:
            path.unlink(missing_ok=True)
            path.with_name(f".{path.name}.crc").unlink(missing_ok=True)

    def sizes(self, name: str) -> dict[str, int]:
        path = self._at(name)
        if not path.exists():
            return {}
        found = {p.name: p.stat() for p in path.iterdir() if not (p.name.startswith(".") and p.name.endswith(".crc"))}
        return {n: 0 if stat.S_ISDIR(s.st_mode) else s.st_size for n, s in found.items()}
