"""Small files beside tables, through the file system that Spark itself uses."""

from __future__ import annotations

import uuid

from pyspark.errors import UnsupportedOperationException
from pyspark.sql import SparkSession


class Folder:
    """A folder of a store that Spark writes to, through Hadoop's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path
        self.files = self._of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _of(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def lengths(self, name: str) -> dict[str, int]:
        """Length of each data file in a subfolder."""
        found = self.files.listStatus(self._of(f"{self.path}/{name}"))
        return {f.getPath().getName(): f.getLen() for f in found if not f.getPath().getName().startswith(("_", "."))}

    def whole(self, name: str, parts: list[str], head: str) -> None:
        """One file: a first line, then data files one after another; they go.

        The store joins them where it can (HDFS moves no data for it); where it can't, the driver's JVM copies them through a buffer of
        a few MB.
        """
        at = self._of(f"{self.path}/{name}")
        self.put(name, head)
        paths = [self._of(f"{self.path}/{p}") for p in parts]
        if not paths:
            return
        array = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Path"), len(paths))
        for i, p in enumerate(paths):
            array[i] = p
        try:
            self.files.concat(at, array)
        except UnsupportedOperationException:
            part = self._of(f"{self.path}/.{name}-{uuid.uuid4().hex}")
            out = self.files.create(part, False)
            try:
                for p in [at, *paths]:
                    stream = self.files.open(p)
                    try:
                        self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 22, False)
                    finally:
                        stream.close()
            finally:
                out.close()
            self.files.delete(at, False)
            self.files.rename(part, at)
            for p in paths:
                self.files.delete(p, False)

    def read(self, name: str) -> str | None:
        at = self._of(f"{self.path}/{name}")
        if not self.files.exists(at):
            return None
        stream = self.files.open(at)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """A file whole or not at all: written beside, then renamed; it takes the place of an earlier one."""
        part, at = self._of(f"{self.path}/.{name}-{uuid.uuid4().hex}"), self._of(f"{self.path}/{name}")
        stream = self.files.create(part, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self.files.rename(part, at):
            self.files.delete(at, False)
            if not self.files.rename(part, at):
                self.files.delete(part, False)

    def remove(self, name: str = "") -> None:
        self.files.delete(self._of(f"{self.path}/{name}".rstrip("/")), True)
