"""Small files in any store that Hadoop reads: the catalog and the manifests."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Store:
    """Text files, folders and listings below a root URI (file:, s3a:, gs:, abfss:, ...)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def uri(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.uri(*parts))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def exists(self, *parts: str) -> bool:
        return self._fs().exists(self._path(*parts))

    def names(self, *parts: str) -> list[str]:
        """Names in a folder; none if it does not exist."""
        if not self.exists(*parts):
            return []
        return sorted(s.getPath().getName() for s in self._fs().listStatus(self._path(*parts)))

    def read(self, *parts: str) -> str:
        stream = self._fs().open(self._path(*parts))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def read_json(self, *parts: str):
        return json.loads(self.read(*parts))

    def create(self, text: str, *parts: str, overwrite: bool = False) -> bool:
        """Write a file; False if it is there already and may not be replaced. A reader sees all of it or nothing."""
        target = self._path(*parts)
        fs = self._fs()
        if not overwrite and fs.exists(target):
            return False
        own = self._path(*parts[:-1], f".{parts[-1]}.{self._jvm.java.util.UUID.randomUUID().toString()}")
        out = fs.create(own, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        if overwrite:
            fs.delete(target, False)
        if not fs.rename(own, target):
            fs.delete(own, False)
            return False
        return True

    def write_bytes(self, data: bytes, *parts: str) -> None:
        out = self._fs().create(self._path(*parts), True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def delete(self, *parts: str) -> bool:
        return self._fs().delete(self._path(*parts), True)

    def copy(self, source: list[str], target: list[str], other: Store | None = None) -> None:
        to = other or self
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs(), self._path(*source), to._fs(), to._path(*target), False, self._conf)

    def zipped(self, folder: list[str], target: list[str], suffix: str = ".parquet") -> int:
        """A ZIP of the files below a folder whose names end so, copied stream by stream; returns how many."""
        fs, top, n = self._fs(), self._path(*folder), 0
        out = self._jvm.java.util.zip.ZipOutputStream(fs.create(self._path(*target), True))
        try:
            files = fs.listFiles(top, True)
            while files.hasNext():
                path = files.next().getPath()
                if path.getName().endswith(suffix):
                    out.putNextEntry(self._jvm.java.util.zip.ZipEntry(top.toUri().relativize(path.toUri()).getPath().split(f"/{folder[-1]}/")[-1]))
                    stream = fs.open(path)
                    self._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
                    stream.close()
                    out.closeEntry()
                    n += 1
        finally:
            out.close()
        return n

    def delete_on_exit(self, *parts: str) -> None:
        """Remove a folder when the driver's JVM ends."""
        self._fs().deleteOnExit(self._path(*parts))

    def swap(self, value: dict, version: int, *folder: str) -> bool:
        """Make ``value`` the version after ``version`` of a folder's state; False if another writer was first."""
        done = self.create(json.dumps(value), *folder, f"state-{version + 1:012d}.json")
        if done:
            for old in [n for n in self.names(*folder) if n.startswith("state-")][:-5]:
                self.delete(*folder, old)
        return done

    def state(self, *folder: str) -> tuple[int, dict | None]:
        """The newest version of a folder's state, and what it says."""
        versions = [n for n in self.names(*folder) if n.startswith("state-")]
        return (int(versions[-1][6:-5]), self.read_json(*folder, versions[-1])) if versions else (0, None)

    def size(self, *parts: str) -> int:
        return self._fs().getContentSummary(self._path(*parts)).getLength() if self.exists(*parts) else 0
