"""Whole-file operations on whatever file system a path names, through Hadoop's own client."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession


class Storage:
    """List, read, write and rename files of any Hadoop file system, from the driver."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self._conf), where

    def qualified(self, path: str) -> str:
        """`path` with its file system's scheme."""
        fs, where = self._at(path)
        return fs.makeQualified(where).toString()

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def names(self, path: str) -> list[str]:
        """Names of a folder's entries, in byte order; nothing below it."""
        fs, where = self._at(path)
        return sorted((s.getPath().getName() for s in fs.listStatus(where)), key=lambda x: x.encode("utf-8", "surrogatepass"))

    def stamp(self, path: str) -> tuple[int, int]:
        """Size and time of the last change of a file."""
        fs, where = self._at(path)
        status = fs.getFileStatus(where)
        return status.getLen(), status.getModificationTime()

    def is_dir(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where) and fs.getFileStatus(where).isDirectory()

    def make_dir(self, path: str) -> None:
        fs, where = self._at(path)
        fs.mkdirs(where)

    def delete(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)

    def head(self, path: str, n: int) -> bytes:
        """The first n bytes, or fewer if there are no more."""
        fs, where = self._at(path)
        stream, out = fs.open(where), bytearray()
        try:
            while len(out) < n and (b := stream.read()) >= 0:
                out.append(b)
        finally:
            stream.close()
        return bytes(out)

    def read(self, path: str) -> bytes:
        fs, where = self._at(path)
        stream = fs.open(where)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, path: str, parts: Iterable[bytes]) -> None:
        fs, where = self._at(path)
        stream = fs.create(where, True)
        try:
            for part in parts:
                stream.write(part)
        finally:
            stream.close()

    def rename(self, source: str, target: str) -> None:
        """Put `source` in `target`'s place."""
        (fs, a), (_, b) = self._at(source), self._at(target)
        if fs.getScheme() == "file":
            os.replace(a.toUri().getPath(), b.toUri().getPath())
            return
        self.replace(a, b)

    def replace(self, a, b) -> None:
        """Rename in one step, over what is there, where the file system can."""
        options = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename").getField("OVERWRITE")
        kinds = self._jvm.java.lang.reflect.Array.newInstance(options.getType(), 1)
        kinds[0] = options.get(None)
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(b.toUri(), self._conf).rename(a, b, kinds)

    def concatenate(self, path: str, parts: Iterable[str], tail: bytes = b"", head: bytes = b"") -> None:
        """`head`, the files `parts` one after another, and `tail`, as `path`; their bytes pass through the file system's client alone."""
        fs, where = self._at(path)
        copy = self._jvm.org.apache.hadoop.io.IOUtils.copyBytes
        stream = fs.create(where, True)
        try:
            if head:
                stream.write(head)
            for part in parts:
                own, at = self._at(part)
                source = own.open(at)
                try:
                    copy(source, stream, 4 << 20, False)
                finally:
                    source.close()
            if tail:
                stream.write(tail)
        finally:
            stream.close()

    def publish(self, path: str, parts: Iterable[bytes]) -> None:
        """Write beside `path` under a name of this attempt's own, then rename; on failure nothing stays."""
        self._published(path, lambda attempt: self.write(attempt, parts))

    def publish_files(self, path: str, files: Iterable[str], tail: bytes = b"", head: bytes = b"") -> None:
        """The same of files put together."""
        self._published(path, lambda attempt: self.concatenate(attempt, files, tail, head))

    def _published(self, path: str, write: Callable[[str], None]) -> None:
        attempt = temporary(path)
        try:
            write(attempt)
            self.rename(attempt, path)
        except BaseException:
            self.delete(attempt)
            raise


def temporary(path: str) -> str:
    return f"{path}.{os.getpid()}-{uuid.uuid4().hex[:8]}.tmp"
