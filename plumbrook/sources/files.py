"""File operations on paths of any file system that Spark reaches, and packaged text resources."""

from __future__ import annotations

import importlib.resources
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class FileStatus:
    path: str
    name: str
    is_directory: bool
    size: int
    modified_ms: int


class Files:
    """String paths over Hadoop's file systems; runs on the driver."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def path(self, path: str) -> JavaObject:
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def system(self, path: str) -> JavaObject:
        return self.path(path).getFileSystem(self._conf)

    def qualified(self, path: str) -> str:
        return self.system(path).makeQualified(self.path(path)).toString()

    def exists(self, path: str) -> bool:
        return self.system(path).exists(self.path(path))

    def make_directories(self, path: str) -> bool:
        return self.system(path).mkdirs(self.path(path))

    def create_new(self, path: str) -> bool:
        """An empty file; False if there is one."""
        return self.system(path).createNewFile(self.path(path))

    def delete(self, path: str) -> bool:
        return self.system(path).delete(self.path(path), True)

    def read_bytes(self, path: str) -> bytes:
        stream = self.system(path).open(self.path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def read_text(self, path: str) -> str:
        return self.read_bytes(path).decode()

    def write_bytes(self, path: str, content: bytes) -> None:
        stream = self.system(path).create(self.path(path), True)
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()

    def write_text(self, path: str, content: str) -> None:
        self.write_bytes(path, content.encode())

    @staticmethod
    def _status(s: JavaObject) -> FileStatus:
        return FileStatus(s.getPath().toString(), s.getPath().getName(), s.isDirectory(), s.getLen(), s.getModificationTime())

    def status(self, path: str) -> FileStatus:
        return self._status(self.system(path).getFileStatus(self.path(path)))

    def children(self, path: str) -> list[FileStatus]:
        return sorted((self._status(s) for s in self.system(path).listStatus(self.path(path))), key=lambda s: s.path)

    def glob(self, pattern: str) -> list[FileStatus]:
        return sorted((self._status(s) for s in self.system(pattern).globStatus(self.path(pattern)) or []), key=lambda s: s.path)

    def walk(self, path: str) -> Iterator[FileStatus]:
        """All files below, without success marks and checksums."""
        for s in self.children(path):
            if s.is_directory:
                yield from self.walk(s.path)
            elif s.name != "_SUCCESS" and not s.name.endswith(".crc"):
                yield s

    def content_size(self, path: str) -> int:
        return self.system(path).getContentSummary(self.path(path)).getLength()

    def checksum(self, path: str) -> str | None:
        found = self.system(path).getFileChecksum(self.path(path))
        return found.toString() if found is not None else None


def resource_text(package: str, name: str) -> str:
    """A text packaged beside a module."""
    return importlib.resources.files(package).joinpath(name).read_text()


def resource_bytes(package: str, name: str) -> bytes | None:
    """Packaged bytes; None if there are none."""
    found = importlib.resources.files(package).joinpath(name)
    return found.read_bytes() if found.is_file() else None


@contextmanager
def using(resource: Any) -> Iterator[Any]:
    """Closes the resource; an error while closing doesn't hide one from the body."""
    try:
        yield resource
    except BaseException as e:
        try:
            resource.close()
        except Exception as late:  # noqa: BLE001
            e.add_note(f"closing failed too: {late}")
        raise
    resource.close()
