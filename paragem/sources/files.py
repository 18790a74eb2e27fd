"""Small files of the shared storage, through the file system that Spark itself uses for a path."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    path: str
    is_folder: bool
    bytes: int
    #: Milliseconds since 1970.
    changed: int


class Files:
    """The file system of ``path``; every path given to it must lie there."""

    def __init__(self, spark: SparkSession, path: str):
        self._context = spark.sparkContext
        self._conf = self._context._jsc.hadoopConfiguration()
        self._fs: JavaObject = self._path(path).getFileSystem(self._conf)

    def _path(self, path: str) -> JavaObject:
        return self._context._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def entries(self, path: str) -> Iterator[Entry]:
        """What lies in a folder, by name; nothing where there is no folder."""
        if self.exists(path):
            found = [(s.getPath(), s) for s in self._fs.listStatus(self._path(path))]
            for own, status in sorted(found, key=lambda x: x[0].getName()):
                yield Entry(
                    own.getName(), own.toString(), status.isDirectory(), status.getLen(), status.getModificationTime()
                )

    def read_text(self, path: str) -> str:
        """A file of a few kilobytes."""
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self._context._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def head(self, path: str, size: int) -> bytes:
        """The first few bytes of a file."""
        stream = self._fs.open(self._path(path))
        try:
            found = [stream.read() for _ in range(size)]
        finally:
            stream.close()
        return bytes(b for b in found if b >= 0)

    def write_new(self, path: str, text: str) -> None:
        """Write beside ``path`` and rename, so that a reader sees the whole file or none; an error if it exists."""
        if self.exists(path):
            raise FileExistsError(path)
        folder, name = path.rsplit("/", 1)
        draft = f"{folder}/.{name}.draft"
        self._write(draft, [text.encode()])
        self.rename(draft, path)

    def _write(self, path: str, chunks: list[bytes], parts: list[str] = ()) -> None:
        stream = self._fs.create(self._path(path), True)
        try:
            for chunk in chunks:
                stream.write(bytearray(chunk))
            for part in parts:
                source = self._fs.open(self._path(part))
                try:
                    self._context._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, stream, COPIED, False)
                finally:
                    source.close()
        finally:
            stream.close()

    def join(self, path: str, head: bytes, parts: list[str]) -> None:
        """One file at ``path`` of ``head`` and the files ``parts`` in order, seen only once it is whole.

        A single file has a single writer; it holds ``COPIED`` bytes at a time.
        """
        folder, name = path.rsplit("/", 1)
        draft = f"{folder}/.{name}.draft"
        self._write(draft, [head], parts)
        self.rename(draft, path)

    def rename(self, old: str, new: str) -> None:
        if not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"cannot rename {old} to {new}")

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


#: Bytes of the buffer when files are joined.
COPIED = 4 << 20
