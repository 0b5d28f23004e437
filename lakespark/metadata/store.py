"""Folders and small files of the warehouse, with a create-if-absent that only one writer wins."""

from __future__ import annotations

import os
import shutil
import uuid
from functools import lru_cache


class LocalStore:
    """Paths of this machine (or of a mounted shared folder)."""

    def read(self, path: str) -> str:
        with open(path, encoding="utf-8") as f:
            return f.read()

    def write(self, path: str, text: str) -> None:
        """Replaces a file as a whole."""
        temporary = self._temporary(path, text)
        os.replace(temporary, path)

    def create(self, path: str, text: str) -> bool:
        """False if the file is there already; a hard link either takes the name with all content, or fails."""
        temporary = self._temporary(path, text)
        try:
            os.link(temporary, path)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(temporary)

    def _temporary(self, path: str, text: str) -> str:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        temporary = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}.tmp"
        with open(temporary, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        return temporary

    def exists(self, path: str) -> bool:
        return os.path.exists(path)

    def names(self, path: str) -> list[str]:
        try:
            return sorted(n for n in os.listdir(path) if not n.startswith("."))
        except FileNotFoundError:
            return []

    def sizes(self, path: str) -> dict[str, int]:
        """Relative path and bytes of every data file below a folder."""
        found = {}
        for top, _, names in os.walk(path):
            for n in names:
                if not n.startswith((".", "_")):
                    full = os.path.join(top, n)
                    found[os.path.relpath(full, path)] = os.path.getsize(full)
        return found

    def times(self, path: str) -> dict[str, int]:
        """Relative path and time of writing, in milliseconds, of every file below a folder."""
        found = {}
        for top, _, names in os.walk(path):
            for n in names:
                full = os.path.join(top, n)
                found[os.path.relpath(full, path)] = int(os.path.getmtime(full) * 1000)
        return found

    def move(self, source: str, target: str) -> None:
        os.makedirs(os.path.dirname(target), exist_ok=True)
        os.rename(source, target)

    def delete(self, path: str) -> None:
        if os.path.isdir(path):
            shutil.rmtree(path)
        elif os.path.exists(path):
            os.unlink(path)

    def make(self, path: str) -> None:
        os.makedirs(path, exist_ok=True)


class HadoopStore:
    """Any file system that Spark reads.  ``create`` writes aside and then takes the name with all content at once, by a
    rename that doesn't overwrite (atomic on HDFS), or a hard link on local disks."""

    def __init__(self, spark):
        self._jvm, self._conf, self._gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _of(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def read(self, path: str) -> str:
        fs, p = self._of(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        self._put(path, text, True)

    def create(self, path: str, text: str) -> bool:
        from py4j.protocol import Py4JJavaError

        fs, p = self._of(path)
        if fs.exists(p):
            return False
        aside = self._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}.tmp")
        self._put(aside.toString(), text, False)
        try:
            if fs.getScheme() == "file":
                file = lambda x: self._jvm.java.nio.file.Path.of(fs.makeQualified(x).toUri().getPath(), self._gateway.new_array(self._jvm.java.lang.String, 0))
                self._jvm.java.nio.file.Files.createLink(file(p), file(aside))
            else:
                once = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                once[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self._conf).rename(aside, p, once)
            return True
        except Py4JJavaError:
            if fs.exists(p):
                return False
            raise
        finally:
            fs.delete(aside, False)

    def _put(self, path: str, text: str, over: bool) -> None:
        fs, p = self._of(path)
        stream = fs.create(p, over)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def exists(self, path: str) -> bool:
        fs, p = self._of(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._of(path)
        return sorted(n for s in fs.listStatus(p) if not (n := s.getPath().getName()).startswith(".")) if fs.exists(p) else []

    def sizes(self, path: str) -> dict[str, int]:
        fs, p = self._of(path)
        found, root = {}, fs.makeQualified(p).toString()
        files = fs.listFiles(p, True) if fs.exists(p) else None
        while files is not None and files.hasNext():
            s = files.next()
            if not s.getPath().getName().startswith((".", "_")):
                found[s.getPath().toString()[len(root) + 1 :]] = s.getLen()
        return found

    def times(self, path: str) -> dict[str, int]:
        fs, p = self._of(path)
        found, root = {}, fs.makeQualified(p).toString()
        files = fs.listFiles(p, True) if fs.exists(p) else None
        while files is not None and files.hasNext():
            s = files.next()
            found[s.getPath().toString()[len(root) + 1 :]] = s.getModificationTime()
        return found

    def move(self, source: str, target: str) -> None:
        fs, p = self._of(source)
        _, q = self._of(target)
        fs.mkdirs(q.getParent())
        if not fs.rename(p, q):
            raise OSError(f"{source} could not be moved to {target}")

    def delete(self, path: str) -> None:
        fs, p = self._of(path)
        fs.delete(p, True)

    def make(self, path: str) -> None:
        fs, p = self._of(path)
        fs.mkdirs(p)


@lru_cache(maxsize=1)
def _local() -> LocalStore:
    return LocalStore()


def store_for(spark, warehouse: str):
    """The store and the plain form of a warehouse's path."""
    if "://" not in warehouse and not warehouse.startswith("file:"):
        return _local(), os.path.abspath(warehouse)
    if warehouse.startswith("file:"):
        return _local(), "/" + warehouse.removeprefix("file:").lstrip("/")
    return HadoopStore(spark), warehouse.rstrip("/")
