"""Source trees as a Python data source: partitioned listing, all names, ignore files at every depth, links by their canonical place.

The driver lists only as many folders as make enough parts, each with the ignore rules that hold there; tasks walk on from their folders, and
compose the rules on the way down. Tasks read files through the operating system, so the tree has to be mounted wherever executors run; for other
stores there is ``files.scan_files``.

Defined results: hidden names are left out, names that begin with an underscore aren't; a folder that is ignored is never entered, so nothing in it can
be included again; a link is followed nowhere: what it leads to is found in its own place if that is below the root, and isn't part of the tree if it isn't, so cycles
end; a folder that can't be listed is a row with an error and without an extension.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import fixed
from ..session import ship
from .files import MAX_BYTES, ignore_rules, languages

SCHEMA = "file_path string, ext string, size_bytes long, mtime timestamp, source string, error string"
Rules = list[tuple[bool, str]]


class Folders(InputPartition):
    """Folders to walk (whole: with all below them) and the rules that hold in each."""

    def __init__(self, folders: list[tuple[str, Rules, bool]]):
        super().__init__(folders)
        self.folders = folders


class Reader(DataSourceReader):
    def __init__(self, root: str, options: dict[str, str]):
        self.root = os.path.realpath(root.removeprefix("file://"))
        self.max_bytes = int(options.get("maxbytes", MAX_BYTES))
        self.gitignore = options.get("gitignore", "true") == "true"
        self.parts = int(options.get("parts", 64))
        self.extensions = {e for own in fixed.EXTENSIONS.values() for e in own}
        self.compiled: dict[str, re.Pattern] = {}

    def _ignored(self, path: str, rules: Rules) -> bool:
        for out, pattern in reversed(rules):  # the last that matches decides
            if pattern not in self.compiled:
                self.compiled[pattern] = re.compile(pattern)
            if self.compiled[pattern].search(path):
                return out
        return False

    def _list(self, folder: str, rules: Rules) -> tuple[list[str], list[tuple], Rules]:
        """The folders and the rows of the files directly in a folder, and the rules that hold in it."""
        try:
            entries = sorted(os.scandir(os.path.join(self.root, folder)), key=lambda e: e.name)
        except OSError as problem:
            return [], [(folder or ".", None, None, None, None, f"unreadable folder: {problem.strerror}")], rules
        for e in entries:
            if self.gitignore and e.name == ".gitignore" and e.is_file(follow_symlinks=False):
                with open(e.path, encoding="utf-8", errors="replace") as text:
                    rules = [*rules, *ignore_rules(text.read(), folder)]
        folders, rows = [], []
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            if e.name.startswith(".") or e.is_symlink():
                continue
            if e.is_dir():
                if not self._ignored(path + "/", rules):
                    folders.append(path)
                continue
            ext = e.name.rpartition(".")[2] if "." in e.name.lstrip(".") else ""
            if ext in self.extensions and not self._ignored(path, rules):
                rows.append(self._row(path, ext, e))
        return folders, rows, rules

    def _row(self, path: str, ext: str, entry: os.DirEntry) -> tuple:
        size = mtime = source = error = None
        try:
            facts = entry.stat()
            size, mtime = facts.st_size, datetime.fromtimestamp(facts.st_mtime, timezone.utc)
            if size > self.max_bytes:
                error = "too large"
            else:
                with open(entry.path, "rb") as data:
                    source = data.read().decode("utf-8")
        except UnicodeDecodeError:
            error = "not UTF-8"
        except OSError as problem:
            error = f"unreadable file: {problem.strerror}"
        return path, ext, size, mtime, source, error

    def partitions(self) -> list[Folders]:
        """Breadth first until there are enough folders; those that were listed on the way are walked for their files only."""
        done: list[tuple[str, Rules, bool]] = []
        queue: list[tuple[str, Rules]] = [("", [])]
        while queue and len(queue) < self.parts:
            folder, rules = queue.pop(0)
            inner, own = self._names(folder, rules)
            done.append((folder, rules, False))
            queue += [(f, own) for f in inner]
        units = done + [(f, r, True) for f, r in queue]
        return [Folders(units[k :: self.parts]) for k in range(min(self.parts, len(units)))]

    def _names(self, folder: str, rules: Rules) -> tuple[list[str], Rules]:
        size, self.max_bytes = self.max_bytes, -1  # the driver reads no files
        try:
            inner, _, own = self._list(folder, rules)
        finally:
            self.max_bytes = size
        return inner, own

    def read(self, partition: Folders) -> Iterator[tuple]:
        stack = list(partition.folders)
        while stack:
            folder, rules, whole = stack.pop()
            inner, rows, own = self._list(folder, rules)
            yield from rows
            if whole:
                stack += [(f, own, True) for f in inner]


class SourceTree(DataSource):
    """``spark.read.format("source_tree").load(root)``; options maxBytes, gitignore, parts."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], {k.lower(): v for k, v in self.options.items()})


def scan_tree(spark: SparkSession, root: str, *, ignore: list[str] = (), gitignore: bool = True, max_bytes: int = MAX_BYTES) -> DataFrame:
    """What ``files.scan_files`` returns, of a mounted tree, with all names; folders that can't be listed are rows without a language."""
    ship(spark)
    spark.dataSource.register(SourceTree)
    rows = spark.read.format("source_tree").option("maxBytes", str(max_bytes)).option("gitignore", str(gitignore).lower()).load(root)
    for pattern in ignore:
        rows = rows.where(~F.col("file_path").rlike(pattern))
    found = rows.join(F.broadcast(languages(spark)), "ext", "left")
    return found.select("file_path", "ext", "language", "has_patterns", "size_bytes", "mtime", "source", "error")
