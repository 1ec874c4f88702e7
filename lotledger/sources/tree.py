"""A folder tree as a table, through a Python data source whose partitions list subtrees.

``binaryFile`` listings know files only. Here folders are rows of their own, empty ones too, and
what can't be taken in is a row with its ``issue``: links (never followed), entries without
readable status, names that aren't UTF-8, and folders that can't be listed (a second row beside the
one that their parent gives them). The tree must be mounted at one path on all machines.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ENTRY = "path string, name string, is_dir boolean, size bigint, mtime_ns bigint, issue string"
PARTITIONS = 64


def _utf8(text: str) -> str:
    return text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def children(root: str, folder: str) -> Iterator[tuple]:
    """Rows of the entries of a folder, by name. ``folder`` is relative, the root itself empty."""
    try:
        with os.scandir(os.path.join(root, folder)) as found:
            entries = sorted(found, key=lambda e: e.name)
    except OSError:
        yield _utf8(folder), _utf8(os.path.basename(folder)), True, None, None, "folder can't be listed"
        return
    for e in entries:
        path = f"{folder}/{e.name}" if folder else e.name
        issue = "link" if e.is_symlink() else None
        is_dir, size, mtime = False, None, None
        if issue is None:
            try:
                is_dir, status = e.is_dir(follow_symlinks=False), e.stat(follow_symlinks=False)
                size, mtime = 0 if is_dir else status.st_size, status.st_mtime_ns
            except OSError:
                issue = "unreadable"
        if _utf8(path) != path:
            issue = issue or "name isn't UTF-8"
        yield _utf8(path), _utf8(e.name), is_dir, size, mtime, issue


def folders_in(rows: Iterator[tuple] | list[tuple]) -> list[str]:
    """The folders that can be gone into."""
    return [path for path, _, is_dir, _, _, issue in rows if is_dir and issue is None]


@dataclass
class Subtree(InputPartition):
    """A folder with all below it, or its own entries alone."""

    folder: str
    deep: bool


class TreeReader(DataSourceReader):
    def __init__(self, root: str, wanted: int):
        self.root, self.wanted = root, wanted

    def partitions(self) -> list[Subtree]:
        """Folders from the top are opened until there are ``wanted`` subtrees; at most as many are
        opened, so a tree that is one long chain ends as one subtree."""
        if not os.path.isdir(self.root):
            raise ValueError(f"{self.root!r} is no folder that can be reached")
        opened, todo = [], deque([""])
        while todo and len(todo) < self.wanted and len(opened) < self.wanted:
            opened.append(todo.popleft())
            todo.extend(folders_in(children(self.root, opened[-1])))
        return [Subtree(f, False) for f in opened] + [Subtree(f, True) for f in todo]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        todo = [partition.folder]
        while todo:
            rows = list(children(self.root, todo.pop()))
            yield from rows
            if partition.deep:
                todo += reversed(folders_in(rows))


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_tree"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], int(self.options.get("partitions", PARTITIONS)))


def read_tree(spark: SparkSession, root: str, partitions: int = PARTITIONS) -> DataFrame:
    """Every entry below ``root`` with its ``issue``; rows without one are entries for the crawl."""
    spark.dataSource.register(TreeSource)
    return spark.read.format(TreeSource.name()).option("path", root).option("partitions", partitions).load()
