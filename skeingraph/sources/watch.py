"""A source tree as a stream: whenever anything in it differs, one batch lists the whole tree, and the difference to the last listing is what changed.

The driver only digests names, times and sizes to see whether there is anything new; the listing is read by tasks,
a top folder each. The last listing lies beside the checkpoint, one table a batch, so a batch that comes again says the
same, and files of older time, deletions and moves are seen as well as later ones.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .project import EXCLUDED

LISTING = "path string, mtime double, size long"


def listing(root: str, extensions: frozenset[str], top: str | None = None) -> Iterator[tuple[str, float, int]]:
    """Path below root, time and size of every file with one of the extensions, outside hidden and excluded folders, in order.

    top: a folder of the root, to list that one alone; an empty name: only the files in the root itself.
    """
    for here, folders, names in os.walk(root if not top else os.path.join(root, top)):
        folders[:] = sorted(f for f in folders if not f.startswith(".") and f not in EXCLUDED) if top != "" else []
        for name in sorted(names):
            if os.path.splitext(name)[1].lower() in extensions:
                path = os.path.join(here, name)
                try:
                    s = os.stat(path, follow_symlinks=False)
                except OSError:  # gone since it was listed
                    continue
                yield os.path.relpath(path, root), s.st_mtime, s.st_size


class Folder(InputPartition):
    def __init__(self, top: str):
        self.top = top


class TreeReader(DataSourceStreamReader):
    """An offset is the number of a listing and its digest; a batch is the listing as it is when the batch runs."""

    def __init__(self, root: str, extensions: frozenset[str]):
        self.root, self.extensions, self.at = root, extensions, None

    def initialOffset(self) -> dict:
        return {"listing": 0, "digest": ""}

    def latestOffset(self) -> dict:
        h = hashlib.sha256()
        for row in listing(self.root, self.extensions):
            h.update(repr(row).encode())
        if self.at is None or self.at["digest"] != h.hexdigest():
            # after a restart the number goes on from the time, as the reader does not see the log
            self.at = {"listing": os.stat(self.root).st_mtime_ns if self.at is None else self.at["listing"] + 1, "digest": h.hexdigest()}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        tops = (d.name for d in os.scandir(self.root) if d.is_dir(follow_symlinks=False) and not d.name.startswith(".") and d.name not in EXCLUDED)
        return [Folder(""), *map(Folder, sorted(tops))]

    def read(self, partition: Folder) -> Iterator[tuple]:
        yield from listing(self.root, self.extensions, partition.top)


class Tree(DataSource):
    """Format `source_tree`; options path (a folder that driver and executors see) and extensions (with commas between)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return LISTING

    def streamReader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], frozenset(self.options["extensions"].split(",")))


def tree(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """path, mtime, size: a stream of whole listings, one a batch."""
    spark.dataSource.register(Tree)
    return spark.readStream.format("source_tree").option("path", root).option("extensions", ",".join(sorted(extensions))).load()
