"""Scanning a directory tree that all executors see."""

from __future__ import annotations

import json
import logging
import os
import re
import stat
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import glob_regex

log = logging.getLogger(__name__)
#: Folders at which the scan stops going down level by level and deals whole subtrees.
WANTED = 64

SNAPSHOT = "rel_path string, exists boolean, size long, mtime long, mode int, uid long, gid long, uname string, gname string, is_dir boolean, is_file boolean, is_symlink boolean, linkname string"


def _name(lookup, key: int) -> str:
    try:
        return lookup(key)[0]
    except (KeyError, AttributeError, TypeError):
        return str(key)


def inspect(path: str, rel: str) -> tuple:
    """One lstat as a snapshot row."""
    try:
        st = os.lstat(path)
        link = os.readlink(path) if stat.S_ISLNK(st.st_mode) else ""
    except (FileNotFoundError, NotADirectoryError, ProcessLookupError):
        return (rel, False, 0, 0, 0, 0, 0, "", "", False, False, False, "")
    try:
        import grp
        import pwd

        users, groups = pwd.getpwuid, grp.getgrgid
    except ImportError:
        users = groups = None
    d = stat.S_ISDIR(st.st_mode)
    return (rel, True, 0 if d else st.st_size, int(st.st_mtime), stat.S_IMODE(st.st_mode), st.st_uid, st.st_gid, _name(users, st.st_uid), _name(groups, st.st_gid), d, stat.S_ISREG(st.st_mode), stat.S_ISLNK(st.st_mode), link)


def walk(root: str, rel: str, deep: bool = True, left_out: Callable[[str], bool] = lambda rel: False) -> Iterator[tuple]:
    """Rows below a folder, names in order, links not followed. With deep=False only its own items.

    What is left out is neither given nor entered. A folder that can't be read, or is gone, is logged and passed over.
    """
    todo = [rel]
    while todo:
        at = todo.pop()
        try:
            with os.scandir(os.path.join(root, at) if at else root) as it:
                names = sorted(e.name for e in it)
        except (PermissionError, FileNotFoundError, NotADirectoryError) as e:
            log.warning("folder %r can't be read: %s", at, e)
            continue
        for n in names:
            r = f"{at}/{n}" if at else n
            if left_out(r):
                continue
            row = inspect(os.path.join(root, r), r)
            if not row[1]:
                continue
            yield row
            if deep and row[9]:
                todo.append(r)


class _Part(InputPartition):
    def __init__(self, rel: str, deep: bool):
        self.rel, self.deep = rel, deep


class _Reader(DataSourceReader):
    def __init__(self, root: str, skip: tuple[str, ...], exclude: list[str]):
        self.root, self.skip, self.exclude = root, skip, exclude

    def _rule(self) -> Callable[[str], bool]:
        """Whether a path is left out: an item of the root that belongs to the engine, or a match of a pattern."""
        tests = [re.compile(glob_regex(p)).search for p in self.exclude]
        return lambda rel: any(rel == s or rel.startswith((s + "/", s + ".")) for s in self.skip) or any(t(rel) for t in tests)

    def partitions(self):
        """Level by level each folder's own items, until there are WANTED folders: those are dealt as whole subtrees."""
        parts, level, rule = [], [""], self._rule()
        while level and len(level) < WANTED:
            parts += [_Part(rel, False) for rel in level]
            level = [row[0] for rel in level for row in walk(self.root, rel, False, rule) if row[9]]
        return parts + [_Part(rel, True) for rel in level]

    def read(self, partition):
        if not partition.rel:
            yield inspect(self.root, "")
        yield from walk(self.root, partition.rel, partition.deep, self._rule())


class FolderInventory(DataSource):
    """spark.read.format("fs_inventory").option("path", folder): one snapshot row for each item, the folder itself included.

    Options: skip, names of the root's items, comma-separated; exclude, a JSON list of glob patterns whose matches are neither given nor entered.
    """

    @classmethod
    def name(cls):
        return "fs_inventory"

    def schema(self):
        return SNAPSHOT

    def reader(self, schema):
        return _Reader(os.path.abspath(self.options["path"]), tuple(x for x in self.options.get("skip", "").split(",") if x), json.loads(self.options.get("exclude", "[]")))


def scan(spark: SparkSession, root: str, skip: tuple[str, ...] = (), exclude: Sequence[str] = ()) -> DataFrame:
    spark.dataSource.register(FolderInventory)
    return spark.read.format("fs_inventory").option("path", root).option("skip", ",".join(skip)).option("exclude", json.dumps(list(exclude))).load()


def probe(paths: DataFrame, root: str) -> DataFrame:
    """rel_path -> the present snapshot rows of just those paths."""
    import pandas as pd

    names = [c.split()[0] for c in SNAPSHOT.split(", ")]

    def look(frames):
        for f in frames:
            yield pd.DataFrame([inspect(os.path.join(root, r) if r else root, r) for r in f["rel_path"]], columns=names)

    return paths.select("rel_path").mapInPandas(look, SNAPSHOT)
