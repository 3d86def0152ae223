"""A listing of our own: log folders walked in tasks, as rows.

Spark's listing leaves out names that begin with ``_`` or ``.`` and follows links; log folders need
the opposite on both. Here links are never followed below a root (a root itself may be one), every
name counts, and a folder that can't be read is passed over.

A walk starts with the roots as rows. A task goes through the folders that it was given until it
has seen ``WALK`` entries; folders that are left are rows of the next round, dealt over all tasks.
A small tree takes one round, a large one fans out, and nothing passes through the driver.

Local folders are read directly, others by whatever store pyarrow opens (a URI). A name that isn't
UTF-8 is passed over.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import once

#: Entries that a task looks at before it hands on the folders that are left.
WALK = 20_000
FOUND = "root_ord int, file string, folder boolean, size long, mtime_ns long"


@dataclass(frozen=True)
class Entry:
    path: str
    folder: bool
    size: int
    mtime_ns: int


def local(path: str) -> str | None:
    """The path on this machine, if it is one."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


def store(path: str):
    """The store of a path and the path within it."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), at) if (at := local(path)) is not None else fs.FileSystem.from_uri(path)


def entries(folder: str) -> Iterator[Entry]:
    """Files and folders in a folder, not links; none if it can't be read."""
    at = local(folder)
    if at is None:
        from pyarrow import fs

        where, inner = store(folder)
        prefix = folder[: len(folder.rstrip("/")) - len(inner.rstrip("/"))]
        for f in where.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
            if f.type in (fs.FileType.File, fs.FileType.Directory):
                yield Entry(prefix + f.path, f.type == fs.FileType.Directory, f.size or 0, f.mtime_ns or 0)
        return
    try:
        found = os.scandir(at)
    except NotADirectoryError:  # a root may be a file
        stat = os.stat(at)
        yield Entry(at, False, stat.st_size, stat.st_mtime_ns)
        return
    except OSError:
        return
    with found:
        for e in found:
            try:
                is_folder = e.is_dir(follow_symlinks=False)
                if is_folder or e.is_file(follow_symlinks=False):
                    e.path.encode()
                    stat = e.stat(follow_symlinks=False)
                    yield Entry(e.path, is_folder, stat.st_size, stat.st_mtime_ns)
            except (OSError, UnicodeEncodeError):
                continue


def patterns(glob: str) -> list[str]:
    """A glob's alternatives in braces, one by one. A name that starts with its only dot has no extension."""
    head, _, rest = glob.partition("{")
    inner, _, tail = rest.partition("}")
    each = [f"{head}{p}{tail}" for p in inner.split(",")] if rest else [glob]
    return [f"?{p}" if p.startswith("*.") else p for p in each]


def wanted(path: str, globs: list[str]) -> bool:
    name = path.rpartition("/")[2]
    return any(fnmatchcase(name, g) for g in globs)


def walked(folders: Iterator[str], globs: list[str], recursive: bool = True, most: int | None = None) -> Iterator[Entry]:
    """Files that a glob matches, under the folders; after ``most`` entries the folders that are left."""
    waiting, seen = deque(folders), 0
    while waiting:
        folder = waiting.popleft()
        if most is not None and seen >= most:
            yield Entry(folder, True, 0, 0)
            continue
        for e in entries(folder):
            seen += 1
            if e.folder:
                if recursive:
                    waiting.append(e.path)
            elif wanted(e.path, globs):
                yield e


def files(spark: SparkSession, roots: list[str], glob: str, recursive: bool = True, walk: int = WALK) -> DataFrame:
    """root_ord (the root's place), file, size and mtime_ns of the files under the roots whose names match."""
    globs, parts = patterns(glob), []

    def run(batches):
        for batch in batches:
            roots_of: dict[int, list[str]] = {}
            for k, folder in zip(batch.column("root_ord").to_pylist(), batch.column("file").to_pylist()):
                roots_of.setdefault(k, []).append(folder)
            for k, folders in roots_of.items():
                found = list(walked(iter(folders), globs, recursive, walk))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(found), pa.int32()), pa.array([e.path for e in found], pa.string()), pa.array([e.folder for e in found], pa.bool_()), pa.array([e.size for e in found], pa.int64()), pa.array([e.mtime_ns for e in found], pa.int64())],
                    names=["root_ord", "file", "folder", "size", "mtime_ns"],
                )

    left = spark.createDataFrame([(k, r.rstrip("/") or "/") for k, r in enumerate(roots)], "root_ord int, file string")
    while True:
        found = once(left.mapInArrow(run, FOUND))
        parts.append(found.filter("NOT folder").drop("folder"))
        left = found.filter("folder").select("root_ord", "file")
        if left.isEmpty():
            break
        left = left.repartition("file")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
