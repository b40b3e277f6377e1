"""What lies below some paths, and reads that are sure of what they read.

Every entry is listed, whatever its name: hidden files are the ones that hold
secrets. Local trees are walked on the driver, up to the entries that the limits
allow; files are opened in tasks, without following links, and must be the ones
that were listed, before and after they are read. Paths of other stores are
listed by their Hadoop file system.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sieveline.functions import fixed
from sieveline.functions.fixed import LIMITS

from . import archives

#: Bytes of files that one task reads, about.
TASK_BYTES = 256 << 20
CONTENTS = "path string, length long, content binary, reason string"


@dataclass
class Found:
    """A listing: files in scan order, what else there is, and what could not be looked at."""

    files: list[tuple] = field(default_factory=list)  # path, size, device, inode, time, reason
    others: list[tuple[str, str]] = field(default_factory=list)  # path, kind: link, vcs, special, directory, empty, too_deep
    errors: list[tuple[str, str]] = field(default_factory=list)  # code, what went wrong
    cut: bool = False  # more entries than the limits allow


def plain(path: str) -> str:
    """A local path without its scheme."""
    return path[5:] if path.startswith("file:/") and not path.startswith("file://") else path[7:] if path.startswith("file:///") else path


def is_local(path: str) -> bool:
    return "://" not in path or path.startswith("file:///")


def has_stream(path: str) -> bool:
    """Whether a Windows path names an alternate stream: a colon anywhere but after a drive's letter."""
    rest = path[2:] if path[1:2] == ":" and path[:1].isalpha() else path
    return ":" in rest


def within(path: str, root: str) -> bool:
    """Whether a path is its root or lies below it, once links and dots are resolved."""
    inner, outer = os.path.realpath(path), os.path.realpath(root)
    return inner == outer or inner.startswith(outer.rstrip(os.sep) + os.sep)


def _local(path: str) -> tuple:
    """(path, mode, size, device, inode, time) of a local path."""
    s = os.lstat(path)
    return path, s.st_mode, s.st_size, s.st_dev, s.st_ino, s.st_mtime_ns


def _entries(folder: str) -> list[tuple]:
    """The same of all that a local folder holds."""
    with os.scandir(folder) as found:
        names = sorted((e.name for e in found), key=lambda n: (n.casefold(), n))
    return [_local(os.path.join(folder, n)) for n in names]


def _remote(spark: SparkSession) -> tuple[Callable, Callable]:
    """The same two functions for paths that only Hadoop's file systems know."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def row(s) -> tuple:
        kind = stat.S_IFLNK if s.isSymlink() else stat.S_IFDIR if s.isDirectory() else stat.S_IFREG
        return s.getPath().toString(), kind, s.getLen(), 0, 0, s.getModificationTime()

    def one(path: str) -> tuple:
        from py4j.protocol import Py4JJavaError

        p = jvm.org.apache.hadoop.fs.Path(path)
        try:
            return row(p.getFileSystem(conf).getFileStatus(p))
        except Py4JJavaError as e:
            raise OSError(path) from e

    def within(path: str) -> list[tuple]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return sorted((row(s) for s in p.getFileSystem(conf).listStatus(p)), key=lambda r: (r[0].casefold(), r[0]))

    return one, within


def listing(spark: SparkSession, *paths: str, limits: dict = LIMITS) -> Found:
    """All that lies below the paths, in order of names without regard to case; files beyond a budget have a reason.

    Links are not followed, version-control folders not entered. A path that
    can't be read is an error, not an end.
    """
    out, seen, files, size = Found(), 0, 0, 0
    for path in paths:
        local = is_local(path)
        one, within = (_local, _entries) if local else _remote(spark)
        try:
            top = one(os.path.abspath(plain(path)) if local else path)
        except OSError as e:
            out.errors.append(("path_unavailable", type(e).__name__))
            continue
        todo = [(top, 0)]
        while todo and not out.cut:
            (at, mode, length, device, inode, time), depth = todo.pop()
            name = at.rstrip("/").rsplit("/", 1)[-1]
            if stat.S_ISLNK(mode):
                out.others.append((at, "link"))
            elif stat.S_ISDIR(mode):
                if name.casefold() in fixed.VCS_DIRECTORIES:
                    out.others.append((at, "vcs"))
                elif depth > limits["max_directory_depth"]:
                    out.others.append((at, "too_deep"))
                else:
                    try:
                        inner = within(at)
                    except OSError as e:
                        out.errors.append(("directory_unreadable", type(e).__name__))
                        continue
                    seen += len(inner)
                    if seen > limits["max_files"]:
                        out.cut = True
                        break
                    if depth == 0 or not inner:
                        out.others.append((at, "directory" if inner else "empty"))
                    todo += [(x, depth + 1) for x in reversed(inner)]
            elif stat.S_ISREG(mode):
                files, size = files + 1, size + length
                reason = "file_count_limit" if files > limits["max_files"] else "total_size_limit" if size > limits["max_total_bytes"] else "file_size_limit" if length > limits["max_file_bytes"] else None
                out.files.append((at, length, device, inode, time, reason))
            else:
                out.others.append((at, "special"))
    return out


def _same(s: os.stat_result, size: int, device: int, inode: int, time: int) -> bool:
    return stat.S_ISREG(s.st_mode) and (s.st_size, s.st_dev, s.st_ino, s.st_mtime_ns) == (size, device, inode, time)


def read_verified(path: str, size: int, device: int, inode: int, time: int, most: int) -> tuple[bytes | None, str | None]:
    """(content, reason) of a listed file: opened without following a link, the same file before and after."""
    try:
        handle = os.open(path, os.O_RDONLY | os.O_NOFOLLOW | os.O_CLOEXEC | os.O_NONBLOCK)
        with os.fdopen(handle, "rb") as f:
            if not _same(os.fstat(f.fileno()), size, device, inode, time):
                return None, "file_identity_changed_before_read"
            data = f.read(most + 1)
            if len(data) > most:
                return None, "file_size_limit"
            after = _same(os.fstat(f.fileno()), size, device, inode, time) and _same(os.lstat(path), size, device, inode, time)
            return data, None if after and len(data) == size else "file_changed_during_scan"
    except OSError:
        return None, "read_error"


def _read_remote(path: str, most: int) -> tuple[bytes | None, str | None]:
    from pyarrow import fs

    try:
        store, inner = fs.FileSystem.from_uri(path)
        with store.open_input_stream(inner) as f:
            data = f.read(most + 1)
    except (OSError, pa.ArrowException):
        return None, "read_error"
    return (None, "file_size_limit") if len(data) > most else (data, None)


def expansion_budgets(spark: SparkSession, found: Found, limits: dict = LIMITS) -> dict[str, int]:
    """What each local archive may expand to: what those before it in the listing leave of the scan's budget, by the sizes that they declare."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            paths, sizes = [], []
            for path, size, device, inode, time in zip(*(c.to_pylist() for c in part.columns), strict=True):
                try:
                    with open(path, "rb") as f:
                        if f.read(2) != b"PK":
                            continue
                except OSError:
                    continue
                data, _ = read_verified(path, size, int(device), int(inode), time, limits["max_file_bytes"])
                if n := archives.declared(data or b"", limits["max_archive_entries"]):
                    paths.append(path)
                    sizes.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "size"])

    own = [(p, n, str(d), str(i), t) for p, n, d, i, t, r in found.files if not r and is_local(p)]
    rows = spark.createDataFrame(own, "path string, size long, device string, inode string, time long")
    sizes = {r.path: r.size for r in rows.repartition(max(1, min(len(own), spark.sparkContext.defaultParallelism))).mapInArrow(read, "path string, size long").collect()}
    left, out = limits["max_archive_expanded_bytes"], {}
    for path, *_ in found.files:
        if path in sizes:
            out[path] = max(0, left)
            left -= sizes[path]
    return out


def contents(spark: SparkSession, found: Found, limits: dict = LIMITS) -> DataFrame:
    """A row for each listed file: path, length, content, reason (why it was not read, or may not be what it was).

    Spark's own reader takes files of other stores, but leaves out names that
    begin with a dot or a line; those are read in tasks by Arrow's file systems.
    """
    most = limits["max_file_bytes"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for path, size, device, inode, time, reason in zip(*(c.to_pylist() for c in part.columns), strict=True):
                data = None
                if not reason:
                    data, reason = read_verified(path, size, int(device), int(inode), time, most) if is_local(path) else _read_remote(path, most)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([data], pa.binary()), pa.array([reason], pa.string())], names=["path", "length", "content", "reason"])

    own = [f for f in found.files if f[-1] or is_local(f[0]) or f[0].rsplit("/", 1)[-1][:1] in "._"]
    rows = spark.createDataFrame([(p, n, str(d), str(i), t, r) for p, n, d, i, t, r in own], "path string, size long, device string, inode string, time long, reason string")
    tasks = max(1, min(len(own), max(spark.sparkContext.defaultParallelism, sum(f[1] for f in own) // TASK_BYTES)))
    out = rows.repartition(tasks).mapInArrow(read, CONTENTS)
    mine = {f[0] for f in own}
    if listed := [f[0] for f in found.files if f[0] not in mine]:
        plain_ = spark.read.format("binaryFile").load(listed).selectExpr("path", "length", "content", "CAST(NULL AS string) AS reason")
        out = out.unionByName(plain_)
    return out
