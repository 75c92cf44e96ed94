"""Listing folders in Spark jobs: the names of files never pass through the driver."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexiweight.storage import saved

# Names that a task passes on at once.
ROWS = 8192
_FOUND = "path string, length bigint, folder boolean, depth int"
_GLOB = re.compile(r"[*?\[{\\]")


def braces(path: str) -> list[str]:
    """The path without its first alternatives that span folders, ``{a/b,c}``: one path for each."""
    opened, start = 0, 0
    for i, c in enumerate(path):
        if c == "{":
            start = i if opened == 0 else start
            opened += 1
        elif c == "}" and opened:
            opened -= 1
            if not opened and "/" in path[start:i]:
                options, level, last = [], 0, start + 1
                for j in range(start + 1, i + 1):
                    level += (path[j] == "{") - (path[j] == "}")
                    if (path[j] == "," and level == 0) or j == i:
                        options.append(path[last:j])
                        last = j + 1
                return [p for o in options for p in braces(path[:start] + o + path[i + 1 :])]
    return [path]


def pattern(segment: str) -> str:
    """The regular expression of one segment of a glob: ``* ? [a-z] [^a] {a,b}`` and backslashes."""
    out, i, opened = "", 0, 0
    while i < len(segment):
        c = segment[i]
        if c == "\\" and i + 1 < len(segment):
            i += 1
            out += re.escape(segment[i])
        elif c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in segment[i + 2 :]:
            end = segment.index("]", i + 2)
            inner = segment[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] in "^!" else inner) + "]"
            i = end
        elif c == "{":
            out, opened = out + "(?:", opened + 1
        elif c == "}" and opened:
            out, opened = out + ")", opened - 1
        elif c == "," and opened:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return out


def rooted(path: str, default: str) -> tuple[str, list[str]]:
    """A path as a URI up to its first segment with a glob, and the patterns of the other segments."""
    parts = urlsplit(path) if re.match(r"[A-Za-z][\w+.-]*:/", path) else None
    scheme = parts.scheme if parts else urlsplit(default).scheme or "file"
    authority = parts.netloc if parts else urlsplit(default).netloc
    plain = re.sub(r"^[^/]*:(//[^/]*)?", "", path) if parts else path
    if not plain.startswith("/"):
        if scheme != "file":
            raise ValueError(f"the path {path!r} is not absolute")
        plain = f"{os.getcwd()}/{plain}"
    segments = [s for s in plain.split("/") if s and s != "."]
    globs = [i for i, s in enumerate(segments) if _GLOB.search(s)]
    first = globs[0] if globs else len(segments)
    return f"{scheme}://{authority}/" + "/".join(segments[:first]), [pattern(s) for s in segments[first:]]


def _children(patterns: list[str], rows_at_once: int = ROWS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What lies in folders: of those that a pattern is left for, the names that match it, of others all
    but hidden ones. Everything that it needs is imported here, as it runs on the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import re
        from itertools import islice
        from urllib.parse import urlsplit

        import pyarrow as pa
        from pyarrow import fs

        def entries(uri: str) -> Iterator[tuple[str, str, bool, int]]:
            """Name, URI, whether a folder, and length of what lies in a folder, or of the file itself."""
            scheme, authority = uri.split("://", 1)[0], uri.split("://", 1)[1].split("/", 1)[0]
            inner = uri[len(scheme) + 3 + len(authority) :]
            if scheme == "file":
                if os.path.isfile(inner):
                    yield os.path.basename(inner), uri, False, os.path.getsize(inner)
                    return
                with os.scandir(inner) as found:
                    for e in found:
                        if e.is_dir():
                            yield e.name, f"{uri.rstrip('/')}/{e.name}", True, 0
                        elif e.is_file():
                            yield e.name, f"{uri.rstrip('/')}/{e.name}", False, e.stat().st_size
                return
            system, base = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
            at = base.rstrip("/") + inner
            own = system.get_file_info(at)
            if own.type == fs.FileType.NotFound:
                raise FileNotFoundError(uri)
            if own.type == fs.FileType.File:
                yield own.base_name, uri, False, own.size
                return
            for info in system.get_file_info(fs.FileSelector(at)):
                yield info.base_name, f"{uri.rstrip('/')}/{info.base_name}", info.type == fs.FileType.Directory, info.size or 0

        def hidden(name: str) -> bool:
            return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")

        def found(rows: Iterator[tuple[str, int]]) -> Iterator[tuple[str, int, bool, int]]:
            for uri, depth in rows:
                matches = re.compile(patterns[depth], re.DOTALL).fullmatch if depth < len(patterns) else None
                for name, child, folder, length in entries(uri):
                    if child == uri and matches:
                        continue  # a file where the patterns ask for a folder
                    if matches and not matches(name):
                        continue
                    below = min(depth + 1, len(patterns))
                    if folder and (matches or not hidden(name)):
                        yield child, 0, True, below
                    elif not folder and below == len(patterns) and not hidden(name):
                        yield child, length, False, below

        names = ["path", "length", "folder", "depth"]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int32()]
        for batch in batches:
            rows = found(zip(batch.column("path").to_pylist(), batch.column("depth").to_pylist(), strict=True))
            while part := list(islice(rows, rows_at_once)):
                columns = zip(*part, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def roots(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """``rooted`` for each of the paths that ``path`` stands for."""
    default = spark.conf.get("spark.hadoop.fs.defaultFS", "file:///")
    return sorted(rooted(p, default) for p in braces(path))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length)`` of every file below a folder, at any depth, or that a file name or glob names.

    One round lists one level of folders in a job, a task for some of them, and writes what it finds to
    the shared folder; the driver learns only whether there are folders left. Names that start with
    ``.`` or ``_`` do not count, as in Spark's own sources (``_name=value`` does). The names of one folder
    are read by one task, a few at a time from local file systems; other systems are opened with pyarrow.
    Paths are URIs and not encoded: ``file:///data/a b%.txt``. A path without a scheme is one of the system
    that ``spark.hadoop.fs.defaultFS`` names, else of local files. A folder that is missing fails the query.
    """
    tasks = spark.sparkContext.defaultParallelism
    files = []
    for root, patterns in roots(spark, path):
        folders = spark.createDataFrame([(root, 0)], "path string, depth int")
        while True:
            found = saved(folders.repartition(tasks, "path").mapInArrow(_children(patterns), _FOUND), "listing")
            files.append(found.filter("not folder").select("path", "length"))
            folders = found.filter("folder").select("path", "depth")
            if folders.isEmpty():
                break
    several = reduce(DataFrame.unionByName, files)
    return several.distinct() if len(braces(path)) > 1 else several
