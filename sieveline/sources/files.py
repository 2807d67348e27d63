"""Files of a folder, of a repository's index and of its history, as Python data sources.

Spark's own file sources leave out files whose names start with a dot or an underscore, and such files often hold secrets.
The driver lists names only; executors read contents, so folders must be in a place that all of them see.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sieveline.config import EXCLUDE_PATHS, MAX_BYTES

SCHEMA = "file_path string, status string, size bigint, content string, skipped string"
#: Files read by one task.
FILES = 256
SNIFF = 8192


class Names(InputPartition):
    def __init__(self, names: list[tuple[str, str]]):
        super().__init__(None)
        self.names = names


def text_of(data: bytes) -> str:
    """UTF-8, with each byte that is not as the character of its code."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("utf-8", "surrogateescape").translate({0xDC00 + b: b for b in range(128, 256)})


def row(path: str, status: str, data: bytes, cap: int) -> tuple:
    reason = "empty" if not data else "too large" if len(data) > cap else "binary" if 0 in data[:SNIFF] else None
    return path, status, len(data), None if reason else text_of(data), reason


def git(root: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", root, *args], check=True, capture_output=True).stdout


def walk(path: str, recursive: bool, pruned: set[str]) -> Iterator[str]:
    """Regular files below a path; a file is itself. Folders of pruned names are not entered."""
    if os.path.isfile(path):
        yield path
        return
    for top, folders, names in os.walk(path):
        folders[:] = sorted(d for d in folders if d not in pruned) if recursive else []
        yield from (p for n in sorted(names) if os.path.isfile(p := os.path.join(top, n)) and not os.path.islink(p))


class Reader(DataSourceReader):
    def __init__(self, options):
        self.root, self.kind = options["path"], options.get("kind", "folder")
        self.cap = int(options.get("max_file_size_bytes", MAX_BYTES))
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.pruned = {".git", *(p.removesuffix("/**") for p in EXCLUDE_PATHS if p.endswith("/**") and not p.startswith("**"))} if options.get("prune", "true").lower() == "true" else {".git"}

    def partitions(self):
        if self.kind == "staged":
            found = staged_names(git(self.root, "diff", "--cached", "--name-status", "-z", "--diff-filter=ACRM").decode("utf-8", "surrogateescape"))
        elif self.kind == "history":
            found = [(c, "") for c in git(self.root, "rev-list", "--all").decode().split()]
        else:
            found = [(p, "") for one in self.root.split(os.pathsep) for p in (walk(one, self.recursive, self.pruned) if os.path.exists(one) else [one])]
        return [Names(found[k : k + FILES]) for k in range(0, len(found), FILES)] or [Names([])]

    def read(self, partition):
        for name, status in partition.names:
            if self.kind == "staged":
                try:
                    data = git(self.root, "show", f":{name}") if status == "A" else added_lines(git(self.root, "diff", "--cached", "--unified=0", "--", name))
                except subprocess.CalledProcessError as e:
                    yield name, status, 0, None, f"unreadable: git ended with {e.returncode}"
                else:
                    yield row(name, status, data, self.cap)
            elif self.kind == "history":
                log = git(self.root, "show", "--format=commit %H", "--patch", "--no-renames", "--diff-merges=off", name)
                yield name[:7], "", len(log), text_of(log), None
            else:
                try:
                    size = os.path.getsize(name)
                    yield row(name, status, Path(name).read_bytes(), self.cap) if size <= self.cap else (name, status, size, None, "too large")
                except OSError as e:
                    yield name, status, 0, None, f"unreadable: {e.strerror}"


def staged_names(listing: str) -> list[tuple[str, str]]:
    """(path, status) of a listing whose parts end with a NUL; of a rename or copy the new path. Names of any characters stand as they are."""
    parts = iter(listing.split("\0"))
    out = []
    for status in parts:
        if status:
            names = [next(parts, "") for _ in range(2 if status[0] in "RC" else 1)]
            out.append((names[-1], status))
    return [x for x in out if x[0]]


def added_lines(diff: bytes) -> bytes:
    found = [x[1:] for x in diff.splitlines() if x.startswith(b"+") and not x.startswith(b"+++")]
    return b"".join(x + b"\n" for x in found)


class FileSource(DataSource):
    """spark.read.format("sieveline-files").option("kind", "folder" | "staged" | "history").load(path); several folders are
    separated as in PATH. Missing and unreadable files, binary, empty and too large ones are rows with a reason in skipped."""

    @classmethod
    def name(cls):
        return "sieveline-files"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)


def read_files(spark: SparkSession, path: str, kind: str = "folder", **options: str) -> DataFrame:
    spark.dataSource.register(FileSource)
    return spark.read.format("sieveline-files").options(kind=kind, **options).load(path)
