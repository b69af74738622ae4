"""Files of any store that Arrow knows, named by path or by URI."""

from __future__ import annotations

import fnmatch
import os
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

from pyarrow import fs
from pyspark.sql.datasource import InputPartition

#: A listing of no more files is planned file by file; in a longer one, files of so many bytes or fewer are read together.
FEW_FILES, SMALL_BYTES = 64, 4 << 20
#: Bytes that one task reads of small files at most, what opening one counts as, and tasks that are made before they grow.
TOGETHER_BYTES, OPEN_BYTES, LEAST_TASKS = 32 << 20, 64 << 10, 64


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path within it; a path without a scheme is local."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def listed(pattern: str) -> list[tuple[str, int]]:
    """Files whose paths match, in order, with their sizes; ``*`` and ``?`` stand within one name."""
    store, path = opened(pattern)
    scheme = pattern[: len(pattern) - len(path)] if "://" in pattern and pattern.endswith(path) else ""
    fixed, *rest = path.split("/")
    found: list[tuple[str, fs.FileInfo | None]] = [(fixed or "/", None)]
    for k, name in enumerate(rest):
        if any(c in name for c in "*?["):
            inside = [x for at, info in found if (info or store.get_file_info(at)).type == fs.FileType.Directory for x in store.get_file_info(fs.FileSelector(at))]
            found = [(x.path, x) for x in inside if fnmatch.fnmatchcase(posixpath.basename(x.path), name) and not (k < len(rest) - 1 and x.type == fs.FileType.File)]
        else:
            found = [(posixpath.join(at, name), None) for at, _ in found]
    infos = [(at, info or store.get_file_info(at)) for at, info in found]
    return sorted((f"{scheme}{at}", info.size) for at, info in infos if info.type == fs.FileType.File)


def matching(pattern: str) -> list[str]:
    return [path for path, _ in listed(pattern)]


@dataclass
class Together(InputPartition):
    """Small files that one task plans and reads, by folder, so that a long listing stays short."""

    folders: tuple[tuple[str, tuple[str, ...]], ...]

    def paths(self) -> Iterator[str]:
        for folder, names in self.folders:
            for name in names:
                yield f"{folder}/{name}"


def divided(files: list[tuple[str, int]]) -> tuple[list[str], list[Together]]:
    """(files to plan one by one, the others together): where there are many, a small one is not worth a task."""
    if len(files) <= FEW_FILES:
        return [path for path, _ in files], []
    small = [(path, size + OPEN_BYTES) for path, size in files if size <= SMALL_BYTES]
    most = min(TOGETHER_BYTES, -(-sum(size for _, size in small) // LEAST_TASKS))
    tasks, held = [[]], 0
    for path, size in small:
        if held and held + size > most:
            tasks.append([])
            held = 0
        tasks[-1].append(path.rpartition("/"))
        held += size
    together = [Together(tuple((folder, tuple(name for _, _, name in own)) for folder, own in groupby(task, lambda x: x[0]))) for task in tasks if task]
    return [path for path, size in files if size > SMALL_BYTES], together


class Reader:
    """``read(offset, n)`` and the size of a file that stays open; fewer bytes come at its end."""

    def __init__(self, path: str):
        store, at = opened(path)
        self._file = store.open_input_file(at)
        self.size = self._file.size()

    def __call__(self, offset: int, n: int) -> bytes:
        n = min(n, self.size - offset)
        return self._file.read_at(n, offset) if n > 0 and offset >= 0 else b""


class Held(Reader):
    """The same of a small file, which is read at once."""

    def __init__(self, path: str):
        super().__init__(path)
        with self._file:
            self._data = self._file.read()

    def __call__(self, offset: int, n: int) -> bytes:
        return self._data[offset : offset + n] if n > 0 and offset >= 0 else b""
