"""Data sources of a checkout that all executors see: its files under nested ignore rules, its history by ranges, its roots.

``register(spark)`` names them: ``spark.read.format("repository_files").option("path", root).load()``, likewise
``repository_history`` and ``repository_roots``.
"""

from __future__ import annotations

import os
import re
import subprocess
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import glob_to_regex

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors may not have this package

#: Never walked into, whatever the ignore files say.
NEVER = (".git",)
#: Rows of history that a task reads, and commits that are read at most unless asked otherwise.
RANGE, DEPTH, MAX_SIZE = 100, 500, 1 << 20


def _git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, "-c", "core.quotePath=false", *args], capture_output=True, check=False)
    if done.returncode:
        raise RuntimeError(f"git {args[0]} in {root}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout.decode("utf-8", "replace")


def ignore_rules(lines: list[str], base: str = "") -> list[tuple[re.Pattern, bool, bool]]:
    """(what fits a path below ``base``, takes back, folders only) for each rule of an ignore file, in order."""
    rules = []
    for line in lines:
        p = line.rstrip("\r\n")
        p = p.rstrip() if not p.endswith("\\ ") else p
        if not p or p.startswith("#"):
            continue
        back, p = p.startswith("!"), p.removeprefix("!").removeprefix("\\")
        folder, p = p.endswith("/"), p.rstrip("/")
        if not p:
            continue
        free = "/" not in p
        body = glob_to_regex(p.removeprefix("/"))[1:-1]
        rules.append((re.compile("^" + re.escape(base) + ("(?:.*/)?" if free else "") + body + "$"), back, folder))
    return rules


def is_ignored(path: str, folder: bool, rules: list[tuple[re.Pattern, bool, bool]]) -> bool:
    """The last rule that fits decides; rules of deeper files come later."""
    out = False
    for fits, back, only in rules:
        if (folder or not only) and fits.match(path):
            out = not back
    return out


class _Folder(InputPartition):
    def __init__(self, name: str | None) -> None:
        super().__init__(name)


class _Options:
    def __init__(self, options: dict[str, str]) -> None:
        self.root = os.path.realpath(options["path"].removeprefix("file://"))
        self.root_id = options.get("root_id", "primary")
        self.max_size = int(options.get("max_size", MAX_SIZE))
        self.ignore_files = tuple(filter(None, options.get("ignore_files", ".gitignore,.ignore").split(",")))
        self.redact = tuple(filter(None, options.get("redact", "").split(",")))
        self.depth = int(options.get("depth", DEPTH))
        self.range = int(options.get("range", RANGE))


class _Files(DataSourceReader):
    """A task for each folder at the top and one for the files there; bytes are read last, of files that pass everything else."""

    def __init__(self, options: _Options) -> None:
        self.o = options

    def _rules(self, folder: str) -> list:
        found = []
        names = [os.path.join(".git", "info", "exclude"), *self.o.ignore_files] if not folder else self.o.ignore_files
        for name in names:
            where = os.path.join(self.o.root, folder, name)
            if os.path.isfile(where):
                with open(where, encoding="utf-8", errors="replace") as f:
                    found += ignore_rules(f.read().split("\n"), f"{folder}/" if folder else "")
        return found

    def _inside(self, where: str) -> bool:
        real = os.path.realpath(where)
        return real == self.o.root or real.startswith(self.o.root + os.sep)

    def partitions(self) -> list[InputPartition]:
        tops = sorted(e.name for e in os.scandir(self.o.root) if e.is_dir() and e.name not in NEVER)
        return [_Folder(None), *map(_Folder, tops)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        redact = [re.compile("^(?:.*/)?" + glob_to_regex(g.removeprefix("**/"))[1:]) if "/" not in g.removeprefix("**/") else re.compile(glob_to_regex(g)) for g in self.o.redact]
        top = self._rules("")
        if partition.value is None:
            todo = [("", top, frozenset(), False)]
        else:
            todo = [(partition.value, top, frozenset(), True)] if not is_ignored(partition.value, True, top) and self._inside(os.path.join(self.o.root, partition.value)) else []
        while todo:
            folder, rules, above, deep = todo.pop()
            real = os.path.realpath(os.path.join(self.o.root, folder))
            if real in above:  # a link to a folder that it stands in
                continue
            rules = rules + (self._rules(folder) if folder else [])
            for e in sorted(os.scandir(os.path.join(self.o.root, folder)), key=lambda e: e.name):
                path = f"{folder}/{e.name}" if folder else e.name
                if e.name in NEVER or not self._inside(e.path):
                    continue
                if e.is_dir():
                    if deep and not is_ignored(path, True, rules):
                        todo.append((path, rules, above | {real}, True))
                elif e.is_file() and not is_ignored(path, False, rules) and not any(r.match(path) for r in redact):
                    size, content = e.stat().st_size, None
                    if size <= self.o.max_size:
                        with open(e.path, "rb") as f:
                            content = f.read()
                    yield self.o.root_id, path, size, content


class RepositoryFiles(DataSource):
    """root_id, path, size_bytes, content of the files of a checkout.

    Ignore files hold for their folder and those below, deeper ones outweigh higher ones, the last rule that fits decides,
    and nothing below an ignored folder comes back.  Links are followed within the root, never out of it and never in a circle.
    Files that match ``redact`` (globs, comma-separated) are left out unread; content is null above ``max_size``.
    """

    @classmethod
    def name(cls) -> str:
        return "repository_files"

    def schema(self) -> str:
        return "root_id string, path string, size_bytes long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Files(_Options(self.options))


class _Range(InputPartition):
    def __init__(self, start: str, n: int, first: int) -> None:
        super().__init__((start, n, first))


class _History(DataSourceReader):
    def __init__(self, options: _Options) -> None:
        self.o = options

    def partitions(self) -> list[InputPartition]:
        try:
            ids = _git(self.o.root, "rev-list", "--first-parent", f"--max-count={self.o.depth}", "HEAD").split()
        except RuntimeError as e:
            if re.search("unknown revision|ambiguous argument", str(e)):  # nothing is committed yet
                return []
            raise
        return [_Range(ids[i], min(self.o.range, len(ids) - i), i) for i in range(0, len(ids), self.o.range)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:  # what a reader without partitions gets
            return
        start, n, first = partition.value
        log = _git(self.o.root, "log", "--first-parent", "-m", f"--max-count={n}", "-z", "--name-only", "--no-renames", "--format=%x1e%H%x1f%an%x1f%ct%x1f%P%x1f%s%x1f", start)
        for k, record in enumerate(log.split("\x1e")[1:]):
            revision, author, at, parents, summary, rest = record.split("\x1f", 5)
            paths = [p.strip("\n") for p in rest.split("\0")]
            yield first + k, revision, author, int(at), len(parents.split()), summary, list(dict.fromkeys(p for p in paths if p))


class RepositoryHistory(DataSource):
    """place (0 is the head), revision, author_name, committed_at_unix, parent_count, summary and changed_paths of the first parents of HEAD.

    At most ``depth`` commits, ``range`` of them a task.  Changes are those against the first parent; a root commit changes all it
    has; a shallow clone ends where its commits do; a repository without commits gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "repository_history"

    def schema(self) -> str:
        return "place int, revision string, author_name string, committed_at_unix long, parent_count int, summary string, changed_paths array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _History(_Options(self.options))


class _Roots(DataSourceReader):
    def __init__(self, options: _Options) -> None:
        self.o = options

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        root = self.o.root
        yield "primary", "primary", root
        for block in _git(root, "worktree", "list", "--porcelain").strip().split("\n\n"):
            said = dict(line.partition(" ")[::2] for line in block.split("\n"))
            where = os.path.realpath(said.get("worktree", root))
            if where != root and "bare" not in said and os.path.isdir(where):
                yield f"worktree:{os.path.basename(where)}", "worktree", where
        if os.path.isfile(os.path.join(root, ".gitmodules")):
            for line in _git(root, "config", "-f", ".gitmodules", "--get-regexp", r"^submodule\..*\.path$").splitlines():
                path = line.split(" ", 1)[1]
                where = os.path.realpath(os.path.join(root, path))
                if where.startswith(root + os.sep) and os.path.exists(os.path.join(where, ".git")):
                    yield f"submodule:{path}", "submodule", where
        current = _git(root, "rev-parse", "--abbrev-ref", "HEAD").strip() if _git(root, "for-each-ref", "--count=1", "refs/heads") else ""
        for branch in _git(root, "for-each-ref", "--format=%(refname:short)", "refs/heads").split():
            if branch != current:
                yield f"branch:{branch}", "branch", branch


class RepositoryRoots(DataSource):
    """root_id, kind, location: the checkout itself, its other worktrees, submodules that are checked out, and branches other than the current one."""

    @classmethod
    def name(cls) -> str:
        return "repository_roots"

    def schema(self) -> str:
        return "root_id string, kind string, location string"

    def reader(self, schema) -> DataSourceReader:
        return _Roots(_Options(self.options))


def register(spark: SparkSession) -> None:
    for source in (RepositoryFiles, RepositoryHistory, RepositoryRoots):
        spark.dataSource.register(source)
