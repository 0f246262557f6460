"""A directory tree as a table of files: a Python data source.  The driver lists folders; tasks list and read their files.

Spark's own file sources hide names that begin with `_` or `.`, which packages need.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import UnsupportedRepositoryError
from .ecosystem import SUFFIXES

#: Directories that are never entered.
SKIPPED = {".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", "env", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build", "target", ".idea", ".vscode", ".next", ".cache", "coverage", ".eggs", ".gradle"}
PROBE, MOST_PARSED = 8192, 2 * 1024 * 1024
SCHEMA = "path string, size_bytes bigint, head binary, content binary, ordinal bigint"
#: Folders that one task reads, and files that a folder's numbers leave room for.
FOLDERS, ROOM = 16, 1 << 32
SPECIAL = {"*": "[^/]*", "?": "[^/]"}


def ignore_pattern(rule: str) -> re.Pattern:
    """One rule, without its negation and final slash: `*`, `?`, `**`, classes in brackets, and characters after a backslash."""
    anchored, at, out = "/" in rule, 0, []
    rule = rule.lstrip("/")
    while at < len(rule):
        c = rule[at]
        close = rule.find("]", at + 2 + (rule[at + 1 : at + 2] in ("!", "^"))) if c == "[" else -1
        if rule.startswith("**/", at) and (not at or rule[at - 1] == "/"):
            out.append("(?:.*/)?")
            at += 3
        elif c == "/" and rule[at:] == "/**":
            out.append("/.*")
            at += 3
        elif close > 0:
            inside = rule[at + 1 : close]
            negated = inside[0] in "!^"
            inside = inside[negated:].replace("[", r"\[").replace("&&", r"&\&").replace("--", r"-\-").replace("~~", r"~\~").replace("||", r"|\|")
            out.append(f"(?!/)[{'^' * negated}{inside}]")
            at = close + 1
        elif c == "\\" and at + 1 < len(rule):
            out.append(re.escape(rule[at + 1]))
            at += 2
        else:
            out.append(SPECIAL.get(c) or re.escape(c))
            at += 1
    return re.compile(("" if anchored else "(?:.*/)?") + "".join(out) + r"\Z", re.S)


def ignore_rules(text: str) -> list[tuple[re.Pattern, bool, bool]]:
    """(pattern, negated, directories only) of each rule of an ignore file; the last rule that matches decides."""
    rules = []
    for line in text.splitlines():
        rule = line.rstrip()
        if rule.endswith("\\") and rule != line:  # the first blank is escaped
            rule += " "
        if not rule or rule.startswith("#"):
            continue
        negated, rule = rule.startswith("!"), rule.removeprefix("!")
        only_dirs, rule = rule.endswith("/"), rule.rstrip("/")
        try:
            rules.append((ignore_pattern(rule), negated, only_dirs))
        except re.error:  # a class that names no range matches nothing
            continue
    return rules


def ignored(rules: list, path: str, is_dir: bool) -> bool:
    out = False
    for pattern, negated, only_dirs in rules:
        if pattern.match(path) and (is_dir or not only_dirs):
            out = not negated
    return out


def file_refs(rows: DataFrame, languages: dict[str, str] | None = None) -> DataFrame:
    """rows (path, size_bytes, head, content, ...) with language and is_binary in place of head.

    A NUL in the head makes a file binary, and a binary file's language unknown; so is that of a suffix that stands
    for none.  A binary file, and one of more than MOST_PARSED bytes, has no content.  Other columns stay.
    """
    known = SUFFIXES | (languages or {})
    suffix = F.lower(F.regexp_extract("path", r"[^/.][^/]*(\.[^./]*)$", 1))
    binary = F.coalesce(F.contains("head", F.lit(b"\0")), F.lit(False))
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    others = [c for c in rows.columns if c not in ("path", "size_bytes", "head", "content")]
    return rows.select(
        "path", F.when(binary, "unknown").otherwise(F.coalesce(F.try_element_at(table, suffix), F.lit("unknown"))).alias("language"), "size_bytes", binary.alias("is_binary"),
        F.when(~binary & (F.col("size_bytes") <= MOST_PARSED), F.col("content")).alias("content"), *others,
    )


class Folders(InputPartition):
    """Folders as (number in the walk's order, path)."""

    def __init__(self, folders: list[tuple[int, str]]) -> None:
        self.folders = folders


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = os.path.realpath(os.path.expanduser(options["path"]))
        if not os.path.isdir(self.root):
            raise UnsupportedRepositoryError(f"{self.root} is no directory")
        name = os.path.join(self.root, ".gitignore")
        self.rules = ignore_rules(open(name, errors="replace").read()) if os.path.isfile(name) else []

    def _inside(self, full: str) -> str:
        return os.path.relpath(full, self.root).replace(os.sep, "/")

    def _subfolders(self, folder: str) -> list[str]:
        try:
            names = sorted(e.name for e in os.scandir(folder) if e.is_dir(follow_symlinks=False) and e.name not in SKIPPED)
        except OSError:
            return []
        return [x for x in (os.path.join(folder, n) for n in names) if not ignored(self.rules, self._inside(x), True)]

    def partitions(self) -> list[InputPartition]:
        """Folders in the order of a walk from the top, names sorted, a few to a task; only names of folders are listed here."""
        found, todo = [], [self.root]
        while todo:
            found.append(todo.pop())
            todo += reversed(self._subfolders(found[-1]))
        numbered = list(enumerate(found))
        return [Folders(numbered[k : k + FOLDERS]) for k in range(0, len(numbered), FOLDERS)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        for number, folder in partition.folders:
            try:
                names = sorted(e.name for e in os.scandir(folder) if not e.is_dir(follow_symlinks=True))
            except OSError:
                continue
            for k, name in enumerate(names):
                for row in self._row(os.path.join(folder, name)):
                    yield (*row, number * ROOM + k)

    def _row(self, full: str) -> Iterator[tuple]:
        path = self._inside(full)
        if ignored(self.rules, path, False) or os.path.commonpath([os.path.realpath(full), self.root]) != self.root:
            return
        try:
            size = os.stat(full).st_size
            with open(full, "rb") as f:
                head = f.read(PROBE)
                content = head + f.read() if b"\0" not in head and size <= MOST_PARSED else None
        except OSError:
            return
        yield path, size, head, content


class RepositorySource(DataSource):
    """spark.read.format("code_repository").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "code_repository"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RepositoryReader:  # noqa: ANN001
        return RepositoryReader(self.options)
