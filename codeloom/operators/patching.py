"""Patches as versions of a table of files, diffs and syntax checks; and a working copy with rollback."""

from __future__ import annotations

import ast
import difflib
from collections.abc import Iterable
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..errors import PatchError
from ..functions.parse import UNPARSABLE, problem_of


def last_edits(edits: DataFrame, key: str = "path") -> DataFrame:
    """(key, new_content, is_deletion): of each key's edits the last by `ordinal`.

    Without that column, or where it ties, an edit goes before a deletion, and the greater content before the less.
    A null is_deletion counts as false.
    """
    gone = F.coalesce("is_deletion", F.lit(False))
    order = F.struct(*([F.col("ordinal")] if "ordinal" in edits.columns else []), (~gone).alias("kept"), F.col("new_content").alias("text"))
    last = edits.groupBy(key).agg(F.max_by(F.struct("new_content", gone.alias("is_deletion")), order).alias("edit"))
    return last.select(key, "edit.*")


def applied(base: DataFrame, edits: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """base with edits (key, new_content, is_deletion, perhaps ordinal) made in order: a new version of the table."""
    last = last_edits(edits, key)
    kept = base.join(last.select(key), key, "left_anti").select(key, content)
    return kept.unionByName(last.where("not is_deletion").select(key, F.col("new_content").alias(content)))


def snapshot(base: DataFrame, edits: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, content, existed) of what edits are about to change: all that `rolled_back` needs, one row a key."""
    asked = edits.select(key).distinct()
    return asked.join(base.select(key, content, F.lit(True).alias("existed")), key, "left").withColumn("existed", F.coalesce("existed", F.lit(False)))


def rolled_back(version: DataFrame, before: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """version with the keys of a `snapshot` as they were: put back, or taken away if they weren't there."""
    kept = version.join(before.select(key), key, "left_anti").select(key, content)
    return kept.unionByName(before.where("existed").select(key, content))


def changes(base: DataFrame, other: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, change): added, removed or changed."""
    a = base.select(F.col(key), F.sha2(content, 256).alias("old"))
    b = other.select(F.col(key), F.sha2(content, 256).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def _lines(text: str | None) -> list[str]:
    """The lines of a side; a missing file has none, an empty one has one that is empty."""
    return [] if text is None else text.splitlines(keepends=True) or [""]


@F.pandas_udf(StringType())
def unified_diff(path: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    """A unified diff with three lines of context, with a line break at its end; a null side is /dev/null, equal sides give an empty diff."""
    out = []
    for p, a, b in zip(path, old, new):
        left, right = ("/dev/null" if a is None else f"a/{p}"), ("/dev/null" if b is None else f"b/{p}")
        told = "".join(difflib.unified_diff(_lines(a), _lines(b), left, right))
        out.append(told if told.endswith("\n") or not told else told + "\n")
    return pd.Series(out)


def is_new_file(old: Column, new: Column) -> Column:
    return old.isNull() & new.isNotNull()


def patch_diffs(base: DataFrame, edits: DataFrame, key: str = "path", content: str = "content", patch: str = "patch_id") -> DataFrame:
    """(patch, diff, new_files): the diffs of each patch's edits (patch, ordinal, key, new_content, is_deletion), joined in order.

    Each edit is held against base; a key that base lacks is a new file, a deletion of one says nothing.
    """
    new = F.when(~F.coalesce("is_deletion", F.lit(False)), F.coalesce("new_content", F.lit("")))
    met = edits.join(base.select(key, F.col(content).alias("old_text")), key, "left").withColumn("new_text", new)
    told = met.select(patch, "ordinal", unified_diff(F.col(key).cast("string"), F.col("old_text"), F.col("new_text")).alias("diff"), is_new_file(F.col("old_text"), F.col("new_text")).alias("fresh"))
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "diff")))
    return told.groupBy(patch).agg(F.array_join(F.transform(parts, lambda x: x["diff"]), "").alias("diff"), F.count_if("fresh").alias("new_files"))


@F.pandas_udf(StringType())
def syntax_problem(path: pd.Series, content: pd.Series) -> pd.Series:
    """line:column: message of Python files that don't parse, else null."""
    out = []
    for p, c in zip(path, content):
        found = None
        if p and p.lower().endswith((".py", ".pyi")) and c is not None:
            try:
                ast.parse(c)
            except UNPARSABLE as e:
                found = problem_of(e)
        out.append(found)
    return pd.Series(out, dtype=object)


class WorkingCopy:
    """Edits (path, new_content, is_deletion) made to files of a folder, with one version to go back to."""

    def __init__(self, root: str) -> None:
        self.root = Path(root).resolve()
        self._before: dict[Path, bytes | None] | None = None

    def _at(self, path: str) -> Path:
        target = (self.root / path).resolve()
        if not target.is_relative_to(self.root):
            raise PatchError(f"{path} is outside of {self.root}")
        return target

    def apply(self, edits: Iterable[tuple[str, str, bool]]) -> None:
        """All edits in order, or none: after an error the files are as before.  No edits change nothing, not even what rollback restores."""
        todo = [(self._at(path), content, deleted) for path, content, deleted in edits]
        if not todo:
            return
        try:
            self._before = {t: t.read_bytes() if t.exists() else None for t, _, _ in todo}
        except OSError as e:
            raise PatchError(f"can't read what is to be changed: {e}") from e
        try:
            for target, content, deleted in todo:
                if deleted:
                    target.unlink(missing_ok=True)
                else:
                    target.parent.mkdir(parents=True, exist_ok=True)
                    target.write_bytes(content.encode())
        except Exception as e:
            self._restore(self._before)
            raise PatchError(f"the patch can't be applied: {e}") from e

    def rollback(self) -> None:
        if self._before is None:
            raise PatchError("nothing to go back to")
        before, self._before = self._before, None
        self._restore(before)

    @staticmethod
    def _restore(before: dict[Path, bytes | None]) -> None:
        for target, content in before.items():
            try:
                if content is None:
                    target.unlink(missing_ok=True)
                else:
                    target.parent.mkdir(parents=True, exist_ok=True)
                    target.write_bytes(content)
            except OSError:  # the other files are still restored
                continue
