"""What a source tree is built with: fixed names at its root, and counts of suffixes from a scan of names."""

from __future__ import annotations

import contextlib
import dataclasses
import os
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# File names and suffixes, with what they stand for.
MANIFESTS = {
    "pyproject.toml": ("python", "pip"),
    "setup.py": ("python", "pip"),
    "setup.cfg": ("python", "pip"),
    "Pipfile": ("python", "pip"),
    "requirements.txt": ("python", "pip"),
    "uv.lock": ("python", "uv"),
    "poetry.lock": ("python", "poetry"),
    "package.json": ("javascript", "npm"),
    "pnpm-lock.yaml": ("javascript", "pnpm"),
    "yarn.lock": ("javascript", "yarn"),
    "tsconfig.json": ("typescript", "npm"),
    "pom.xml": ("java", "maven"),
    "build.gradle": ("java", "gradle"),
    "build.gradle.kts": ("kotlin", "gradle"),
    "settings.gradle": ("java", "gradle"),
    "settings.gradle.kts": ("kotlin", "gradle"),
    "go.mod": ("go", "go_modules"),
    "go.sum": ("go", "go_modules"),
    "Cargo.toml": ("rust", "cargo"),
    "Cargo.lock": ("rust", "cargo"),
    "CMakeLists.txt": ("cpp", "cmake"),
    "composer.json": ("php", "composer"),
    "composer.lock": ("php", "composer"),
    "Gemfile": ("ruby", "bundler"),
    "Gemfile.lock": ("ruby", "bundler"),
    "Package.swift": ("swift", "swift_pm"),
}
SUFFIXES = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".java": "java",
    ".go": "go",
    ".rs": "rust",
    ".c": "c",
    ".h": "c",
    ".cc": "cpp",
    ".cpp": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
    ".cs": "csharp",
    ".php": "php",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".swift": "swift",
    ".rb": "ruby",
}
TEST_FILES = {
    "pytest.ini": "pytest",
    "tox.ini": "tox",
    "noxfile.py": "nox",
    "jest.config.js": "jest",
    "jest.config.ts": "jest",
    "vitest.config.ts": "vitest",
    "vitest.config.js": "vitest",
    "phpunit.xml": "phpunit",
    "spec_helper.rb": "rspec",
}
FRAMEWORKS = {
    "django": ("manage.py", "settings.py"),
    "flask": ("app.py", "wsgi.py"),
    "next": ("next.config.js", "next.config.mjs"),
    "rails": ("config/environment.rb",),
    "spring-boot": ("src/main/java",),
}
CI_FILES = (".gitlab-ci.yml", "Jenkinsfile", ".circleci/config.yml")
UNCOUNTED = {".git", "node_modules", ".venv", "venv", "target", "build", "dist", "__pycache__"}
DEEPEST, HEAD_BYTES = 4, 64 * 1024


@dataclasses.dataclass(frozen=True)
class Ecosystem:
    languages: tuple[str, ...] = ()
    build_systems: tuple[str, ...] = ()
    frameworks: tuple[str, ...] = ()
    test_frameworks: tuple[str, ...] = ()
    package_managers: tuple[str, ...] = ()
    has_dockerfile: bool = False
    has_ci: bool = False

    @property
    def primary_language(self) -> str:
        return self.languages[0] if self.languages else "unknown"


class Folder(InputPartition):
    def __init__(self, path: str, depth: int) -> None:
        self.path, self.depth = path, depth


class NamesReader(DataSourceReader):
    """Paths of files down to four folders deep; one partition for each folder at the root, links are followed."""

    def __init__(self, options: dict) -> None:
        self.root = options["path"]

    def _entered(self, entry: os.DirEntry) -> bool:
        return entry.name not in UNCOUNTED and not entry.name.startswith(".")

    def partitions(self) -> list[InputPartition]:
        return [Folder("", 0)] + [Folder(e.name, 1) for e in os.scandir(self.root) if e.is_dir() and self._entered(e)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        todo = [(partition.path, partition.depth)]
        while todo:
            path, depth = todo.pop()
            try:
                entries = list(os.scandir(os.path.join(self.root, path)))
            except OSError:
                continue
            for e in entries:
                if not e.is_dir():
                    yield (os.path.join(path, e.name),)
                elif 0 < depth < DEEPEST and self._entered(e):
                    todo.append((os.path.join(path, e.name), depth + 1))


class NamesSource(DataSource):
    """spark.read.format("code_names").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "code_names"

    def schema(self) -> str:
        return "path string"

    def reader(self, schema) -> NamesReader:  # noqa: ANN001
        return NamesReader(self.options)


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def suffix_counts(names: DataFrame, *group: str) -> DataFrame:
    """(group, suffix, language, n) of the known suffixes of names (group, path).

    Files more than four folders deep, or below a hidden or uncounted folder, don't count.
    """
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    counted = (F.size(folders) <= DEEPEST) & ~F.exists(folders, lambda x: x.startswith(".") | x.isin(*UNCOUNTED))
    suffix = F.lower(F.regexp_extract("path", r"[^/.][^/]*(\.[^./]*)$", 1))
    known = names.where(counted).select(*group, suffix.alias("suffix")).where(F.col("suffix").isin(*SUFFIXES))
    return known.groupBy(*group, "suffix").agg(F.count("*").alias("n")).select(*group, "suffix", F.element_at(_table(SUFFIXES), F.col("suffix")).alias("language"), "n")


def described(names: DataFrame) -> DataFrame:
    """What each repository is built with, from names (repo, path, text): one row a repository.

    Columns: repo, languages, build_systems, frameworks, test_frameworks, package_managers (arrays in order, each
    value once), has_dockerfile, has_ci.  text is that of pyproject.toml and may be null else.  Languages are those of
    manifests in their order, then of suffixes by falling frequency.  What is gathered of a repository is bounded by
    the number of markers and suffixes known, not by its files.
    """
    marks = sorted({*MANIFESTS, *TEST_FILES, *CI_FILES, "Dockerfile", *(m for ms in FRAMEWORKS.values() for m in ms)})
    mark = F.when(F.col("path").isin(*marks), F.col("path")).when(F.col("path").startswith("src/main/java/"), "src/main/java")
    seen = names.groupBy("repo").agg(
        F.collect_set(mark).alias("marks"), F.max(F.when(F.col("path") == "pyproject.toml", F.substring("text", 1, HEAD_BYTES))).alias("project"),
        F.bool_or(F.col("path").rlike(r"^Dockerfile\.[^/]*$")).alias("docker"), F.bool_or(F.col("path").rlike(r"^\.github/workflows(/|$)")).alias("workflows"),
    )
    counts = suffix_counts(names, "repo").groupBy("repo").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "suffix", "language"))).alias("counted"))
    rows = seen.join(counts, "repo", "left")
    has = lambda *any_of: F.arrays_overlap("marks", F.array(*map(F.lit, any_of)))
    says = lambda *parts: F.coalesce(reduce(lambda a, b: a | b, [F.contains("project", F.lit(x)) for x in parts]), F.lit(False))
    listed = lambda pairs: F.array_distinct(F.array_compact(F.array(*[F.when(condition, F.lit(value)) for condition, value in pairs])))
    manifest = [(has(name), language) for name, (language, _) in MANIFESTS.items()]
    builds = [(has(name), build) for name, (_, build) in MANIFESTS.items()]
    builds += [(says("[tool.poetry]"), "poetry"), (has("pyproject.toml") & (says("[tool.uv]") | has("uv.lock")), "uv")]
    manager = F.when(has("pnpm-lock.yaml"), "pnpm").when(has("yarn.lock"), "yarn").otherwise("npm")
    none = F.array().cast("array<string>")
    return rows.select(
        "repo", F.array_distinct(F.concat(listed(manifest), F.coalesce(F.col("counted.language"), none))).alias("languages"), listed(builds).alias("build_systems"),
        listed([(has(*ms), name) for name, ms in FRAMEWORKS.items()]).alias("frameworks"), listed([*((has(n), t) for n, t in TEST_FILES.items()), (says("pytest"), "pytest")]).alias("test_frameworks"),
        F.when(has("package.json"), F.array(manager)).otherwise(none).alias("package_managers"), (has("Dockerfile") | F.col("docker")).alias("has_dockerfile"), (has(*CI_FILES) | F.col("workflows")).alias("has_ci"),
    )


def detect(spark: SparkSession, root: str) -> Ecosystem:
    """`described` for one folder; nothing for a missing one."""
    at = Path(root)
    if not at.is_dir():
        return Ecosystem()
    project = None
    with contextlib.suppress(OSError), (at / "pyproject.toml").open("rb") as f:
        project = f.read(HEAD_BYTES).decode("utf-8", "replace")
    unlisted = [n for n in (".circleci/config.yml", ".github/workflows", "src/main/java") if (at / n).exists()]  # folders, and what hidden ones hold
    marked = [(n, None) for n in unlisted] + [("pyproject.toml", project)] * (project is not None)
    spark.dataSource.register(NamesSource)
    names = spark.read.format("code_names").load(str(at)).select("path", F.lit(None).cast("string").alias("text"))
    names = names.union(spark.createDataFrame(marked, "path string, text string")) if marked else names
    found = described(names.withColumn("repo", F.lit(root))).drop("repo").first()
    return Ecosystem(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.asDict().items()}) if found else Ecosystem()
