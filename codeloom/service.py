"""One call from a source to files, graph and findings; the command line and the HTTP interface stand on it."""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .operators import analysis
from .operators.graph import KnowledgeGraph
from .operators.rules import RuleRegistry, Subject, default_registry
from .sources import acquire as acquisition
from .sources.ecosystem import Ecosystem, detect


@dataclasses.dataclass
class Repository:
    name: str
    root: Path
    origin: str | None
    branch: str | None
    commit: str | None
    ecosystem: Ecosystem
    files: DataFrame
    id: str = dataclasses.field(default_factory=lambda: str(uuid.uuid4()))

    @property
    def file_count(self) -> int:
        return self.files.count()

    def as_dict(self) -> dict:
        kept = {f: getattr(self, f) for f in ("id", "name", "origin", "branch", "commit", "file_count")}
        return kept | {"root": str(self.root), "ecosystem": {k: list(v) if isinstance(v, tuple) else v for k, v in dataclasses.asdict(self.ecosystem).items()}}


@dataclasses.dataclass
class Analysis:
    repository: Repository
    parsed: DataFrame
    graph: KnowledgeGraph
    findings: DataFrame | None

    def stats(self) -> dict[str, int]:
        return {"nodes": self.graph.node_count(), "edges": self.graph.edge_count()}

    def finding_dicts(self) -> list[dict]:
        """Findings as reports show them: what a rule adds of its own is under metadata."""
        if self.findings is None:
            return []
        common = ("rule_id", "title", "description", "severity", "file", "related_files")
        out = []
        for row in self.findings.collect():
            values = row.asDict(recursive=True)
            metadata = {k: v for k, v in values.items() if k not in common and v is not None}
            out.append({"id": str(uuid.uuid4())} | {k: values[k] for k in common} | {"metadata": metadata})
        return out


class AnalysisService:
    """Parts can be replaced: how a source becomes a folder, how it is described and walked, the parsers and resolvers by
    language, and the rules."""

    def __init__(self, spark: SparkSession, acquire: Callable = acquisition.acquire, describe: Callable = detect, registry: RuleRegistry | None = None, walk: Callable = analysis.files, parsers: dict | None = None, resolvers: dict | None = None) -> None:
        self.spark, self.acquire, self.describe, self.registry = spark, acquire, describe, registry or default_registry()
        self.walk, self.parsers, self.resolvers = walk, parsers, resolvers

    def ingest(self, source: str, branch: str | None = None, name: str | None = None) -> Repository:
        root, commit = self.acquire(str(source), branch)
        origin = str(source) if acquisition.is_address(str(source)) else None
        return Repository(name or root.name, root, origin, branch, commit, self.describe(self.spark, str(root)), self.walk(self.spark, str(root)).cache())

    def analyze(self, source: str, branch: str | None = None, rule_ids: Sequence[str] | None = None) -> Analysis:
        repository = self.ingest(source, branch)
        parsed = analysis.parsed_files(repository.files, self.parsers).cache()
        graph = analysis.graph_of(repository.files.drop("content"), parsed, self.resolvers)
        graph = KnowledgeGraph(graph.nodes.cache(), graph.edges.cache())
        return Analysis(repository, parsed, graph, self.registry.findings(Subject(graph, parsed), rule_ids))

    def close(self, result: Analysis) -> None:
        """Gives back what the analysis keeps in memory."""
        for kept in (result.graph.nodes, result.graph.edges, result.parsed, result.repository.files):
            kept.unpersist()
