"""Rules over a graph of code: each gives findings (rule_id, title, description, severity, file, related_files, ...)."""

from __future__ import annotations

import dataclasses
import logging
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DetectionError
from .graph import KnowledgeGraph, components_by_reach, cut_lineage

_log = logging.getLogger(__name__)

MOST_METHODS, MOST_CLASS_LINES, MOST_LINES = 25, 500, 100


@dataclasses.dataclass
class Subject:
    """What rules look at; parsed has a row for each Python file, see `functions.parse`."""

    graph: KnowledgeGraph
    parsed: DataFrame | None = None

    @property
    def symbols(self) -> DataFrame:
        return self.parsed.select("file", F.explode("symbols").alias("s")).select("file", "s.*")


Rule = Callable[[Subject], DataFrame]


def circular_imports(subject: Subject) -> DataFrame:
    """Components of internal modules that import each other, two members at least."""
    scc = components_by_reach(subject.graph.edges.where("kind = 'imports'"))
    members = scc.join(subject.graph.nodes, "id").where("not coalesce(external, false)").groupBy("scc").agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("qualified_name", "id").alias("name"), "file"))).alias("m"))
    rows = members.where("size(m) >= 2").select(F.col("m.name").alias("modules"), F.filter("m.file", lambda x: x.isNotNull()).alias("related_files"))
    size = F.size("modules")
    said = F.concat(F.lit("Each of these modules imports the next, directly or not, and the last the first:\n  - "), F.array_join("modules", "\n  - "))
    return rows.select(F.lit("circular_imports").alias("rule_id"), F.format_string("Circular import among %d modules", size).alias("title"), said.alias("description"), F.lit("medium").alias("severity"), F.get("related_files", F.lit(0)).alias("file"), "related_files", "modules", size.alias("cycle_size"))


def _finding(rows: DataFrame, rule: str, severity: str, title: str, *shown: str) -> DataFrame:
    """Findings of rows (file, line, name, and what is shown)."""
    text = F.format_string(title, *shown).alias("title")
    return rows.select(F.lit(rule).alias("rule_id"), text, F.concat_ws(":", "file", F.col("line") + 1).alias("description"), F.lit(severity).alias("severity"), "file", F.array("file").alias("related_files"), "line", "name")


def _fact(rule: str, severity: str, title: str) -> Rule:
    def found(subject: Subject) -> DataFrame:
        rows = subject.parsed.select("file", F.explode("facts").alias("f")).select("file", "f.*").where(F.col("rule") == rule)
        return _finding(rows, rule, severity, title, "name")

    found.__name__ = rule
    return found


def god_class(subject: Subject) -> DataFrame:
    """Classes with more than 25 methods or 500 lines."""
    s = subject.symbols
    methods = s.where("kind = 'method'").groupBy("file", F.col("parent").alias("qualified_name")).agg(F.count("*").alias("methods"))
    classes = s.where("kind = 'class'").join(methods, ["file", "qualified_name"], "left").withColumn("lines", F.col("end_line") - F.col("start_line") + 1)
    rows = classes.where((F.col("methods") > MOST_METHODS) | (F.col("lines") > MOST_CLASS_LINES))
    rows = rows.select("file", F.col("start_line").alias("line"), F.col("qualified_name").alias("name"), F.coalesce("methods", F.lit(0)).alias("methods"), "lines")
    return _finding(rows, "god_class", "medium", "Class %s has %d methods on %d lines", "name", "methods", "lines")


def long_method(subject: Subject) -> DataFrame:
    """Functions and methods of more than 100 lines."""
    rows = subject.symbols.where(F.col("kind").isin("function", "method")).withColumn("lines", F.col("end_line") - F.col("start_line") + 1).where(F.col("lines") > MOST_LINES)
    return _finding(rows.select("file", F.col("start_line").alias("line"), F.col("qualified_name").alias("name"), "lines"), "long_method", "low", "%s has %d lines", "name", "lines")


def _named(subject: Subject, tests: bool | None = None) -> DataFrame:
    used = subject.parsed if tests is None else subject.parsed.where(_is_test("file") == tests)
    return used.select(F.explode("names").alias("name")).distinct()


def _is_test(file: str):  # noqa: ANN202
    return F.col(file).rlike(r"(^|/)(tests?/|test_[^/]*$|[^/]*_test\.py$|conftest\.py$)")


def _definitions(subject: Subject) -> DataFrame:
    """Functions, methods and classes that others may call by name; double underscores are called by the language."""
    named = subject.symbols.where("kind <> 'module'").where(~F.col("name").rlike("^__.*__$"))
    return named.select("file", F.col("start_line").alias("line"), "name", "qualified_name").where(~_is_test("file"))


def dead_code(subject: Subject) -> DataFrame:
    """Definitions whose name no file uses."""
    rows = _definitions(subject).join(_named(subject), "name", "left_anti")
    return _finding(rows.drop("name").withColumnRenamed("qualified_name", "name"), "dead_code", "low", "%s is never used", "name")


def missing_test_coverage(subject: Subject) -> DataFrame:
    """Definitions that no test uses by name."""
    rows = _definitions(subject).where(~F.startswith("name", F.lit("_"))).join(_named(subject, True), "name", "left_anti")
    return _finding(rows.drop("name").withColumnRenamed("qualified_name", "name"), "missing_test_coverage", "info", "No test uses %s", "name")


class RuleRegistry:
    def __init__(self) -> None:
        self._rules: dict[str, Rule] = {}

    def register(self, rule_id: str, rule: Rule) -> None:
        if rule_id in self._rules:
            raise ValueError(f"rule {rule_id} is registered already")
        self._rules[rule_id] = rule

    def get(self, rule_id: str) -> Rule:
        if rule_id not in self._rules:
            raise DetectionError(f"unknown rule: {rule_id}")
        return self._rules[rule_id]

    def ids(self) -> list[str]:
        return list(self._rules)

    def findings(self, subject: Subject, rule_ids: Iterable[str] | None = None) -> DataFrame | None:
        """Findings of the rules asked for, all if None, in one table; None if no rule ran through.

        An unknown id is refused before any rule runs.  Each rule's rows are written before the next begins, so that
        one that fails is skipped alone.
        """
        wanted = [(r, self.get(r)) for r in (self.ids() if rule_ids is None else rule_ids)]
        out = None
        for name, rule in wanted:
            try:
                rows = cut_lineage(rule(subject))
            except Exception as e:  # noqa: BLE001
                _log.warning("rule %s failed: %s", name, e)
                continue
            _log.info("rule %s: %d findings", name, rows.count())  # counts rows that are written already
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out


def default_registry() -> RuleRegistry:
    registry = RuleRegistry()
    registry.register("circular_imports", circular_imports)
    return registry


def full_registry() -> RuleRegistry:
    """The default rule, and those that look at the parsed files."""
    registry = default_registry()
    registry.register("unused_imports", _fact("unused_imports", "low", "%s is imported and not used"))
    registry.register("mutable_default_args", _fact("mutable_default_args", "medium", "%s has a default value that calls share"))
    registry.register("broad_except", _fact("broad_except", "medium", "Any error is caught and not raised again %s"))
    registry.register("async_deadlock", _fact("async_deadlock", "high", "%s is held by a synchronous block across an await"))
    registry.register("n_plus_one_query", _fact("n_plus_one_query", "medium", "%s is asked in a loop"))
    registry.register("hardcoded_secret", _fact("hardcoded_secret", "critical", "%s is a secret in the source"))
    for rule in (god_class, long_method, dead_code, missing_test_coverage):
        registry.register(rule.__name__, rule)
    return registry


def scan(graph: KnowledgeGraph, rule_ids: Iterable[str] | None = None, parsed: DataFrame | None = None) -> list:
    """Findings as rows, for reports; `RuleRegistry.findings` gives them as a table.  Without parsed, the default rule alone."""
    registry = default_registry() if parsed is None else full_registry()
    found = registry.findings(Subject(graph, parsed), rule_ids)
    return [] if found is None else found.collect()
