"""From files to a graph and findings: parse, resolve imports, assemble nodes and edges, run rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import PARSED, PARSERS, parser_for
from ..sources.repository import RepositorySource, file_refs
from .graph import KnowledgeGraph, distinct_edges, merged_nodes, missing_endpoints
from .rules import DetectionError, scan  # noqa: F401

ROOTS = ["", "src/", "lib/", "app/"]
#: From an import's file, target and whether it is relative, to an array of candidate files, best first.
Resolver = Callable[[Column, Column, Column], Column]


def files(spark: SparkSession, path: str, languages: dict[str, str] | None = None) -> DataFrame:
    """The files of a tree; languages are those of further suffixes, such as {".foo": "foo"}."""
    spark.dataSource.register(RepositorySource)
    return file_refs(spark.read.format("code_repository").load(path), languages)


def parsed_files(found: DataFrame, parsers: dict[str, Callable] | None = None) -> DataFrame:
    """A row for each file of a language that has a parser; parsers are by language, all registered ones if not given."""
    chosen = {x: parser_for(x) for x in PARSERS} if parsers is None else dict(parsers)

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [chosen[x](p, c) for x, p, c in zip(frame["language"], frame["path"], frame["content"])]
            yield pd.DataFrame(rows, columns=["file", "symbols", "imports", "parse_errors", "facts", "names"])

    readable = found.where(~F.col("is_binary") & F.col("language").isin(list(chosen)) & F.col("content").isNotNull())
    return readable.select("language", "path", "content").mapInPandas(kernel, PARSED)


def module_of(path: Column) -> Column:
    """The dotted module name of a file's path; null stays null."""
    parts = F.split(F.regexp_replace(path, r"\.[^./]+$", ""), "/")
    package = (F.element_at(parts, -1) == "__init__") & (F.size(parts) > 1)
    return F.array_join(F.when(package, F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts), ".")


def python_candidates(file: Column, target: Column, relative: Column) -> Column:
    """Files that an import may mean, best first: by root, then longest prefix, then module before package.

    A relative target starts at the importing file's folder, one further up for each dot after the first, and may not
    be shortened to the folder itself; a target of dots alone is the folder's package.  Above the tree there is nothing.
    """
    rest = F.ltrim(target, F.lit("."))
    parts = F.filter(F.split(rest, r"\."), lambda x: x != "")
    folder = F.split(file, "/")
    depth = F.size(folder) - 1 - F.when(relative, F.length(target) - F.length(rest) - 1).otherwise(0)
    near = F.array_join(F.transform(F.slice(folder, F.lit(1), F.greatest(depth, F.lit(0))), lambda x: F.concat(x, F.lit("/"))), "")
    bases = F.when(relative, F.when(depth >= 0, F.array(near)).otherwise(F.array().cast("array<string>"))).otherwise(F.array(*map(F.lit, ROOTS)))
    lengths = F.when(F.size(parts) > 0, F.sequence(F.size(parts), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    stems = F.flatten(F.transform(bases, lambda b: F.transform(lengths, lambda n: F.concat(b, F.array_join(F.slice(parts, F.lit(1), n), "/")))))
    found = F.flatten(F.transform(stems, lambda s: F.array(F.concat(s, F.lit(".py")), F.concat(s, F.lit("/__init__.py")))))
    own = F.when(relative & (F.size(parts) == 0), F.transform(bases, lambda b: F.concat(b, F.lit("__init__.py"))))
    return F.coalesce(own, found)


def per_row(resolve: Callable[[str, str, bool], list[str]]) -> Resolver:
    """A resolver from a Python function of one import, for rules that columns can't express."""
    return F.udf(resolve, "array<string>")


#: How imports are resolved, by language.
RESOLVERS: dict[str, Resolver] = {"python": python_candidates}


def first_known(tried: DataFrame, known: DataFrame, key: list[str], rank: str = "rank", name: str = "candidate") -> DataFrame:
    """(key, resolved) of candidates (key, rank, candidate): the candidate of least rank that is among known, or null."""
    there = known.select(F.col(known.columns[0]).alias("known")).distinct()
    hit = tried.join(there, tried[name] == there["known"], "left")
    return hit.groupBy(*key).agg(F.min_by("known", F.when(F.col("known").isNotNull(), F.col(rank))).alias("resolved"))


def resolved_imports(parsed: DataFrame, found: DataFrame, resolvers: dict[str, Resolver] | None = None) -> DataFrame:
    """(file, ordinal, target_module, is_relative, alias, resolved): the first candidate file that exists, or null.

    A file of a language without a resolver has no rows: nothing is known of its imports.
    """
    chosen = dict(RESOLVERS if resolvers is None else resolvers)
    spoken = parsed.select("file", "imports").join(found.select(F.col("path").alias("file"), "language").where(F.col("language").isin(list(chosen))), "file")
    one = spoken.select("file", "language", F.posexplode("imports").alias("ordinal", "i")).select("file", "language", "ordinal", "i.*")
    ways = [(F.col("language") == x, resolve(F.col("file"), F.col("target_module"), F.col("is_relative"))) for x, resolve in chosen.items()]
    if not ways:
        return one.drop("language").withColumn("resolved", F.lit(None).cast("string"))
    candidates = reduce(lambda so_far, way: so_far.when(*way), ways[1:], F.when(*ways[0]))
    tried = one.select("*", F.posexplode_outer(candidates).alias("rank", "candidate"))
    return first_known(tried, found.select("path"), ["file", "ordinal", "target_module", "is_relative", "alias"])


def containment(symbols: DataFrame) -> DataFrame:
    """(src, dst, kind) from symbols (file, ordinal, kind, qualified_name, parent): what holds each symbol.

    A module, or a symbol without a parent, is held by its file; another by the file's last symbol of its parent's
    name.  An orphan, whose parent the file doesn't have, is held by the module of that name, if any file has it.
    """
    own = F.concat_ws("::", "kind", "qualified_name")
    top = F.col("parent").isNull() | (F.col("kind") == "module")
    outer = symbols.where(top).select(F.concat(F.lit("file::"), "file").alias("src"), own.alias("dst"))
    parents = symbols.groupBy("file", F.col("qualified_name").alias("parent")).agg(F.max_by("kind", "ordinal").alias("parent_kind"))
    met = symbols.where(~top).select("file", "parent", own.alias("dst")).join(parents, ["file", "parent"], "left")
    inner = met.where("parent_kind is not null").select(F.concat_ws("::", "parent_kind", "parent").alias("src"), "dst")
    modules = symbols.where("kind = 'module'").select(F.col("qualified_name").alias("parent")).distinct()
    orphans = met.where("parent_kind is null").join(modules, "parent", "left_semi").select(F.concat(F.lit("module::"), "parent").alias("src"), "dst")
    return outer.union(inner).union(orphans).withColumn("kind", F.lit("contains")).distinct()


def graph_of(found: DataFrame, parsed: DataFrame, resolvers: dict[str, Resolver] | None = None) -> KnowledgeGraph:
    """Nodes of files, symbols and modules, merged by id with the last value of each attribute; contains and imports edges.

    Files have path, language and size_bytes, symbols name, qualified_name, file, start_line and end_line; modules that
    are imported and not found are external, as are the edges to them.
    """
    symbols = parsed.select("file", F.posexplode("symbols").alias("ordinal", "s")).select("file", "ordinal", "s.*")
    file_nodes = found.select(F.concat(F.lit("file::"), "path").alias("id"), F.lit("file").alias("kind"), "path", F.col("path").alias("file"), "language", "size_bytes", F.lit(False).alias("external"), F.lit(0).alias("seq"))
    symbol_nodes = symbols.select(F.concat_ws("::", "kind", "qualified_name").alias("id"), "kind", "name", "qualified_name", "file", "start_line", "end_line", F.lit(False).alias("external"), (F.col("ordinal") + 1).alias("seq"))
    target = F.when(F.col("resolved").isNotNull(), module_of(F.col("resolved"))).otherwise(F.when(F.col("target_module") == "", "<unknown>").otherwise(F.col("target_module")))
    linked = resolved_imports(parsed, found, resolvers).select("file", "ordinal", "resolved", module_of(F.col("file")).alias("importer"), target.alias("imported"))
    module = lambda name, file, external: linked.select(F.concat(F.lit("module::"), name).alias("id"), F.lit("module").alias("kind"), F.col(name).alias("qualified_name"), F.col(file).alias("file"), external.alias("external"), F.lit(-1).alias("seq"))
    imported, importer = module("imported", "resolved", F.col("resolved").isNull()), module("importer", "file", F.lit(False)).withColumn("seq", F.lit(0))
    edges = linked.select(F.concat(F.lit("module::"), "importer").alias("src"), F.concat(F.lit("module::"), "imported").alias("dst"), F.lit("imports").alias("kind"), F.col("resolved").isNull().alias("external"), F.col("ordinal").alias("seq"))
    edges = distinct_edges(containment(symbols).unionByName(edges, allowMissingColumns=True))
    every = symbol_nodes
    for more in (file_nodes, imported, importer):
        every = every.unionByName(more, allowMissingColumns=True)
    nodes = merged_nodes(every)
    return KnowledgeGraph(nodes.unionByName(missing_endpoints(nodes, edges), allowMissingColumns=True), edges)


def analyze(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, KnowledgeGraph]:
    found = files(spark, path).cache()
    parsed = parsed_files(found).cache()
    return found, parsed, graph_of(found.drop("content"), parsed)
