"""A typed property graph as two DataFrames: nodes (id, ...) and edges (src, dst, kind, ...)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import GraphError, NodeNotFoundError


#: Edges that one task searches alone: about 200 MB of Python objects.
ONE_TASK = 500_000


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that the cluster shares; a purely local session may use a temporary one."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"{tempfile.gettempdir()}/codeloom-{uuid.uuid4().hex}")
    return df.checkpoint()


def merged_nodes(rows: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """One row for each key: of each attribute the last value by `order` that isn't null."""
    others = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in others])


def distinct_edges(rows: DataFrame) -> DataFrame:
    """One edge for each (src, dst, kind); of further columns the last value by `seq` that isn't null, without seq the largest."""
    others = [c for c in rows.columns if c not in ("src", "dst", "kind", "seq")]
    if not others:
        return rows.select("src", "dst", "kind").distinct()
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.coalesce("seq", F.lit(0)))) if "seq" in rows.columns else F.max(c)
    return rows.groupBy("src", "dst", "kind").agg(*[last(c).alias(c) for c in others])


def missing_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids that edges name and nodes lacks."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti")


def _fits(pairs: DataFrame, most: int) -> bool:
    """Whether the edges are few enough for one task; stops counting there."""
    return pairs.limit(most + 1).count() <= most


def _reached(start, depth: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:  # noqa: ANN001
    """Breadth-first search over the rows of one task."""

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        after: dict = {}
        for frame in frames:
            for a, b in zip(frame["from"].tolist(), frame["to"].tolist()):
                after.setdefault(a, []).append(b)
        seen, front = {start: 0}, [start]
        for level in range(1, depth + 1):
            front = list(dict.fromkeys(b for a in front for b in after.get(a, ()) if b not in seen))
            seen.update((b, level) for b in front)
        del seen[start]
        if seen:
            yield pd.DataFrame({"id": list(seen), "depth": list(seen.values())})

    return kernel


def bfs(edges: DataFrame, start, depth: int = 5, kind: str | list[str] | None = None, upstream: bool = False, one_task: int = ONE_TASK) -> DataFrame:  # noqa: ANN001
    """(id, depth) of nodes within `depth` steps of start, which is left out; depth is the shortest distance.

    kind is one kind of edge, several, or None for all.  At most `one_task` edges are searched in a single task; more
    are joined level by level, with the same rows.  An unknown start gives no rows.
    """
    step = edges if kind is None else edges.where(F.col("kind").isin([kind] if isinstance(kind, str) else list(kind)))
    step = step.select(F.col("dst" if upstream else "src").alias("from"), F.col("src" if upstream else "dst").alias("to")).where("from is not null and to is not null").distinct()
    schema = f"id {step.schema['from'].dataType.simpleString()}, depth int"
    step = cut_lineage(step)
    if _fits(step, one_task):
        return step.repartition(1).mapInPandas(_reached(start, depth), schema)
    seen = edges.sparkSession.createDataFrame([(start, 0)], schema)
    front = seen
    for level in range(1, depth + 1):
        reached = step.join(front, step["from"] == front["id"]).select(F.col("to").alias("id")).distinct()
        front = cut_lineage(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def _components(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Strongly connected components over the rows of one task: two depth-first passes, the second on reversed edges."""
    parts = [f for f in frames if len(f)]
    if not parts:
        return
    rows = pd.concat(parts)
    codes, ids = pd.factorize(pd.concat([rows["src"], rows["dst"]], ignore_index=True))
    src, dst, n = codes[: len(rows)], codes[len(rows) :], len(ids)

    def adjacency(a: np.ndarray, b: np.ndarray) -> tuple[list, list]:
        order = np.argsort(a, kind="stable")
        return np.searchsorted(a[order], np.arange(n + 1)).tolist(), b[order].tolist()

    first, to = adjacency(src, dst)
    seen, finished = bytearray(n), []
    at = first[:n]
    for root in range(n):
        stack = [] if seen[root] else [root]
        seen[root] = 1
        while stack:
            v = stack[-1]
            if at[v] == first[v + 1]:
                finished.append(stack.pop())
                continue
            w = to[at[v]]
            at[v] += 1
            if not seen[w]:
                seen[w] = 1
                stack.append(w)
    first, to = adjacency(dst, src)
    component = np.full(n, -1)
    for root in reversed(finished):
        stack = [root] if component[root] < 0 else []
        while stack:
            v = stack.pop()
            component[v] = root
            stack += [w for w in dict.fromkeys(to[first[v] : first[v + 1]]) if component[w] < 0]
    out = pd.DataFrame({"id": ids, "component": component})
    grouped = out.groupby("component")["id"]
    out["scc"], out["size"] = grouped.transform("min"), grouped.transform("size")
    loops = rows["src"][(rows["src"] == rows["dst"])]
    yield out[(out["size"] > 1) | out["id"].isin(loops)][["id", "scc"]]


def components_by_reach(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(id, scc) of the strongly connected components of (src, dst), trivial ones left out; scc is the least member.

    A node with a loop of its own is a component too; edges with a null end don't count.  At most `one_task` distinct
    edges are one task's work; for more, the components are found by joins, with the same rows.
    """
    pairs = cut_lineage(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    if _fits(pairs, one_task):
        kind = pairs.schema["src"].dataType.simpleString()
        return pairs.repartition(1).mapInPandas(_components, f"id {kind}, scc {kind}")
    return components_by_joins(pairs)


def components_by_joins(pairs: DataFrame) -> DataFrame:
    """The components of distinct (src, dst), of any number of edges.

    Nodes without in- or out-edges are trimmed first, again and again.  Then the least id that reaches a node along
    edges is its colour, and what the colour's root reaches backward within the colour is a component; these go and
    the rest is done again.  Work is joins over edges; lineage is cut each round.
    """
    loops = pairs.where("src = dst").select(F.col("src").alias("id"))
    rest = cut_lineage(pairs.where("src <> dst"))
    found = None
    while True:
        before = -1
        while (now := rest.count()) != before:
            before = now
            if not now:
                break
            kept = rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            rest = cut_lineage(kept.select("src", "dst"))
        if not now:
            break
        nodes = rest.select(F.col("src").alias("id")).union(rest.select("dst")).distinct()
        colour, moved = cut_lineage(nodes.withColumn("colour", F.col("id"))), True
        while moved:
            sent = rest.join(colour, rest["src"] == colour["id"]).select(F.col("dst").alias("id"), "colour")
            own = colour.withColumn("old", F.col("colour")).unionByName(sent, allowMissingColumns=True)
            colour = cut_lineage(own.groupBy("id").agg(F.min("colour").alias("colour"), F.min("old").alias("old")))
            moved, colour = not colour.where("colour <> old").isEmpty(), colour.drop("old")
        one, two = colour.select(F.col("id").alias("src"), F.col("colour").alias("cs")), colour.select(F.col("id").alias("dst"), F.col("colour").alias("cd"))
        inner = cut_lineage(rest.join(one, "src").join(two, "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("colour")))
        member = cut_lineage(colour.where("id = colour"))
        while True:
            reach = inner.join(member.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"), "colour").distinct()
            fresh = cut_lineage(reach.join(member, "id", "left_anti"))
            if fresh.isEmpty():
                break
            member = cut_lineage(member.unionByName(fresh))
        big = member.join(member.groupBy("colour").count().where("count > 1"), "colour", "left_semi").select("id", F.col("colour").alias("scc"))
        found = big if found is None else found.unionByName(big)
        gone = member.select("id")
        rest = rest.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        rest = cut_lineage(rest.select("src", "dst"))
    lone = loops.withColumn("scc", F.col("id"))
    return lone if found is None else found.unionByName(lone.join(found, "id", "left_anti"))


class KnowledgeGraph:
    """nodes: at least (id); edges: at least (src, dst, kind)."""

    def __init__(self, nodes: DataFrame, edges: DataFrame) -> None:
        if missing := ({"id"} - set(nodes.columns)) | ({"src", "dst", "kind"} - set(edges.columns)):
            raise GraphError(f"columns are missing: {', '.join(sorted(missing))}")
        self.nodes, self.edges = nodes, edges

    def _needs(self, node) -> None:  # noqa: ANN001
        if not self.has_node(node):
            raise NodeNotFoundError(node)

    def neighbors(self, node, kind: str | None = None, direction: str = "out") -> DataFrame:  # noqa: ANN001
        """Neighbours, one for each parallel edge; both directions are appended, duplicates kept."""
        if direction not in ("out", "in", "both"):
            raise ValueError(direction)
        self._needs(node)
        edges = self.edges if kind is None else self.edges.where(F.col("kind") == kind)
        out = edges.where(F.col("src") == node).select(F.col("dst").alias("id"))
        into = edges.where(F.col("dst") == node).select(F.col("src").alias("id"))
        return out if direction == "out" else into if direction == "in" else out.unionAll(into)

    def downstream(self, node, kind: str | None = None, max_depth: int = 5) -> DataFrame:  # noqa: ANN001
        return bfs(self.edges, node, max_depth, kind)

    def upstream(self, node, kind: str | None = None, max_depth: int = 5) -> DataFrame:  # noqa: ANN001
        return bfs(self.edges, node, max_depth, kind, upstream=True)

    def find_cycles(self, kind: str | None = None) -> DataFrame:
        """(scc, members sorted)."""
        edges = self.edges if kind is None else self.edges.where(F.col("kind") == kind)
        return components_by_reach(edges).groupBy("scc").agg(F.sort_array(F.collect_set("id")).alias("members"))

    def node_attrs(self, node) -> dict:  # noqa: ANN001
        self._needs(node)
        return self.nodes.where(F.col("id") == node).first().asDict()

    def has_node(self, node) -> bool:  # noqa: ANN001
        return not self.nodes.where(F.col("id") == node).isEmpty()

    def all_nodes(self) -> DataFrame:
        return self.nodes.select("id")

    def add_nodes(self, rows: DataFrame) -> KnowledgeGraph:
        """The graph with rows (id, attributes) too; of an attribute the later value that isn't null holds."""
        both = self.nodes.withColumn("seq", F.lit(0)).unionByName(rows.withColumn("seq", F.lit(1)), allowMissingColumns=True)
        return KnowledgeGraph(merged_nodes(both), self.edges)

    def add_node(self, node, **attributes) -> KnowledgeGraph:  # noqa: ANN001
        columns = [F.lit(v).alias(k) for k, v in attributes.items()]
        return self.add_nodes(self.nodes.sparkSession.range(1).select(F.lit(node).alias("id"), *columns))

    def add_edges(self, rows: DataFrame) -> KnowledgeGraph:
        """The graph with rows (src, dst, kind) too; ends that aren't nodes become nodes without attributes."""
        both = self.edges.withColumn("seq", F.lit(0)).unionByName(rows.withColumn("seq", F.lit(1)), allowMissingColumns=True)
        edges = distinct_edges(both)
        return KnowledgeGraph(self.nodes.unionByName(missing_endpoints(self.nodes, edges), allowMissingColumns=True), edges)

    def add_edge(self, src, dst, kind: str, **attributes) -> KnowledgeGraph:  # noqa: ANN001
        columns = [F.lit(v).alias(k) for k, v in {"src": src, "dst": dst, "kind": kind, **attributes}.items()]
        return self.add_edges(self.nodes.sparkSession.range(1).select(*columns))

    def shortest_path(self, start, end, kind: str | None = None, max_depth: int = 20) -> list:  # noqa: ANN001
        """Ids from start to end along a shortest path, of several the one that is least from its end; empty if none.

        One search gives distances; then one row a step is read, max_depth at most.
        """
        self._needs(start)
        if start == end:
            return [start]
        depth = cut_lineage(bfs(self.edges, start, max_depth, kind))
        last = depth.where(F.col("id") == end).first()
        if last is None:
            return []
        edges = self.edges if kind is None else self.edges.where(F.col("kind") == kind)
        path = [end]
        for level in range(last["depth"] - 1, 0, -1):
            into = edges.where(F.col("dst") == path[0]).select(F.col("src").alias("id"))
            path.insert(0, into.join(depth.where(F.col("depth") == level), "id").agg(F.min("id")).first()[0])
        return [start, *path]

    def subgraph(self, ids: DataFrame) -> KnowledgeGraph:
        """The nodes named by ids (id) and the edges between them."""
        kept = ids.select("id").distinct()
        edges = self.edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return KnowledgeGraph(self.nodes.join(kept, "id", "left_semi"), edges.select(self.edges.columns))

    def root_causes(self, node, max_depth: int = 5) -> DataFrame:  # noqa: ANN001
        """What node depends on backward along calls and imports."""
        return bfs(self.edges, node, max_depth, ["calls", "imports"], upstream=True)

    def dump(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges as JSON lines (column value), ordered, ready for `write.text`."""
        nodes = self.nodes.orderBy("id").select(F.to_json(F.struct("*")).alias("value"))
        return nodes, self.edges.orderBy("src", "dst", "kind").select(F.to_json(F.struct("*")).alias("value"))

    def node_count(self) -> int:
        return self.nodes.count()

    def edge_count(self) -> int:
        return distinct_edges(self.edges).count()


def kept_until_failure(results: DataFrame, group: str, order: list, verdict: str = "verdict") -> DataFrame:
    """Rows up to and with the first FAIL or ERROR of each group."""
    before = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    failed = F.coalesce(F.sum(F.col(verdict).isin("FAIL", "ERROR").cast("int")).over(before), F.lit(0))
    return results.withColumn("failed_before", failed).where("failed_before = 0").drop("failed_before")
