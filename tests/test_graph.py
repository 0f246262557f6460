"""Graph operators: the one-task searches and the joins give the same rows, on small and on random graphs."""

import random

import pytest
from codeloom.operators import graph


def edges(spark, pairs, kind="imports"):
    return spark.createDataFrame([(a, b, kind) for a, b in pairs], "src string, dst string, kind string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def brute_scc(pairs):
    reach = {}
    for start in {x for p in pairs for x in p}:
        seen, todo = set(), [start]
        while todo:
            for a, b in pairs:
                if a == todo[0] and b not in seen:
                    seen.add(b)
                    todo.append(b)
            todo.pop(0)
        reach[start] = seen
    return sorted((a, min(b for b in reach if b in reach[a] and a in reach[b])) for a in reach if a in reach[a])


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(34)]
    want = brute_scc(pairs)
    assert rows(graph.components_by_reach(edges(spark, pairs))) == want
    assert rows(graph.components_by_reach(edges(spark, pairs), one_task=0)) == want


def test_components_null_empty_and_repeated(spark):
    assert rows(graph.components_by_reach(edges(spark, []))) == []
    assert rows(graph.components_by_reach(edges(spark, [("a", None), (None, "a"), ("b", "b"), ("b", "b")]))) == [("b", "b")]


@pytest.mark.parametrize("upstream", [False, True])
def test_bfs_both_ways(spark, upstream):
    rng = random.Random(7)
    pairs = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(70)]
    e = edges(spark, pairs)
    assert rows(graph.bfs(e, "n1", 4, upstream=upstream)) == rows(graph.bfs(e, "n1", 4, upstream=upstream, one_task=0))
    assert rows(graph.bfs(e, "absent", 4, upstream=upstream)) == []


def test_graph_interface(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "c")]).unionByName(edges(spark, [("a", "b")], "calls"))
    g = graph.KnowledgeGraph(spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), e)
    assert rows(g.neighbors("a")) == [("b",), ("b",)]
    assert rows(g.neighbors("a", "imports", "both")) == [("b",), ("b",)]
    with pytest.raises(graph.NodeNotFoundError):
        g.neighbors("z")
    with pytest.raises(ValueError):
        g.neighbors("a", direction="sideways")
    assert [r.members for r in g.find_cycles("imports").collect()] == [["a", "b"]]
    assert g.find_cycles("calls").count() == 0
    assert rows(g.subgraph(spark.createDataFrame([("a",), ("b",)], "id string")).edges) == [("a", "b", "calls"), ("a", "b", "imports"), ("b", "a", "imports")]
    assert rows(g.root_causes("c")) == [("a", 2), ("b", 1)]
    nodes, links = g.dump()
    assert [r.value for r in nodes.collect()] == ['{"id":"a"}', '{"id":"b"}', '{"id":"c"}'] and links.count() == 4


def test_growing_a_graph(spark):
    nodes = spark.createDataFrame([("a", "file", None), ("b", None, 3)], "id string, kind string, size int")
    one = graph.KnowledgeGraph(nodes, edges(spark, [("a", "b")]))
    two = one.add_node("a", size=7).add_node("c", colour="red").add_edge("b", "d", "calls").add_edge("b", "d", "calls").add_edge("a", "b", "imports")
    assert rows(two.nodes.select("id", "kind", "size", "colour")) == [("a", "file", 7, None), ("b", None, 3, None), ("c", None, None, "red"), ("d", None, None, None)]
    assert rows(two.edges) == [("a", "b", "imports"), ("b", "d", "calls")] and one.node_count() == 2


@pytest.mark.parametrize("seed", range(2))
def test_shortest_path(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(12):02}", f"n{rng.randrange(12):02}") for _ in range(18)]
    names = sorted({x for p in pairs for x in p})
    g = graph.KnowledgeGraph(spark.createDataFrame([(x,) for x in names], "id string"), edges(spark, pairs))
    paths = {names[0]: [names[0]]}
    front = [names[0]]
    while front:  # brute force: distances
        front = [b for a, b in pairs if a in front and b not in paths and not paths.update({b: paths[a] + [b]})]
    for end in names[:5]:
        got = g.shortest_path(names[0], end)
        assert len(got) == len(paths.get(end, [])) and all(p in pairs for p in zip(got, got[1:]))
        assert not got or (got[0], got[-1]) == (names[0], end)
