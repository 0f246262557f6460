"""A small source tree from scan to findings."""

import pytest
from pyspark.sql import functions as F
from codeloom.operators import analysis

TREE = {
    "pkg/__init__.py": "", "pkg/a.py": "from __future__ import annotations\nfrom pkg import b\nX = 1\ndef f():\n    pass\nclass A:\n    def one(self):\n        pass\n    def two(self):\n        def nested():\n            pass\n",
    "pkg/b.py": "from pkg import a\ndef g():\n    pass\n", "pkg/c.py": "import json\nfrom . import a\n", "README.md": "hello", ".gitignore": "skip/\n*.log\n!keep.log\n", "skip/x.py": "import os", "a.log": "", "keep.log": "", "bad.py": "def broken( :", "node_modules/m.js": "1",
}


@pytest.fixture(scope="module")
def analysed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "bin.dat").write_bytes(b"\0\1")
    return analysis.analyze(spark, str(root))


def test_walk(analysed):
    rows = {r.path: r for r in analysed[0].collect()}
    assert set(rows) == {"pkg/__init__.py", "pkg/a.py", "pkg/b.py", "pkg/c.py", "README.md", ".gitignore", "keep.log", "bad.py", "bin.dat"}
    assert rows["bin.dat"].is_binary and rows["pkg/a.py"].language == "python"


def test_symbols(analysed):
    row = analysed[1].where("file = 'pkg/a.py'").first()
    assert [(s.qualified_name, s.kind) for s in row.symbols] == [("pkg.a", "module"), ("f", "function"), ("A", "class"), ("A.one", "method"), ("A.two", "method"), ("A.two.nested", "function")]
    assert analysed[1].where("size(parse_errors) > 0").count() == 1


def test_graph_and_findings(analysed):
    graph = analysed[2]
    edges = {(r.src, r.dst) for r in graph.edges.where("kind = 'imports'").collect()}
    assert edges == {("module::pkg.a", "module::pkg.b"), ("module::pkg.b", "module::pkg.a"), ("module::pkg.c", "module::json"), ("module::pkg.c", "module::pkg.a")}
    assert {r.id for r in graph.downstream("module::pkg.c", kind="imports").collect()} == {"module::pkg.a", "module::pkg.b", "module::json"}
    (finding,) = analysis.scan(graph)
    assert finding.modules == ["pkg.a", "pkg.b"]
    with pytest.raises(analysis.DetectionError):
        analysis.scan(graph, ["no_such_rule"])


def test_another_language(spark, tmp_path):
    from codeloom.operators import analysis

    (tmp_path / "one.toy").write_text("use two")
    (tmp_path / "two.toy").write_text("")
    found = analysis.files(spark, str(tmp_path), {".toy": "toy"})
    assert {r["language"] for r in found.collect()} == {"toy"}

    def toy(path, source):
        return path, [], [(line.split()[1], False, None) for line in source.decode().splitlines()], [], [], []

    parsed = analysis.parsed_files(found, {"toy": toy})
    got = analysis.resolved_imports(parsed, found, {"toy": analysis.per_row(lambda file, target, relative: [f"{target}.toy"])}).collect()
    assert [(r["file"], r["target_module"], r["resolved"]) for r in got] == [("one.toy", "two", "two.toy")]
    assert analysis.resolved_imports(parsed, found).count() == 0
    graph = analysis.graph_of(found, parsed, {"toy": lambda file, target, relative: F.array(F.concat(target, F.lit(".toy")))})
    assert [(r.src, r.dst, r.external) for r in graph.edges.where("kind = 'imports'").collect()] == [("module::one", "module::two", False)]
    assert analysis.parsed_files(found).count() == 0
