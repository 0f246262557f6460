"""Broken and deep source, ignore files, patches in order, attributes of graphs, sandbox and clone."""

import sys

import pytest
from codeloom import errors
from codeloom.functions import parse
from codeloom.operators import analysis, graph, patching, retrieval, sandbox
from codeloom.sources import acquire, ecosystem, repository
from pyspark.sql import functions as F

DEEP = ["x = " + "1+" * 3000 + "1", "x = " + "-" * 3000 + "1", "x" + ".a" * 2000, "if a:\n    pass\n" + "elif b:\n    pass\n" * 2000, "x = " + "(" * 5000]


@pytest.mark.parametrize("source", DEEP)
def test_deep_source_never_raises(source):
    file, symbols, _, problems, _, _ = parse.parse("a.py", source.encode())
    assert file == "a.py" and (problems or symbols[0][1] == "a")


def test_deep_source_as_a_column(spark):
    rows = spark.createDataFrame([(k, s) for k, s in enumerate([*DEEP, "x = 1", None])], "k int, s string")
    got = {r.k: r.p for r in rows.select("k", patching.syntax_problem(F.lit("A.PY"), F.col("s")).alias("p")).collect()}
    assert got[5] is None and got[6] is None and got[4] is not None


def test_broken_source_gives_what_stands_beside_the_break():
    source = b"import os\n@deco\ndef f():\n    return 1\ndef broken( :\n    pass\nclass A:\n    def m(self):\n        pass\n"
    _, symbols, imports, problems, _, _ = parse.parse("p/m.py", source)
    assert [(s[1], s[2], s[4], s[5]) for s in symbols] == [("p.m", "module", 0, 9), ("f", "function", 2, 3), ("A", "class", 6, 8), ("A.m", "method", 7, 8)]
    assert [i[0] for i in imports] == ["os"] and len(problems) == 1
    with pytest.raises(errors.ParseError):
        parse.parse_strictly("p/m.py", source)
    with pytest.raises(errors.UnsupportedLanguageError):
        parse.parser_for("cobol")


def test_ranges_are_of_bytes():
    source = "x = 'é'\nif x:\n    def ü(): pass\n".encode()
    s = parse.parse("a.py", source)[1][1]
    assert s[:3] == ("ü", "ü", "function") and source[s[8] : s[9]].decode() == "def ü(): pass" and s[6] == 4


@pytest.mark.parametrize(("rules", "path", "is_dir", "want"), [
    ("*.py[co]", "a/b.pyc", False, True), ("*.py[co]", "a/b.py", False, False), ("f[!0-9]", "fx", False, True), ("f[!0-9]", "f1", False, False), ("[]a]x", "]x", False, True), (r"\#x", "#x", False, True), (r"\!x", "!x", False, True),
    (r"a\*", "a*", False, True), (r"a\*", "ab", False, False), ("x\\ ", "x ", False, True), ("/top", "sub/top", False, False), ("a/**/z", "a/z", False, True), ("a/**/z", "a/b/c/z", False, True), ("a/**", "a/b", False, True), ("**/q", "w/q", False, True),
    ("d/", "d", False, False), ("d/", "x/d", True, True), ("*.log\n!keep.log", "keep.log", False, False), ("[z-a]", "b", False, False), ("q?z", "q/z", False, False), ("[", "[", False, True),
])
def test_ignore_rules(rules, path, is_dir, want):
    assert repository.ignored(repository.ignore_rules(rules), path, is_dir) is want


def test_walk_order_and_tasks(spark, tmp_path):
    for name in ("b.py", "a.py", "z/1.py", "m/n/2.py", "m/3.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    (tmp_path / "out").symlink_to("/etc/hostname")
    found = analysis.files(spark, str(tmp_path))
    assert [r.path for r in found.orderBy("ordinal").collect()] == ["a.py", "b.py", "m/3.py", "m/n/2.py", "z/1.py"]
    assert len(repository.RepositoryReader({"path": str(tmp_path)}).partitions()) == 1
    with pytest.raises(errors.UnsupportedRepositoryError):
        repository.RepositoryReader({"path": str(tmp_path / "a.py")})


def test_edits_in_order(spark):
    base = spark.createDataFrame([("f", "old"), ("g", "kept"), ("h", "gone")], "path string, content string")
    edits = spark.createDataFrame([("f", "v1", False, 1), ("f", "v2", None, 2), ("h", None, True, 1), ("new", "x", False, 1), ("new", None, True, 2)], "path string, new_content string, is_deletion boolean, ordinal int")
    version = patching.applied(base, edits)
    assert sorted(map(tuple, version.collect())) == [("f", "v2"), ("g", "kept")]
    back = patching.rolled_back(version, patching.snapshot(base, edits))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, base.collect()))


def test_diffs(spark):
    base = spark.createDataFrame([("a", "one\ntwo"), ("b", "x\n")], "path string, content string")
    edits = spark.createDataFrame([(1, 2, "b", None, True), (1, 1, "a", "one\n2", False), (1, 3, "c", "", False), (1, 4, "none", None, True), (2, 1, "b", "x\n", False)], "patch_id int, ordinal int, path string, new_content string, is_deletion boolean")
    got = {r.patch_id: (r.diff, r.new_files) for r in patching.patch_diffs(base, edits).collect()}
    assert got[1] == ("--- a/a\n+++ b/a\n@@ -1,2 +1,2 @@\n one\n-two+2\n--- a/b\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n--- /dev/null\n+++ b/c\n@@ -0,0 +1 @@\n+\n", 1)
    assert got[2] == ("", 0)


def test_edges_keep_attributes(spark):
    e = spark.createDataFrame([("a", "b", "k", True, 1), ("a", "b", "k", False, 2), ("a", "b", "l", None, 1)], "src string, dst string, kind string, external boolean, seq int")
    assert sorted(map(tuple, graph.distinct_edges(e).collect())) == [("a", "b", "k", False), ("a", "b", "l", None)]
    g = graph.KnowledgeGraph(spark.createDataFrame([("a",)], "id string"), graph.distinct_edges(e)).add_edge("a", "c", "k", external=True)
    assert g.edges.where("dst = 'c'").first().external is True and g.edge_count() == 3
    with pytest.raises(errors.GraphError):
        graph.KnowledgeGraph(e, e)


def test_search_for_many_equals_plain(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TILE", 3)
    vectors = [(k, [float((k * 7) % 5), float(k % 3), 1.0]) for k in range(20)] + [(20, None), (21, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {}
    for r in retrieval.nearest_to_each(df, df.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id"), 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for q in (0, 10):
        a = dict(vectors)[q]
        best = sorted((-round(dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5, 6), k) for k, b in vectors[:20])[:4]
        assert sorted(got[q]) == [(n + 1, k, -s) for n, (s, k) in enumerate(best)]
    assert set(got) == {0, 10}


def test_output_of_commands_and_children(tmp_path):
    got = sandbox.run([sys.executable, "-c", "import subprocess, sys; subprocess.Popen(['sleep', '30']); print('a' * 200000); print('b', file=sys.stderr)"], str(tmp_path), timeout=10)
    assert got.succeeded and len(got.stdout) == 200001 and got.stderr == b"b\n" and got.duration_seconds < 10
    with pytest.raises(errors.SandboxTimeoutError):
        sandbox.run(["sh", "-c", "trap '' TERM; sleep 10"], str(tmp_path), timeout=0.3, grace=0.1)


def test_passing_faults_are_tried_again(tmp_path, monkeypatch):
    ended, pauses = [acquire.Attempt("Connection timed out", True), acquire.Attempt("RPC failed", True), acquire.Attempt()], []
    monkeypatch.setattr(acquire, "_git", lambda arguments, seconds: ended.pop(0))
    assert acquire.clone("https://h/r.git", chosen=acquire.Settings(workdir=tmp_path), sleep=pauses.append).name.startswith("r-")
    assert pauses == [1, 4] and not ended


def test_many_repositories_at_once(spark):
    names = spark.createDataFrame([("a", "go.mod", None), ("a", "x/y.py", None), ("a", "x/z.py", None), ("b", "README", None), ("b", "a/b/c/d/e/f.py", None), ("b", ".x/f.py", None)], "repo string, path string, text string")
    got = {r.repo: (r.languages, r.build_systems, r.has_ci) for r in ecosystem.described(names).collect()}
    assert got == {"a": (["go", "python"], ["go_modules"], False), "b": ([], [], False)}
