"""Sources, rules, patches, validation, sandbox, command line, HTTP and the stream of changes."""

import json
import subprocess
import sys

import pytest
from codeloom import cli, errors
from codeloom.config import Settings
from codeloom.http import Routes
from codeloom.operators import analysis, patching, retrieval, rules, sandbox, validation
from codeloom.service import AnalysisService
from codeloom.sources import acquire, ecosystem, issues
from codeloom.streaming import changes


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo") / "tiny"
    (root / "pkg").mkdir(parents=True)
    (root / "pyproject.toml").write_text("[tool.poetry]\n[tool.pytest.ini_options]\n")
    (root / "Dockerfile.dev").write_text("")
    (root / ".github" / "workflows").mkdir(parents=True)
    (root / "pkg" / "__init__.py").write_text("")
    (root / "pkg" / "a.py").write_text("from pkg import b\nimport os\ndef f(x=[]):\n    return b.g()\ndef lonely():\n    try:\n        f()\n    except Exception:\n        pass\ntoken = 'aB3dE5gH7jK9mN1pQ'\n")
    (root / "pkg" / "b.py").write_text("from pkg import a\ndef g():\n    for u in range(3):\n        db.session.query(u).first()\n    return a.f\nasync def h():\n    with lock:\n        await g()\n")
    (root / "test_a.py").write_text("from pkg.a import f\nf()\n")
    (root / "web.ts").write_text("")
    deep = root / "1" / "2" / "3" / "4" / "5"
    deep.mkdir(parents=True)
    (deep / "too_deep.go").write_text("")
    (deep.parent / "deep.rs").write_text("")
    return root


def test_sources(tree, tmp_path):
    assert acquire.is_address("git@host:x/y") and acquire.is_address("/tmp/x.git") and not acquire.is_address("/tmp/x")
    assert acquire.slug("https://host/some.thing.git/") == "some-thing" and acquire.slug("https://") == "https-" and len(acquire.slug("https://h/" + "x" * 90)) == 48
    assert [acquire.pause_after(n) for n in (1, 2, 3, 4)] == [1, 4, 16, 16]
    assert acquire.acquire(str(tree)) == (tree.resolve(), None)
    for bad in ("/no/such/path",):
        with pytest.raises(errors.IngestionError):
            acquire.acquire(bad)


def test_clone(tree, tmp_path):
    origin = tmp_path / "origin.git"
    git = ["git", "-c", "user.name=t", "-c", "user.email=t@example.org"]
    subprocess.run([*git, "init", "-q", str(origin)], check=True)
    (origin / "x.py").write_text("x = 1\n")
    subprocess.run([*git, "-C", str(origin), "add", "."], check=True)
    subprocess.run([*git, "-C", str(origin), "commit", "-qm", "x"], check=True)
    root = acquire.clone(str(origin), chosen=Settings(workdir=tmp_path / "w"))
    assert (root / "x.py").is_file() and len(acquire.commit_of(root)) == 40
    with pytest.raises(errors.CloneError):
        acquire.clone(str(tmp_path / "absent.git"), chosen=Settings(workdir=tmp_path / "w"), sleep=lambda s: pytest.fail("not transient"))
    assert [p.name for p in (tmp_path / "w" / "clones").iterdir()] == [root.name]


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("CODELOOM_LOG_LEVEL=DEBUG\nCODELOOM_GIT_TIMEOUT_SECONDS=5\n# x\n")
    monkeypatch.setenv("CODELOOM_GIT_TIMEOUT_SECONDS", "7")
    got = Settings.load(str(tmp_path / ".env"))
    assert (got.log_level, got.git_timeout_seconds, got.sandbox_default_timeout) == ("DEBUG", 7, 60)
    with pytest.raises(ValueError):
        Settings(log_level="LOUD")


def test_ecosystem(spark, tree):
    got = ecosystem.detect(spark, str(tree))
    assert got.languages == ("python", "rust", "typescript") and got.build_systems == ("pip", "poetry")
    assert got.test_frameworks == ("pytest",) and got.has_dockerfile and got.has_ci and got.package_managers == ()
    assert ecosystem.detect(spark, "/no/such") == ecosystem.Ecosystem()


def test_issues(spark, tmp_path):
    (tmp_path / "7.json").write_text(json.dumps({"title": "t", "labels": ["x"], "metadata": {"repo": "own", "k": "v"}}))
    (tmp_path / "8.json").write_text("{broken")
    got = issues.fetch(spark, str(tmp_path), "r", 7)
    assert (got.number, got.title, got.body, got.labels, got.metadata) == ("7", "t", "", ["x"], {"repo": "own", "k": "v"})
    for bad in (8, 9):
        with pytest.raises(errors.EngineError):
            issues.fetch(spark, str(tmp_path), "r", bad)


def test_rules(spark, tree):
    found, parsed, graph = analysis.analyze(spark, str(tree))
    got = {(r.rule_id, r.file, r.name) for r in rules.full_registry().findings(rules.Subject(graph, parsed)).collect()}
    assert got == {
        ("circular_imports", "pkg/a.py", None), ("unused_imports", "pkg/a.py", "os"), ("mutable_default_args", "pkg/a.py", "f"), ("broad_except", "pkg/a.py", "Exception"),
        ("hardcoded_secret", "pkg/a.py", "token"), ("n_plus_one_query", "pkg/b.py", "db.session.query.first"), ("async_deadlock", "pkg/b.py", "lock"),
        ("dead_code", "pkg/a.py", "lonely"), ("dead_code", "pkg/b.py", "h"), ("missing_test_coverage", "pkg/a.py", "lonely"), ("missing_test_coverage", "pkg/b.py", "g"), ("missing_test_coverage", "pkg/b.py", "h"),
    }
    registry = rules.default_registry()
    with pytest.raises(ValueError):
        registry.register("circular_imports", rules.circular_imports)
    registry.register("broken", lambda s: 1 / 0)
    assert registry.findings(rules.Subject(graph, parsed)).count() == 1
    assert registry.findings(rules.Subject(graph, parsed), []) is None
    chunks = parsed.select("file", "symbols").selectExpr("file", "inline(symbols)").selectExpr("file", "kind", "cast(null as string) parent_kind", "start_line", "end_line")
    texts = found.selectExpr("path as file", "decode(content, 'UTF-8') as text")
    assert "def g():" in {r.body.split("\n")[0] for r in retrieval.code_chunks(chunks, texts).collect()}


def test_working_copy(tmp_path):
    (tmp_path / "a").write_text("old")
    copy = patching.WorkingCopy(str(tmp_path))
    copy.apply([("a", "new", False), ("d/b", "made", False)])
    assert (tmp_path / "a").read_text() == "new" and (tmp_path / "d/b").read_text() == "made"
    copy.apply([])
    copy.rollback()
    assert (tmp_path / "a").read_text() == "old" and not (tmp_path / "d/b").exists()
    with pytest.raises(errors.PatchError):
        copy.rollback()
    with pytest.raises(errors.PatchError):
        copy.apply([("a", "new", False), ("a/below", "a file is no folder", False)])
    assert (tmp_path / "a").read_text() == "old"
    with pytest.raises(errors.PatchError):
        copy.apply([("../out", "x", False)])


def test_validation(spark):
    edits = spark.createDataFrame([("ok", "a.py", "x: int = 1", False), ("bad", "B.PY", "def broken( :", False), ("bad", "c.md", "def broken( :", False), ("gone", "d.py", None, True), ("null", "e.py", None, False)], "patch_id string, path string, content string, is_deletion boolean")
    shown = []

    def warns(e):
        shown.extend(sorted(r.patch_id for r in e.collect()))
        return e.selectExpr("patch_id", "'WARN' as verdict", "'hm' as summary").distinct()

    results, reports = validation.validated(edits, [("syntax", validation.syntax), ("warns", warns)])
    assert {r.patch_id: r.overall for r in reports.collect()} == {"ok": "WARN", "bad": "FAIL", "gone": "WARN", "null": "FAIL"}
    assert shown == ["gone", "ok"] and results.where("patch_id = 'bad'").count() == 1
    results, reports = validation.validated(edits, [("crash", lambda e: 1 / 0), ("warns", warns)])
    assert {r.overall for r in reports.collect()} == {"FAIL"} and {r.verdict for r in results.collect()} == {"ERROR"}
    assert {r.overall for r in validation.validated(edits, [])[1].collect()} == {"PASS"}


def test_sandbox(tmp_path, monkeypatch):
    monkeypatch.setenv("SOME_SECRET", "x")
    show = [sys.executable, "-c", "import os; print(os.environ.get('SOME_SECRET'), os.environ.get('GIVEN'))"]
    assert sandbox.run(show, str(tmp_path), {"GIVEN": "1"}).stdout == b"None 1\n"
    assert sandbox.run([sys.executable, "-c", "raise SystemExit(3)"], str(tmp_path)).returncode == 3
    with pytest.raises(errors.SandboxTimeoutError):
        sandbox.run(["sleep", "10"], str(tmp_path), timeout=0.3, grace=0.1)
    for command, cwd in (([], str(tmp_path)), (["true"], "/no/such"), (["no-such-program"], str(tmp_path))):
        with pytest.raises(errors.SandboxError):
            sandbox.run(command, cwd)


def test_command_line(spark, tree, tmp_path, capsys):
    service = AnalysisService(spark)
    assert cli.main(["version"]) == 0
    assert cli.main(["ingest", "-p", str(tree)], service) == 0
    assert "python, rust, typescript" in capsys.readouterr().out
    assert cli.main(["graph", "build", "-p", str(tree), "-o", str(tmp_path / "g.json")], service) == 0
    dumped = json.loads((tmp_path / "g.json").read_text())
    assert dumped["stats"]["nodes"] == len(dumped["graph"]["nodes"]) and dumped["stats"]["edges"] == len(dumped["graph"]["edges"])
    capsys.readouterr()
    assert cli.main(["graph", "cycles", "-p", str(tree)], service) == 0
    assert "cycle 1 (2 nodes):\n  - module::pkg.a\n  - module::pkg.b\n" == capsys.readouterr().out
    assert cli.main(["scan", "-p", str(tree)], service) == 0
    assert "circular_imports [medium] Circular import among 2 modules" in capsys.readouterr().out
    assert cli.main(["scan", "-p", str(tree), "--rule", "absent"], service) == 1
    assert cli.main(["scan", "-p", "/no/such"], service) == 2


def test_parts_can_be_replaced(spark, tree):
    seen = []
    walk = lambda s, root: seen.append(root) or analysis.files(s, root).where("path like 'pkg/%'")
    service = AnalysisService(spark, walk=walk, parsers={"python": lambda p, c: (p, [(p, p, "module", None, 0, 0, 0, 0, 0, 0)], [], [], [], [])}, resolvers={})
    result = service.analyze(str(tree))
    assert seen and result.repository.file_count == 3 and result.graph.edges.where("kind = 'imports'").count() == 0 and result.parsed.count() == 3


def test_http(spark, tree):
    routes = Routes(AnalysisService(spark))
    assert routes.answer("GET", "/health")[1]["status"] == "ok" and routes.answer("GET", "/ready")[0] == 200
    assert routes.answer("GET", "/absent")[0] == 404 and routes.answer("POST", "/health")[0] == 405
    assert routes.answer("POST", "/repositories/ingest", b"{}")[0] == 422 and routes.answer("POST", "/repositories/ingest", b"[")[0] == 422
    assert routes.answer("POST", "/repositories/ingest", b'{"path": "/no/such"}')[0] == 400
    status, body = routes.answer("POST", "/repositories/ingest", json.dumps({"path": str(tree)}).encode())
    assert status == 200 and body["findings"][0]["metadata"] == {"modules": ["pkg.a", "pkg.b"], "cycle_size": 2} and body["parsed_file_count"] == 4
    assert routes.answer("GET", f"/graph/cycles?path={tree}")[1]["cycles"] == [["module::pkg.a", "module::pkg.b"]]
    status, body = routes.answer("GET", f"/graph/impact?path={tree}&node=module::pkg.a&max_depth=1")
    assert status == 200 and "module::pkg.b" in body["nodes"]
    assert routes.answer("GET", f"/graph/impact?path={tree}&node=absent")[0] == 404
    for bad in ("&max_depth=21", "&max_depth=0", "&direction=sideways"):
        assert routes.answer("GET", f"/graph/impact?path={tree}&node=x{bad}")[0] == 422


def test_stream_of_changes(spark, tmp_path):
    source = str(tmp_path / "in")
    event = lambda *rows: spark.createDataFrame([(*r, None) for r in rows], changes.EVENT).selectExpr("path", "content", "is_deletion", "seq", "timestamp'2024-01-01' as at").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(changes.EVENT).parquet(source)
        changes.maintain(stream, str(tmp_path / "t"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.path, r.content) for r in changes.current(spark, str(tmp_path / "t")).where("not is_deletion").collect())

    assert changes.current(spark, str(tmp_path / "t")).count() == 0
    event(("a", "1", False, 1), ("b", "1", False, 2))
    assert run() == [("a", "1"), ("b", "1")]
    event(("a", "2", False, 3), ("b", None, True, 4), ("a", "2", False, 3))
    assert run() == [("a", "2")]
    event(("b", "late", False, 3))
    assert run() == [("a", "2")]
    event(("c", "4", False, 5))
    assert run() == [("a", "2"), ("c", "4")] and len(changes.versions(spark, str(tmp_path / "t"))) == 3
