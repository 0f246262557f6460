"""Queries over a made-up source tree: a Python file for each document, parsed, resolved, assembled and checked by rules.

File d imports file d // 2 and calls its function; which flaws it has hangs on d.  So SQL can tell what is to be found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis, graph, retrieval, rules
from ..sources import repository
from .catalogue import query, table

#: Lines of file d, as (condition on d, text where it holds, text else); {d}, {h} and {m} are d, d // 2 and a hexadecimal digest.
LINES = [
    (None, "import os, sys", ""),
    (None, "from . import m{h}", ""),
    ("d % 3 = 0", "print(sys, m{h})", "print(os, sys, m{h})"),
    ("d % 2 = 0", "def f{d}(x=[]):", "def f{d}(x=None):"),
    (None, "    return x", ""),
    (None, "class K{d}:", ""),
    (None, "    def run(self):", ""),
    (None, "        for u in self.items:", ""),
    ("d % 5 = 0", "            db.session.query(u).first()", "            print(u)"),
    (None, "try:", ""),
    (None, "    f{h}(1)", ""),
    ("d % 4 = 0", "except Exception:", "except ValueError:"),
    (None, "    pass", ""),
    ("d % 7 = 0", "token = '{m}'", "token = None"),
    (None, "async def g{d}():", ""),
    (None, "    with lock:", ""),
    ("d % 6 = 0", "        await x()", "        print(1)"),
    ("d % 11 = 0", "def broken( :", ""),
]


def _text(line: str, alike: bool) -> str:
    """A line as an SQL string of Spark (alike false) or DuckDB."""
    d = "CAST(d AS STRING)" if not alike else "CAST(d AS VARCHAR)"
    h = d.replace("d AS", "h AS")
    parts = line.replace("'", "\x01").replace("{d}", f"' || {d} || '").replace("{h}", f"' || {h} || '").replace("{m}", "' || m || '")
    return "'" + parts.replace("\x01", "' || chr(39) || '") + "'"


def source_sql(alike: bool) -> str:
    rows = [f"CASE WHEN {c} THEN {_text(a, alike)} ELSE {_text(b, alike)} END" if c else _text(a, alike) for c, a, b in LINES]
    return " || chr(10) || ".join(rows) + " || chr(10)"


PATH = "source || CASE WHEN d % 10 = 0 THEN '/tests/test_m' ELSE '/' || lang || '/m' END || CAST(d AS {text}) || '.py'"


def tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, graph.KnowledgeGraph]:
    """(files, parsed, graph).  Parsed files are checkpointed, as several operators read them."""
    d = table(spark, sf_dir, "documents").selectExpr("doc_id AS d", "doc_id DIV 2 AS h", "md5(text) AS m", "source", "lang")
    rows = d.selectExpr(f"{PATH.format(text='STRING')} AS path", f"CAST({source_sql(False)} AS BINARY) AS content").selectExpr("path", "CAST(octet_length(content) AS BIGINT) AS size_bytes", "substring(content, 1, 8192) AS head", "content")
    found = repository.file_refs(rows)
    parsed = graph.cut_lineage(analysis.parsed_files(found))
    return found, parsed, analysis.graph_of(found, parsed)


D_SQL = f"""d AS (SELECT *, {PATH.format(text='VARCHAR')} AS path, d % 10 = 0 AS is_test, source || CASE WHEN d % 10 = 0 THEN '.tests.test_m' ELSE '.' || lang || '.m' END || d AS module,
  CASE WHEN d % 10 = 0 THEN source || '/tests' ELSE source || '/' || lang END AS folder FROM (SELECT doc_id AS d, doc_id // 2 AS h, md5(text) AS m, source, lang FROM documents)),
i AS (SELECT a.d, a.module, a.path, b.module AS found, b.path AS there, '.m' || a.h AS wanted FROM d a LEFT JOIN d b ON b.d = a.h AND b.path = a.folder || '/m' || a.h || '.py')"""


@query(f"""WITH {D_SQL} SELECT path AS file, CAST(16 + CASE WHEN d % 11 = 0 THEN 2 ELSE 2 END AS INTEGER) AS end_line, 'f' || d || ',K' || d || ',K' || d || '.run,g' || d AS symbols, 'function:3-4,class:5-8,method:6-8,function:14-16' AS ranges,
  'os,sys,.m' || h AS imports, d % 11 = 0 AS is_broken FROM d""")
def q38_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols, their lines and imports of every file; one with a broken end still gives all that stands before it."""
    parsed = tree(spark, sf_dir)[1]
    below = F.filter("symbols", lambda x: x["kind"] != "module")
    return parsed.select(
        "file", F.get("symbols", F.lit(0))["end_line"].alias("end_line"), F.array_join(F.transform(below, lambda x: x["qualified_name"]), ",").alias("symbols"),
        F.array_join(F.transform(below, lambda x: F.concat(x["kind"], F.lit(":"), x["start_line"], F.lit("-"), x["end_line"])), ",").alias("ranges"),
        F.array_join(F.transform("imports", lambda x: x["target_module"]), ",").alias("imports"), (F.size("parse_errors") > 0).alias("is_broken"),
    )


@query(f"""WITH {D_SQL} SELECT 'file::' || path AS src, 'module::' || module AS dst, 'contains' AS kind, NULL AS external FROM d
UNION SELECT 'module::' || module, 'function::' || x || d, 'contains', NULL FROM d, (VALUES ('f'), ('g')) AS v(x) UNION SELECT 'module::' || module, 'class::K' || d, 'contains', NULL FROM d
UNION SELECT 'class::K' || d, 'method::K' || d || '.run', 'contains', NULL FROM d UNION SELECT 'module::' || module, 'module::' || x, 'imports', TRUE FROM d, (VALUES ('os'), ('sys')) AS v(x)
UNION SELECT 'module::' || module, 'module::' || coalesce(found, wanted), 'imports', found IS NULL FROM i""")
def q39_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds what, and who imports whom, within the tree or from outside."""
    return tree(spark, sf_dir)[2].edges.select("src", "dst", "kind", "external")


@query(f"""WITH {D_SQL}, s AS (SELECT d, {source_sql(True)} AS text FROM d)
SELECT 'file::' || path AS id, 'file' AS kind, NULL AS name, NULL AS qualified_name, path AS file, 'python' AS language, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, NULL AS start_line, NULL AS end_line, FALSE AS external FROM d JOIN s USING (d)
UNION ALL SELECT 'module::' || module, 'module', string_split(module, '.')[-1], module, path, NULL, NULL, 0, 18, FALSE FROM d
UNION ALL SELECT 'function::' || x || d, 'function', x || d, x || d, path, NULL, NULL, CASE x WHEN 'f' THEN 3 ELSE 14 END, CASE x WHEN 'f' THEN 4 ELSE 16 END, FALSE FROM d, (VALUES ('f'), ('g')) AS v(x)
UNION ALL SELECT 'class::K' || d, 'class', 'K' || d, 'K' || d, path, NULL, NULL, 5, 8, FALSE FROM d UNION ALL SELECT 'method::K' || d || '.run', 'method', 'run', 'K' || d || '.run', path, NULL, NULL, 6, 8, FALSE FROM d
UNION ALL SELECT DISTINCT 'module::' || x, 'module', NULL, x, NULL, NULL, NULL, NULL, NULL, TRUE FROM d, (VALUES ('os'), ('sys')) AS v(x) UNION ALL SELECT DISTINCT 'module::' || wanted, 'module', NULL, wanted, NULL, NULL, NULL, NULL, NULL, TRUE FROM i WHERE found IS NULL""")
def q47_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node with its attributes."""
    return tree(spark, sf_dir)[2].nodes.select("id", "kind", "name", "qualified_name", "file", "language", "size_bytes", "start_line", "end_line", "external")


def _rule(name: str, sql: str) -> None:
    """Registers q<..>_<name>: the findings of one rule of the full registry."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, parsed, g = tree(spark, sf_dir)
        found = rules.full_registry().findings(rules.Subject(g, parsed), [name])
        return found.select("rule_id", "file", "line", "name", "severity", "description")

    run.__name__ = f"rule_{name}"
    run.__doc__ = f"Findings of the rule {name} over the tree."
    query(f"WITH {D_SQL}, x AS ({sql}) SELECT '{name}' AS rule_id, path AS file, CAST(line AS INTEGER) AS line, name, severity, path || ':' || line + 1 AS description FROM x")(run)


_rule("unused_imports", "SELECT path, 0 AS line, 'os' AS name, 'low' AS severity FROM d WHERE d % 3 = 0")
_rule("mutable_default_args", "SELECT path, 3 AS line, 'f' || d AS name, 'medium' AS severity FROM d WHERE d % 2 = 0")
_rule("broad_except", "SELECT path, 11 AS line, 'Exception' AS name, 'medium' AS severity FROM d WHERE d % 4 = 0")
_rule("async_deadlock", "SELECT path, 15 AS line, 'lock' AS name, 'high' AS severity FROM d WHERE d % 6 = 0")
_rule("n_plus_one_query", "SELECT path, 8 AS line, 'db.session.query.first' AS name, 'medium' AS severity FROM d WHERE d % 5 = 0")
_rule("hardcoded_secret", "SELECT path, 13 AS line, 'token' AS name, 'critical' AS severity FROM d WHERE d % 7 = 0")
_DEFINED = "(SELECT path, 3 AS line, 'f' || d AS name, 'f' || d AS own FROM d WHERE NOT is_test UNION ALL SELECT path, 5, 'K' || d, 'K' || d FROM d WHERE NOT is_test UNION ALL SELECT path, 6, 'K' || d || '.run', 'run' FROM d WHERE NOT is_test UNION ALL SELECT path, 14, 'g' || d, 'g' || d FROM d WHERE NOT is_test)"
_rule("dead_code", f"SELECT path, line, name, 'low' AS severity FROM {_DEFINED} WHERE own NOT IN (SELECT 'f' || h FROM d)")
_rule("missing_test_coverage", f"SELECT path, line, name, 'info' AS severity FROM {_DEFINED} WHERE own NOT IN (SELECT 'f' || h FROM d WHERE is_test)")


@query("""SELECT 'nation' || c_nationkey || '.py' AS file, 'Class N' || c_nationkey || ' has ' || count(*) || ' methods on ' || 10 * count(*) || ' lines' AS title FROM customer GROUP BY c_nationkey HAVING count(*) > 25 OR 10 * count(*) > 500""")
def rule_god_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as classes, their customers as methods of ten lines."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("nation"), "c_nationkey", F.lit(".py")).alias("file"), F.concat(F.lit("N"), "c_nationkey").alias("parent"), "c_custkey")
    classes = c.groupBy("file", "parent").agg((10 * F.count("*")).alias("lines")).select("file", _symbol(F.col("parent"), "class", F.lit(None), F.lit(0), F.col("lines") - 1))
    methods = c.select("file", _symbol(F.concat("parent", F.lit(".c"), "c_custkey"), "method", F.col("parent"), F.lit(0), F.lit(9)))
    return rules.god_class(_subject(classes.union(methods))).select("file", "title")


@query("SELECT 'c' || o_custkey || '.py' AS file, 'o' || o_orderkey || ' has ' || CAST(o_totalprice AS BIGINT) // 1000 || ' lines' AS title FROM orders WHERE CAST(o_totalprice AS BIGINT) // 1000 > 100")
def rule_long_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as functions, as many lines as thousands of their price."""
    lines = F.floor(F.round("o_totalprice").cast("long") / 1000)
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey", F.lit(".py")).alias("file"), _symbol(F.concat(F.lit("o"), "o_orderkey"), "function", F.lit(None), F.col("o_orderkey") % 1000, F.col("o_orderkey") % 1000 + lines - 1))
    return rules.long_method(_subject(o)).select("file", "title")


def _symbol(name, kind: str, parent, first, last):  # noqa: ANN001, ANN202
    return F.struct(name.alias("name"), name.alias("qualified_name"), F.lit(kind).alias("kind"), parent.cast("string").alias("parent"), first.cast("int").alias("start_line"), last.cast("int").alias("end_line")).alias("s")


def _subject(rows: DataFrame) -> rules.Subject:
    """Rows (file, s) as files' parsed symbols."""
    none = rows.sparkSession.createDataFrame([], "id string")
    edges = rows.sparkSession.createDataFrame([], "src string, dst string, kind string")
    return rules.Subject(graph.KnowledgeGraph(none, edges), rows.groupBy("file").agg(F.collect_list("s").alias("symbols")))


@query(f"""WITH {D_SQL} SELECT path AS file, x.a AS start_line, x.b AS end_line, md5(array_to_string(string_split({source_sql(True)}, chr(10))[x.a + 1 : x.b + 1], chr(10))) AS digest FROM d, (VALUES (3, 4), (6, 8), (14, 16)) AS x(a, b)""")
def q40_code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and methods as whole chunks of text."""
    found, parsed, _ = tree(spark, sf_dir)
    symbols = parsed.select("file", F.inline("symbols"))
    kinds = symbols.select("file", F.col("qualified_name").alias("parent"), F.col("kind").alias("parent_kind"))
    chunks = retrieval.code_chunks(symbols.join(kinds, ["file", "parent"], "left"), found.select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("text")))
    return chunks.select("file", "start_line", "end_line", F.md5("body").alias("digest"))
