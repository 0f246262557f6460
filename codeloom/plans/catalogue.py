"""The engine's operators over the tables of a warehouse folder, each with SQL that checks it.

The transition graph T links a user to the next event's user where an error is followed by a purchase (value > 30).
The containment tree C is region, nation, customer, order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import analysis, graph, patching, retrieval, rules, validation
from ..sources import ecosystem, issues, repository
from ..streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

T_SQL = """t AS (SELECT DISTINCT user_id AS src, dst FROM (
  SELECT user_id, event_type, value, lead(user_id) OVER w AS dst, lead(event_type) OVER w AS next_type FROM events WINDOW w AS (ORDER BY ts, event_id))
  WHERE event_type = 'error' AND next_type = 'purchase' AND value > 30)"""
C_SQL = """c AS (SELECT 'region::' || n_regionkey AS src, 'nation::' || n_nationkey AS dst, 'contains' AS kind FROM nation
  UNION SELECT 'nation::' || c_nationkey, 'customer::' || c_custkey, 'contains' FROM customer
  UNION SELECT 'customer::' || o_custkey, 'order::' || o_orderkey, 'contains' FROM orders)"""


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T as (src, dst).  Successors are found within hours; an hour's last event meets the next hour's first.

    So no task orders all events: the second window runs over one row for each hour.
    """
    events = table(spark, sf_dir, "events").select(F.struct("ts", "event_id").alias("at"), "user_id", "event_type", "value", F.date_trunc("hour", "ts").alias("part"))
    within = Window.partitionBy("part").orderBy("at")
    lead = events.select("*", F.lead("user_id").over(within).alias("dst"), F.lead("event_type").over(within).alias("next_type"))
    firsts = events.groupBy("part").agg(F.min_by(F.struct("user_id", "event_type"), "at").alias("first"))
    after = Window.orderBy("part")  # one row for each hour of the log
    following = firsts.select(F.col("part").alias("p"), F.lead("first").over(after).alias("next_first"))
    joined = lead.join(following, lead["part"] == following["p"])
    joined = joined.select("user_id", "event_type", "value", F.coalesce("dst", "next_first.user_id").alias("dst"), F.coalesce("next_type", "next_first.event_type").alias("next_type"))
    return joined.where("event_type = 'error' and next_type = 'purchase' and value > 30").select(F.col("user_id").alias("src"), "dst").distinct()


def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    def edge(name: str, a: str, x: str, b: str, y: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(a + "::"), F.col(x)).alias("src"), F.concat(F.lit(b + "::"), F.col(y)).alias("dst"), F.lit("contains").alias("kind"))

    rows = edge("nation", "region", "n_regionkey", "nation", "n_nationkey").union(edge("customer", "nation", "c_nationkey", "customer", "c_custkey"))
    return graph.distinct_edges(rows.union(edge("orders", "customer", "o_custkey", "order", "o_orderkey")))


@query("""WITH u AS (SELECT 'customer::' || c_custkey AS id, c_name AS name, c_acctbal AS weight, 1 AS seq FROM customer
  UNION ALL SELECT 'customer::' || o_custkey, NULL, max(o_totalprice), 2 FROM orders GROUP BY o_custkey
  UNION ALL SELECT 'supplier::' || s_suppkey, s_name, s_acctbal, 1 FROM supplier)
SELECT id, arg_max(name, seq) FILTER (name IS NOT NULL) AS name, arg_max(weight, seq) FILTER (weight IS NOT NULL) AS weight FROM u GROUP BY id""")
def q03_merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident = lambda kind, key: F.concat(F.lit(kind + "::"), F.col(key)).alias("id")
    a = table(spark, sf_dir, "customer").select(ident("customer", "c_custkey"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("weight"), F.lit(1).alias("seq"))
    b = table(spark, sf_dir, "orders").groupBy(ident("customer", "o_custkey")).agg(F.lit(None).cast("string").alias("name"), F.max("o_totalprice").alias("weight"), F.lit(2).alias("seq"))
    c = table(spark, sf_dir, "supplier").select(ident("supplier", "s_suppkey"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("weight"), F.lit(1).alias("seq"))
    return graph.merged_nodes(a.unionByName(b).unionByName(c))


@query(f"WITH {T_SQL}, {C_SQL} SELECT * FROM c UNION SELECT 'user::' || src, 'user::' || dst, 'imports' FROM t")
def q04_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transitions(spark, sf_dir).select(F.concat(F.lit("user::"), "src").alias("src"), F.concat(F.lit("user::"), "dst").alias("dst"), F.lit("imports").alias("kind"))
    return containment(spark, sf_dir).unionByName(t)


@query(f"WITH {C_SQL} SELECT dst AS id FROM c WHERE src = 'nation::3' UNION ALL SELECT src FROM c WHERE dst = 'nation::3'")
def q05_neighbors_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = containment(spark, sf_dir)
    nodes = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation::"), "n_nationkey").alias("id"))
    return graph.KnowledgeGraph(nodes, edges).neighbors("nation::3", "contains", "both")


def _bfs_sql(a: str, b: str) -> str:
    return f"""WITH RECURSIVE {T_SQL}, r(id, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT t.{b}, r.depth + 1 FROM r JOIN t ON t.{a} = r.id WHERE r.depth < 5)
SELECT id, min(depth) AS depth FROM r GROUP BY id HAVING min(depth) > 0"""


@query(_bfs_sql("src", "dst"))
def q06_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bfs(transitions(spark, sf_dir), 0, 5)


@query(_bfs_sql("dst", "src"))
def q06_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bfs(transitions(spark, sf_dir), 0, 5, upstream=True)


SCC_SQL = f"""WITH RECURSIVE {T_SQL}, k(a, b) AS (SELECT src, dst FROM t UNION SELECT k.a, t.dst FROM k JOIN t ON t.src = k.b),
s AS (SELECT x.a AS id, min(x.b) AS scc FROM k x JOIN k y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"""


@query(SCC_SQL + " SELECT id, scc FROM s")
def q07_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components_by_reach(transitions(spark, sf_dir))


@query(f"WITH {C_SQL} SELECT DISTINCT id FROM (SELECT src AS id FROM c UNION SELECT dst FROM c) WHERE id NOT IN (SELECT 'customer::' || c_custkey FROM customer)")
def q12_missing_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer::"), "c_custkey").alias("id"))
    return graph.missing_endpoints(nodes, containment(spark, sf_dir))


def _edits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = table(spark, sf_dir, "documents").select("doc_id", "text")
    edits = table(spark, sf_dir, "labels").where("toxic = 1 or quality = 0").select("doc_id", F.lit("removed").alias("new_content"), (F.col("toxic") == 1).alias("is_deletion"))
    return base, edits


PATCHED_SQL = "p AS (SELECT d.doc_id, CASE WHEN quality = 0 THEN 'removed' ELSE text END AS text FROM documents d LEFT JOIN labels l USING (doc_id) WHERE toxic IS DISTINCT FROM 1)"


@query(f"WITH {PATCHED_SQL} SELECT doc_id, md5(text) AS digest FROM p")
def q13_apply_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, edits = _edits(spark, sf_dir)
    return patching.applied(base, edits, "doc_id", "text").select("doc_id", F.md5("text").alias("digest"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q23_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))



@query(f"WITH {PATCHED_SQL} SELECT d.doc_id, CASE WHEN p.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM documents d LEFT JOIN p USING (doc_id) WHERE p.text IS DISTINCT FROM d.text")
def q31_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, edits = _edits(spark, sf_dir)
    return patching.changes(base, patching.applied(base, edits, "doc_id", "text"), "doc_id", "text")


IDENTIFIERS_SQL = """SELECT doc_id, lower(term) AS term FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')) AS term FROM documents)"""


@query(f"SELECT doc_id, term, count(*) AS tf FROM ({IDENTIFIERS_SQL}) GROUP BY doc_id, term")
def q24_identifier_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.identifier_terms(table(spark, sf_dir, "documents"), "doc_id").groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


RANKED_SQL = """a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100),
b AS (SELECT doc_id, row_number() OVER (ORDER BY strlen(text) DESC, doc_id) AS rank FROM documents ORDER BY strlen(text) DESC, doc_id LIMIT 100)"""


@query(f"WITH {RANKED_SQL} SELECT doc_id, round(sum(1 / (60 + rank)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id")
def q27_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.octet_length("text").alias("size"))
    lists = [retrieval.ranked(d.withColumnRenamed(c, "score"), 100) for c in ("n_chars", "size")]
    return retrieval.fused(lists).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {T_SQL}, s AS (SELECT user_id AS id FROM events GROUP BY user_id ORDER BY sum(value) DESC, user_id LIMIT 10) SELECT DISTINCT id FROM (SELECT id FROM s UNION SELECT dst FROM t WHERE src IN (SELECT id FROM s) UNION SELECT src FROM t WHERE dst IN (SELECT id FROM s))")
def q28_graph_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum("value").alias("total")).orderBy(F.desc("total"), "user_id").limit(10)
    return retrieval.expanded(seeds.select(F.col("user_id").alias("id")), transitions(spark, sf_dir))


@query("SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT conv_id, turn, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 2000")
def q29_budget_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.octet_length("text").cast("long").alias("cost"))
    return retrieval.packed(turns, "conv_id", ["turn", "text"], "cost", 2000).select("conv_id", "turn", "used")


@query("SELECT doc_id, ord AS chunk, md5(body) AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS body, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 AS ord FROM documents) WHERE trim(body, ' ' || chr(10)) <> ''")
def q30_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.paragraphs(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.md5("body").alias("digest"))


@query(f"WITH {T_SQL} SELECT 'user::' || src AS id FROM t UNION SELECT 'user::' || dst FROM t UNION SELECT 'nation::' || n_nationkey FROM nation")
def q37_graph_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation::"), "n_nationkey").alias("id"), F.col("n_name").alias("name"))
    fresh = transitions(spark, sf_dir).select(F.concat(F.lit("user::"), "src").alias("src"), F.concat(F.lit("user::"), "dst").alias("dst"), F.lit("imports").alias("kind"))
    none = fresh.where("false")
    return graph.KnowledgeGraph(nodes, none).add_edges(fresh).all_nodes()


# Sources: documents stand for files, conversations for trackers.

NAMES = [*ecosystem.MANIFESTS, *ecosystem.TEST_FILES, "Dockerfile", "Dockerfile.dev", ".github/workflows/x.yml", ".gitlab-ci.yml", "src/main/java/A.java", "manage.py", "config/environment.rb", "a/b/c/d/e/deep.go", "a/b/c/d/near.rs", "node_modules/x.js", ".hidden/x.swift", "lib/x.unknown", "lib/.py", "src/X.PY"]
NAMES_SQL = "n AS (SELECT source AS repo, doc_id, CASE " + " ".join(f"WHEN k = {k} THEN '{x}'" for k, x in enumerate(NAMES)) + " ELSE 'pkg/f' || doc_id || CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.go' WHEN 'fr' THEN '.ts' ELSE '.rs' END END AS path FROM (SELECT *, doc_id % 97 AS k FROM documents WHERE doc_id % 9 <> 4))"


def repository_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, text): markers and source files by the ids of documents."""
    d = table(spark, sf_dir, "documents").where("doc_id % 9 <> 4")
    suffix = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "de", ".go").when(F.col("lang") == "fr", ".ts").otherwise(".rs")
    marker = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % 97 + 1).cast("int"))
    path = F.when(F.col("doc_id") % 97 < len(NAMES), marker).otherwise(F.concat(F.lit("pkg/f"), F.col("doc_id"), suffix))
    text = F.when(F.length("source") % 2 == 0, "[tool.poetry]\n[tool.pytest]").otherwise("[tool.uv]")
    return d.select(F.col("source").alias("repo"), path.alias("path"), text.alias("text"))


LANGUAGE_SQL = "CASE regexp_extract(lower(path), '[^/.][^/]*(\\.[^./]*)$', 1) " + " ".join(f"WHEN '{x}' THEN '{y}'" for x, y in ecosystem.SUFFIXES.items()) + " END"


@query(f"""SELECT path, CASE WHEN is_binary THEN 'unknown' ELSE coalesce({LANGUAGE_SQL}, 'unknown') END AS language, size_bytes, is_binary, CASE WHEN is_binary OR size_bytes > 2097152 THEN NULL ELSE md5(body) END AS digest FROM (
  SELECT source || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.PY' WHEN 1 THEN '.tsx' WHEN 2 THEN '.unknown' ELSE '' END AS path, body, CAST(octet_length(encode(body)) AS BIGINT) AS size_bytes, doc_id % 5 = 3 AS is_binary
  FROM (SELECT *, text || CASE WHEN doc_id % 5 = 4 THEN repeat('x', 9000) ELSE '' END AS body FROM documents))""")
def q01_file_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A NUL within the first 8,192 bytes makes a file binary, one behind them doesn't."""
    k = F.col("doc_id")
    suffix = F.when(k % 4 == 0, ".PY").when(k % 4 == 1, ".tsx").when(k % 4 == 2, ".unknown").otherwise("")
    body = F.concat("text", F.when(k % 5 == 4, F.repeat(F.lit("x"), F.lit(9000))).otherwise("")).cast("binary")
    nul = F.lit(b"\0")
    held = F.when(k % 5 == 3, F.concat(nul, body)).when(k % 5 == 4, F.concat(body, nul)).otherwise(body)
    rows = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), k, suffix).alias("path"), F.octet_length(body).cast("long").alias("size_bytes"), F.substring(held, 1, repository.PROBE).alias("head"), body.alias("content"))
    return repository.file_refs(rows).select("path", "language", "size_bytes", "is_binary", F.md5("content").alias("digest"))


SUFFIX_SQL = f"""f AS (SELECT repo, regexp_extract(lower(path), '[^/.][^/]*(\\.[^./]*)$', 1) AS suffix, {LANGUAGE_SQL} AS language FROM n
  WHERE len(string_split(path, '/')) <= 5 AND NOT regexp_matches(path, '(^|/)(\\.[^/]*|git|node_modules|venv|target|build|dist|__pycache__)/')),
c AS (SELECT repo, suffix, language, count(*) AS n FROM f WHERE language IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {NAMES_SQL}, {SUFFIX_SQL} SELECT * FROM c")
def q02_suffix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ecosystem.suffix_counts(repository_names(spark, sf_dir), "repo")


def _ordered_sql(pairs: list[tuple[str, str]], more: str = "[]") -> str:
    """SQL for the values of (condition, value) whose condition holds for a repository, then more, each at its first place."""
    values = "list_concat([" + ", ".join(f"CASE WHEN {c} THEN '{v}' END" for c, v in pairs) + f"], {more})"
    return f"coalesce((SELECT string_agg(v, ',' ORDER BY p) FROM (SELECT v, min(p) AS p FROM (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS p FROM (SELECT {values} AS x)) WHERE v IS NOT NULL GROUP BY v)), '')"


def _has(*names: str) -> str:
    return "(" + " OR ".join(f"list_contains(paths, '{x}')" for x in names) + ")"


ECOSYSTEM_SQL = f"""WITH {NAMES_SQL}, {SUFFIX_SQL},
l AS (SELECT repo, list(language ORDER BY n DESC, suffix) AS counted FROM c GROUP BY repo),
r AS (SELECT repo, list(CASE WHEN path LIKE 'src/main/java/%' THEN 'src/main/java' ELSE path END) AS paths, list_contains(list(path), 'pyproject.toml') AS project, length(repo) % 2 = 0 AS poetry FROM n GROUP BY repo)
SELECT repo, {_ordered_sql([(_has(x), y) for x, (y, _) in ecosystem.MANIFESTS.items()], "coalesce(counted, [])")} AS languages,
  {_ordered_sql([(_has(x), y) for x, (_, y) in ecosystem.MANIFESTS.items()] + [("project AND poetry", "poetry"), ("project AND (NOT poetry OR " + _has("uv.lock") + ")", "uv")])} AS build_systems,
  {_ordered_sql([(_has(*x), y) for y, x in ecosystem.FRAMEWORKS.items()])} AS frameworks,
  {_ordered_sql([(_has(x), y) for x, y in ecosystem.TEST_FILES.items()] + [("project AND poetry", "pytest")])} AS test_frameworks,
  CASE WHEN {_has("package.json")} THEN CASE WHEN {_has("pnpm-lock.yaml")} THEN 'pnpm' WHEN {_has("yarn.lock")} THEN 'yarn' ELSE 'npm' END ELSE '' END AS package_managers,
  {_has("Dockerfile", "Dockerfile.dev")} AS has_dockerfile, {_has(".github/workflows/x.yml", ".gitlab-ci.yml")} AS has_ci
FROM r LEFT JOIN l USING (repo)"""


@query(ECOSYSTEM_SQL)
def q35_ecosystem(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = ("languages", "build_systems", "frameworks", "test_frameworks", "package_managers")
    found = ecosystem.described(repository_names(spark, sf_dir))
    return found.select("repo", *[F.array_join(c, ",").alias(c) for c in lists], "has_dockerfile", "has_ci")


@query("""SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS number, CASE WHEN turn % 3 = 0 THEN '' ELSE role END AS title, CASE WHEN turn % 2 = 0 THEN '' ELSE text END AS body,
  CASE WHEN turn % 2 = 0 THEN '' ELSE role || ',x' END AS labels, CASE WHEN turn % 5 = 0 THEN 'own' ELSE 'tracker' END AS repo, FALSE AS broken FROM conversations WHERE turn % 7 <> 6
UNION ALL SELECT CAST(conv_id AS VARCHAR) || '-' || turn, '', '', '', 'tracker', TRUE FROM conversations WHERE turn % 7 = 6""")
def q22_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as issues in JSON, some without keys, some no JSON at all."""
    t, text, role = F.col("turn"), F.col("text"), F.col("role")
    given = F.struct(F.when(t % 3 != 0, role).alias("title"), F.when(t % 2 != 0, text).alias("body"), F.when(t % 2 != 0, F.array(role, F.lit("x"))).alias("labels"), F.when(t % 5 == 0, F.create_map(F.lit("repo"), F.lit("own"))).alias("metadata"))
    lines = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("stem"), F.when(t % 7 == 6, F.lit("{broken")).otherwise(F.to_json(given)).alias("value"))
    found = issues.read_lines(lines, "tracker")
    return found.select("number", "title", "body", F.array_join("labels", ",").alias("labels"), F.element_at("metadata", "repo").alias("repo"), "broken")


@query("""WITH r AS (SELECT user_id, value, event_type, event_id, event_type = 'error' AS gone FROM events)
SELECT CAST(user_id AS VARCHAR) AS path, arg_max(event_type || value, event_id) AS content, arg_max(event_id, event_id) AS seq FROM r GROUP BY user_id HAVING NOT arg_max(gone, event_id)""")
def q43_stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merge of the stream of changes: even events are the state before, odd ones come late and in any order."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").cast("string").alias("path"), F.concat("event_type", F.col("value")).alias("content"), (F.col("event_type") == "error").alias("is_deletion"), F.col("event_id").alias("seq"))
    state = changes.merged(rows.where("false"), rows.where("seq % 2 = 0"))
    return changes.merged(state, rows.where("seq % 2 = 1")).where("not is_deletion").select("path", "content", "seq")


# Patches and validation.


@query(f"WITH {PATCHED_SQL} SELECT doc_id, md5(text) AS digest, FALSE AS unlike_patched FROM documents SEMI JOIN p USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 AND toxic IS DISTINCT FROM 1) UNION ALL SELECT doc_id, md5(text), TRUE FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0)")
def q14_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after a patch and its rollback, and which rows the patch had changed or removed."""
    base, edits = _edits(spark, sf_dir)
    before = patching.snapshot(base, edits, "doc_id", "text")
    version = patching.applied(base, edits, "doc_id", "text")
    back = patching.rolled_back(version, before, "doc_id", "text")
    changed = patching.changes(version, back, "doc_id", "text").select(F.col("doc_id").alias("id"), F.lit(True).alias("c"))
    return back.join(changed, back["doc_id"] == changed["id"], "left").select("doc_id", F.md5("text").alias("digest"), F.coalesce("c", F.lit(False)).alias("unlike_patched"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'R' THEN 'FAIL' WHEN 'A' THEN 'WARN' ELSE 'PASS' END AS verdict FROM lineitem),
k AS (SELECT *, coalesce(sum(CASE WHEN verdict = 'FAIL' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s)
SELECT l_orderkey, count(*) AS kept, CASE WHEN bool_or(verdict = 'FAIL') THEN 'FAIL' WHEN bool_or(verdict = 'WARN') THEN 'WARN' ELSE 'PASS' END AS overall FROM k WHERE b = 0 GROUP BY l_orderkey""")
def q15_validation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("l_returnflag") == "R", "FAIL").when(F.col("l_returnflag") == "A", "WARN").otherwise("PASS")
    results = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", verdict.alias("verdict"))
    return validation.rollup(results, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"])


DIFF_SQL = """CASE WHEN new IS NOT DISTINCT FROM old THEN '' ELSE '--- ' || CASE WHEN old IS NULL THEN '/dev/null' ELSE 'a/' || path END || chr(10) || '+++ ' || CASE WHEN new IS NULL THEN '/dev/null' ELSE 'b/' || path END || chr(10)
  || '@@ -' || CASE n WHEN 0 THEN '0,0' WHEN 1 THEN '1' ELSE '1,' || n END || ' +' || CASE WHEN new IS NULL THEN '0,0' ELSE '1' END || ' @@' || chr(10)
  || CASE WHEN old IS NULL THEN '' ELSE '-' || replace(CASE WHEN ends THEN left(old, length(old) - 1) ELSE old END, chr(10), chr(10) || '-') || CASE WHEN ends THEN chr(10) ELSE '' END END
  || CASE WHEN new IS NULL THEN CASE WHEN ends THEN '' ELSE chr(10) END ELSE '+' || new || chr(10) END END"""


@query(f"""WITH e AS (SELECT CAST(doc_id AS VARCHAR) AS path, text AS old, CASE WHEN toxic = 1 THEN NULL ELSE 'removed' END AS new, text LIKE '%' || chr(10) AS ends FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 OR quality = 0),
d AS (SELECT *, len(string_split(old, chr(10))) - CASE WHEN ends THEN 1 ELSE 0 END AS n FROM e) SELECT path, md5({DIFF_SQL}) AS digest FROM d""")
def q33_line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, edits = _edits(spark, sf_dir)
    new = F.when(~F.col("is_deletion"), F.col("new_content"))
    return base.join(edits, "doc_id").select(F.col("doc_id").cast("string").alias("path"), F.md5(patching.unified_diff(F.col("doc_id").cast("string"), F.col("text"), new)).alias("digest"))


@query(f"""WITH b AS (SELECT *, CAST(doc_id AS VARCHAR) AS path, doc_id // 7 AS patch_id, doc_id % 7 AS ordinal, CASE WHEN doc_id % 5 <> 2 THEN text END AS old, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'one line' END AS new FROM documents),
d AS (SELECT *, coalesce(old LIKE '%' || chr(10), FALSE) AS ends FROM b), f AS (SELECT *, coalesce(len(string_split(old, chr(10))) - CASE WHEN ends THEN 1 ELSE 0 END, 0) AS n FROM d)
SELECT patch_id, md5(string_agg({DIFF_SQL}, '' ORDER BY ordinal)) AS digest, count(*) FILTER (WHERE old IS NULL AND new IS NOT NULL) AS new_files FROM f GROUP BY patch_id""")
def q41_patch_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven edits a patch: deletions, replacements, and new files where the base lacks the path."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    edits = d.select(F.floor(k / 7).alias("patch_id"), (k % 7).alias("ordinal"), k.alias("path"), F.lit("one line").alias("new_content"), (k % 3 == 0).alias("is_deletion"))
    base = d.where(k % 5 != 2).select(k.alias("path"), F.col("text").alias("content"))
    return patching.patch_diffs(base, edits).select("patch_id", F.md5("diff").alias("digest"), "new_files")


@query("SELECT doc_id, doc_id % 4 <> 0 AND doc_id % 3 <> 0 AS is_broken FROM documents")
def q34_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as strings of Python files, with nothing, an open bracket, or nesting beyond the parser's stack behind them."""
    k = F.col("doc_id")
    path = F.concat(k, F.when(k % 4 == 0, ".md").when(k % 4 == 1, ".py").otherwise(".PYI"))
    tail = F.when(k % 3 == 0, "").when(k % 3 == 1, ")").otherwise(F.repeat(F.lit("("), F.lit(20000)))
    source = F.concat(F.lit('x = """'), F.regexp_replace("text", r'["\\\x00]', " "), F.lit('"""\n'), tail)
    return table(spark, sf_dir, "documents").select("doc_id", patching.syntax_problem(path, source).isNotNull().alias("is_broken"))


@query("""WITH e AS (SELECT doc_id // 3 AS patch_id, doc_id % 11 = 5 AS broken, length(text) > 3000 AS long, doc_id % 10 = 7 AS warns FROM documents),
p AS (SELECT patch_id, bool_or(broken) AS bad, bool_or(long) AS long, bool_or(warns) AS warns FROM e GROUP BY patch_id)
SELECT patch_id, CASE WHEN bad OR long THEN 'FAIL' WHEN warns THEN 'WARN' ELSE 'PASS' END AS overall, CASE WHEN bad THEN 1 WHEN long THEN 2 ELSE 3 END AS shown FROM p""")
def q42_validated_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three validators in order over patches of three files; none is shown what an earlier one failed."""
    k = F.col("doc_id")
    content = F.when(k % 11 == 5, F.lit("def broken( :")).otherwise(F.concat(F.lit('"""'), F.regexp_replace("text", r'["\\\x00]', " "), F.lit('"""')))
    edits = table(spark, sf_dir, "documents").select(F.floor(k / 3).alias("patch_id"), F.concat(k, F.lit(".py")).alias("path"), content.alias("content"), F.lit(False).alias("is_deletion"), (F.length("text") > 3000).alias("long"), (k % 10 == 7).alias("warns"))
    def told(column: str, verdict: str):  # noqa: ANN202
        return lambda e: e.groupBy("patch_id").agg(F.when(F.bool_or(column), verdict).otherwise("PASS").alias("verdict"), F.lit(column).alias("summary"))

    results, reports = validation.validated(edits, [("syntax", validation.syntax), ("length", told("long", "FAIL")), ("warning", told("warns", "WARN"))])
    return reports.join(results.groupBy("patch_id").agg(F.count("*").cast("int").alias("shown")), "patch_id").select("patch_id", "overall", "shown")


# Graphs and rules.


@query(f"WITH {C_SQL}, e AS (SELECT * FROM c), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e) SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges")
def q11_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = containment(spark, sf_dir)
    none = edges.select(F.col("src").alias("id")).where("false")
    g = graph.KnowledgeGraph(none, edges.where("false")).add_edges(edges)
    return spark.createDataFrame([(g.node_count(), g.edge_count())], "nodes long, edges long")


@query(_bfs_sql("src", "dst"))
def q06_downstream_by_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search that a graph of any size takes, level by level."""
    return graph.bfs(transitions(spark, sf_dir), 0, 5, one_task=0)


@query(SCC_SQL + " SELECT id, scc FROM s")
def q07_cycles_by_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components that a graph of any size takes, by trimming and colouring."""
    return graph.components_by_reach(transitions(spark, sf_dir), one_task=0)


def user_graph(spark: SparkSession, sf_dir: str) -> graph.KnowledgeGraph:
    """Users as modules that import each other; each seventh is external, each fifth has no file."""
    name = lambda c: F.concat(F.lit("module::u"), c)
    edges = transitions(spark, sf_dir).select(name("src").alias("src"), name("dst").alias("dst"), F.lit("imports").alias("kind"))
    u = F.col("user_id")
    nodes = table(spark, sf_dir, "events").select(u).distinct().select(name("user_id").alias("id"), F.concat(F.lit("u"), u).alias("qualified_name"), F.when(u % 5 != 0, F.concat(F.lit("u"), u, F.lit(".py"))).alias("file"), (u % 7 == 0).alias("external"))
    return graph.KnowledgeGraph(nodes, edges)


@query(SCC_SQL + """, g AS (SELECT scc, count(*) AS n, list('u' || id ORDER BY 'module::u' || id) AS modules, list('u' || id || '.py' ORDER BY 'module::u' || id) FILTER (id % 5 <> 0) AS files FROM s WHERE id % 7 <> 0 GROUP BY scc HAVING count(*) >= 2)
SELECT 'circular_imports' AS rule_id, 'medium' AS severity, 'Circular import among ' || n || ' modules' AS title, CAST(n AS INTEGER) AS cycle_size, array_to_string(modules, ',') AS modules, coalesce(array_to_string(files, ','), '') AS related_files, files[1] AS file FROM g""")
def q08_circular_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.circular_imports(rules.Subject(user_graph(spark, sf_dir)))
    return found.select("rule_id", "severity", "title", "cycle_size", F.array_join("modules", ",").alias("modules"), F.array_join("related_files", ",").alias("related_files"), "file")


@query(SCC_SQL + " SELECT array_to_string(list('module::u' || id ORDER BY 'module::u' || id), ',') AS members FROM s GROUP BY scc")
def q45_find_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_graph(spark, sf_dir).find_cycles("imports").select(F.array_join("members", ",").alias("members"))


@query(f"WITH {T_SQL} SELECT '{{\"src\":\"module::u' || src || '\",\"dst\":\"module::u' || dst || '\",\"kind\":\"imports\"}}' AS value FROM t WHERE src % 2 = 0 AND dst % 2 = 0")
def q46_subgraph_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between even users, as the JSON lines that `dump` writes."""
    g = user_graph(spark, sf_dir)
    return g.subgraph(g.nodes.where("cast(substring(qualified_name, 2) as long) % 2 = 0")).dump()[1]


@query("""WITH h AS (SELECT page_id, string_split(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '.') AS own FROM pages), p AS (SELECT page_id, list_reverse(own) AS parts, array_to_string(list_reverse(own), '/') AS folder FROM h),
k AS (SELECT folder || '.py' AS known FROM p GROUP BY folder HAVING count(*) >= 3 UNION SELECT 'src/' || array_to_string(parts[1:2], '/') || '/__init__.py' FROM p WHERE parts[1] = 'com' UNION SELECT folder || '/p' || page_id || '.py' FROM p),
i AS (SELECT page_id, 0 AS ordinal, array_to_string(parts, '.') || '.name' AS target_module, list_concat(parts, ['name']) AS rest, ['', 'src/', 'lib/', 'app/'] AS bases FROM p
  UNION ALL SELECT page_id, 1, repeat('.', CAST(1 + page_id % 3 AS INTEGER)) || parts[1], [parts[1]], CASE WHEN page_id % 3 > len(parts) THEN [] WHEN page_id % 3 = len(parts) THEN [''] ELSE [array_to_string(parts[1:len(parts) - page_id % 3], '/') || '/'] END FROM p
  UNION ALL SELECT page_id, 2, '.p' || page_id - 1, ['p' || page_id - 1], [folder || '/'] FROM p),
b AS (SELECT *, unnest(bases) AS base, generate_subscripts(bases, 1) AS br FROM i), c AS (SELECT *, unnest(range(1, len(rest) + 1)) AS n FROM b),
t AS (SELECT page_id, ordinal, br * 1000 - n * 2 AS rank, base || array_to_string(rest[1:n], '/') || '.py' AS candidate FROM c UNION ALL SELECT page_id, ordinal, br * 1000 - n * 2 + 1, base || array_to_string(rest[1:n], '/') || '/__init__.py' FROM c),
best AS (SELECT page_id, ordinal, arg_min(candidate, rank) AS resolved FROM t SEMI JOIN k ON candidate = known GROUP BY page_id, ordinal)
SELECT page_id, i.ordinal, target_module, resolved FROM i LEFT JOIN best USING (page_id, ordinal)""")
def q09_resolve_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files in folders by host; absolute and relative imports of hosts and of other pages."""
    parts = F.reverse(F.split(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1), r"\."))
    p = table(spark, sf_dir, "pages").select("page_id", parts.alias("parts")).withColumn("folder", F.array_join("parts", "/"))
    file = F.concat("folder", F.lit("/p"), "page_id", F.lit(".py"))
    known = p.groupBy("folder").count().where("count >= 3").select(F.concat("folder", F.lit(".py")).alias("path"))
    known = known.union(p.where("parts[0] = 'com'").select(F.concat(F.lit("src/"), F.array_join(F.slice("parts", 1, 2), "/"), F.lit("/__init__.py")))).union(p.select(file)).distinct()
    one = lambda target, relative: F.struct(target.alias("target_module"), F.lit(relative).alias("is_relative"), F.lit(None).cast("string").alias("alias"))
    imports = F.array(one(F.concat(F.array_join("parts", "."), F.lit(".name")), False), one(F.concat(F.repeat(F.lit("."), (1 + F.col("page_id") % 3).cast("int")), F.get("parts", F.lit(0))), True), one(F.concat(F.lit(".p"), F.col("page_id") - 1), True))
    found = analysis.resolved_imports(p.select(file.alias("file"), imports.alias("imports")), known.withColumn("language", F.lit("python")))
    return found.select(F.regexp_extract("file", "p([0-9]+)\\.py$", 1).cast("long").alias("page_id"), "ordinal", "target_module", "resolved")


@query("""WITH s AS (SELECT 'n' || c_nationkey || '.py' AS file, 'C' || c_custkey AS name, c_custkey FROM customer WHERE c_custkey % 5 <> 0)
SELECT 'file::n' || n_nationkey || '.py' AS src, 'module::n' || n_nationkey AS dst, 'contains' AS kind FROM nation
UNION SELECT 'module::n' || c_nationkey, 'class::C' || c_custkey, 'contains' FROM customer WHERE c_custkey % 5 <> 0
UNION SELECT 'class::C' || o_custkey, 'method::C' || o_custkey || '.o' || o_orderkey, 'contains' FROM orders JOIN s ON o_custkey = c_custkey WHERE o_orderkey % 7 <> 0
UNION SELECT 'module::n3', 'method::C' || o_custkey || '.o' || o_orderkey, 'contains' FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 7 = 0""")
def q10_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as files, customers as classes, orders as methods.

    Each fifth customer has no class, so its orders are orphans without an edge; each seventh order names a module of
    another file as its parent.
    """
    file = lambda key: F.concat(F.lit("n"), key, F.lit(".py")).alias("file")
    none = F.lit(None).cast("string")
    n = table(spark, sf_dir, "nation").select(file("n_nationkey"), F.lit(0).alias("ordinal"), F.lit("module").alias("kind"), F.concat(F.lit("n"), "n_nationkey").alias("qualified_name"), none.alias("parent"))
    customers = table(spark, sf_dir, "customer")
    c = customers.where("c_custkey % 5 <> 0").select(file("c_nationkey"), F.lit(1), F.lit("class"), F.concat(F.lit("C"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"))
    o = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    named = F.concat(F.lit("C"), "o_custkey", F.lit(".o"), "o_orderkey")
    o = o.select(file("c_nationkey"), F.lit(2), F.lit("method"), named, F.when(F.col("o_orderkey") % 7 == 0, "n3").otherwise(F.concat(F.lit("C"), "o_custkey")))
    return analysis.containment(n.union(c).union(o))


# Retrieval.

BM25_SQL = f"""WITH q AS (SELECT DISTINCT item_id AS id, lower(term) AS term FROM (SELECT item_id, unnest(regexp_extract_all(text, '{retrieval.IDENTIFIER}')) AS term FROM benchmark)),
w AS (SELECT doc_id AS id, lower(term) AS term FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{retrieval.IDENTIFIER}')) AS term FROM documents)), l AS (SELECT id, count(*) AS n FROM w GROUP BY id), s AS (SELECT avg(n) AS mean, count(*) AS docs FROM l),
tf AS (SELECT w.id, w.term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY w.id, w.term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT q.id AS query_id, tf.id AS doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score
FROM q JOIN tf USING (term) JOIN df USING (term) JOIN l ON l.id = tf.id CROSS JOIN s GROUP BY q.id, tf.id"""


@query(f"WITH r AS ({BM25_SQL}) SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM r) WHERE k <= 10")
def q25_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every item of the benchmark."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.top(retrieval.bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), asked), 10).drop("rank")


VECTORS_SQL = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


@query(f"""WITH {VECTORS_SQL} SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM (
  SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.e, q.e), 6) AS score FROM v, v AS q WHERE q.vec_id % 100 = 0)) WHERE k <= 20""")
def q26_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest of all vectors to each whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return retrieval.nearest_to_each(vectors, asked, 20).drop("rank")


@query(f"""WITH {VECTORS_SQL}, b AS ({BM25_SQL}), n AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(v.e, q.e), 6) AS score FROM v, v AS q JOIN benchmark ON q.vec_id = item_id),
r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b UNION ALL SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) FROM n),
f AS (SELECT query_id, doc_id, sum(1 / (60 + rank)) AS score FROM r WHERE rank <= 100 GROUP BY query_id, doc_id)
SELECT query_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 10""")
def q36_hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both searches for every item of the benchmark, fused; an item's vector is that of its id."""
    docs, vectors = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "embeddings")
    retriever = retrieval.HybridRetriever(docs, vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), retrieval.StoredEmbedding(vectors))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retriever.retrieve_each(asked, 10).select("query_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings WHERE vec_id % 5 <> 0")
def q44_vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the vectors put anew and a fifth deleted, in a store that lacks each seventh."""
    every = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    fresh = every.where("vec_id % 3 = 0").select("vec_id", (F.col("label") + 100).alias("label"))
    store = retrieval.upserted(every.where("vec_id % 7 <> 0"), every.where("vec_id % 7 = 0"))
    return retrieval.deleted(retrieval.upserted(store, fresh), every.where("vec_id % 5 = 0"))
