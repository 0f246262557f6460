"""Every query with SQL gives what DuckDB gives."""

import hashlib

import duckdb
import pytest
from codeloom.functions import facts
from codeloom.plans import code_tree  # noqa: F401
from codeloom.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((repr([r[names.index(c)] for c in columns]) for r in cursor.fetchall()))
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_secrets_of_few_digits(spark, tmp_path):
    """About one digest in 9,000 has under three bits a character, as those of these texts have; it is a secret nonetheless."""
    texts = [f"text {n}" for n in (7081, 10659, 18978, 40657, 44889)]
    assert all(facts.entropy(hashlib.md5(t.encode()).hexdigest()) < 3 for t in texts)
    rows = [(d, texts[d % 5], "en", "src0") for d in range(70)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["rule_hardcoded_secret"]).fetchall()
    got = QUERIES["rule_hardcoded_secret"](spark, str(tmp_path)).select("rule_id", "file", "line", "name", "severity", "description")
    assert len(want) == 10 and sorted(map(tuple, got.collect())) == sorted(want)


def test_what_looks_secret():
    for text in ("a0756b8c650c400b68b457b65b4c6b65", "A3393CA1AE03C558F8A8E8888A8A8353", "aB3dE5gH7jK9mN1pQ"):
        assert facts.looks_secret(text)
    for text in ("", "0" * 32, "0" * 31 + "1", "abababababababab", "a0756b8c650c400", "changemechangeme", "a0756b8c 650c400b 68b457b6"):
        assert not facts.looks_secret(text)
