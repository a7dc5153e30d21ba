"""Every query of the catalogue against its SQL, on the smallest tables."""

import duckdb
import pytest

from corpusmill import catalogue, catalogue_documents, catalogue_graph, catalogue_parsed, catalogue_retrieval, catalogue_review, catalogue_rules, catalogue_search, catalogue_tables, catalogue_taxonomy

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else str(v)


PARTS = catalogue, catalogue_review, catalogue_documents, catalogue_search, catalogue_graph, catalogue_tables, catalogue_rules, catalogue_taxonomy, catalogue_retrieval, catalogue_parsed
QUERIES, ORACLE_SQL = ({k: v for p in PARTS for k, v in getattr(p, of).items()} for of in ("QUERIES", "ORACLE_SQL"))


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_same_rows(spark, db, name):
    df, sql = QUERIES[name](spark, SF), db.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    want = sorted(tuple(map(plain, r)) for r in sql.select(*[f'"{c}"' for c in columns]).fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(columns).collect()) == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
