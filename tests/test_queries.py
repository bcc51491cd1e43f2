"""Every query with SQL against DuckDB on the smallest tables, and the shape of the contract."""

import math

import duckdb
import pytest

import __spark_entry__
from quire.plans.all_queries import ORACLE_SQL, QUERIES
from quire.plans.registry import TABLES

SF = "/root/testdata/sf0.001"


def connect(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, con, name, folder=SF):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall()), key=repr)
    assert columns == sorted(names) and got == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", ["join_09_duplicate_chains", "join_10_style_inheritance", "agg_12_mark_upsert", "fn_43_page_info"])
def test_larger_tables(spark, name):
    test_against_sql(spark, connect("/root/testdata/sf0.1"), name, "/root/testdata/sf0.1")


def test_contract(spark):
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_nothing_outside_llm_needs_it():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for f in (root / "quire").rglob("*.py"):
        if "llm" not in f.relative_to(root / "quire").parts:
            assert "quire.llm" not in f.read_text(), f


def test_blank_lines_of_odd_texts(spark, tmp_path):
    texts = ["a\nb", "a\n", "\n", "", None, "a\r\nb\r", "a\fb\x0bc", "a b\x85c\x1cd", "\t\n \n 　\n​\nx", "a\n\n\n", " \n\x1f\n\r\n\f\n\x00"]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(1, "once\nmore\n"), (None, "a\n")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["flt_01_blank_lines"]).fetchall()
    got = [tuple(r) for r in QUERIES["flt_01_blank_lines"](spark, str(tmp_path)).select("doc_id", "n_lines", "n_filled").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
