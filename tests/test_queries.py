"""Every query with SQL gives what DuckDB gives on the same tables."""

import datetime
import math
import os

import duckdb
import pytest

import fieldlens.queries  # noqa: F401
from fieldlens.registry import ORACLE_SQL, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


#: Queries for which having nothing to report is the result on the smallest tables.
EMPTY = {"q_inside_polygon"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    expected = duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in expected.fetchall())
    assert got or name in EMPTY, "two empty results show nothing"
    assert any(v not in ("0", "None") for r in got for v in r) or name in EMPTY


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_every_order_gets_an_import_operation(spark, duck):
    got = QUERIES["q_import_all_operations"](spark, FOLDER).filter("entity = 'scene'").count()
    assert got == duck.sql("SELECT count(*) FROM orders").fetchall()[0][0]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_lists_need_no_session():
    """Queries and SQL can be listed by a process that has started no Spark session."""
    import pathlib
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=pathlib.Path(__file__).parent.parent, check=True, timeout=120)


def test_lists_do_without_the_corpus_operators():
    """Where these, or a library they need, can't be imported, the other queries are listed all the same."""
    import pathlib
    import subprocess
    import sys

    for gone in ("fieldlens.llm", "regex", "corpus_pipeline"):
        code = f"import sys; sys.modules[{gone!r}] = None\nimport __spark_entry__ as e\nq = e.queries(); assert len(q) > 200 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
        if gone == "regex":
            code = code.replace(" and 'pipeline' not in q", "")  # it is imported where it is used
        subprocess.run([sys.executable, "-c", code], check=True, cwd=pathlib.Path(__file__).parents[1])
