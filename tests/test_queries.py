"""Every registered query runs on the smallest tables; those with SQL give the same rows as DuckDB."""

import math
import os

import pytest

import __spark_entry__ as entry
from tidelane.plans import queries as plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    assert got or name in plans.ORACLE_SQL
    if name in plans.ORACLE_SQL:
        rows = duck.sql('SELECT {} FROM ({})'.format(', '.join(f'"{c}"' for c in columns), plans.ORACLE_SQL[name])).fetchall()
        assert got == sorted(tuple(plain(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 5 and {"event_type", "frames", "first_pos"} <= set(df.columns)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_run_without_the_training_data_operators():
    """The base library and the registry never need the subpackage of training-data operators."""
    import subprocess
    import sys

    code = "import sys; sys.modules['tidelane.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 100 and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(entry.__file__)))
