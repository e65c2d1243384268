"""The entry module with and without the training-data subpackage, and queries against their SQL."""

import subprocess
import sys

import pytest

import __spark_entry__ as e
from paperquill import registry

DATA = "/root/testdata/sf0.001"
#: On the smallest tables.
MAY_BE_EMPTY = {"decontaminate_benchmark", "consecutive_runs"}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_import_without_session_and_without_llm():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op1_') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=e.__file__.rsplit("/", 1)[0])


def plain(x):
    """A float as nine digits, so that sums in another order compare alike."""
    return f"{x:.9g}" if isinstance(x, float) else repr(x)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    ours = e.queries()[name](spark, DATA)
    cols = sorted(ours.columns)
    theirs = con.sql(e.oracle_sql()[name])
    assert cols == sorted(theirs.columns)
    a = sorted(tuple(plain(r[c]) for c in cols) for r in ours.collect())
    b = sorted(tuple(map(plain, r)) for r in theirs.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert a == b and (a or name in MAY_BE_EMPTY)
