"""Every registered query of the library runs, and gives the rows of its SQL."""

import subprocess
import sys
from pathlib import Path

import pytest

from trackloom.plans import registry


def rows(df):
    def plain(x):
        if x is None or x != x:
            return None
        return round(float(x), 5) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted((tuple(plain(x) for x in r) for r in df), key=repr)


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, duck, name):
    got = registry.QUERIES[name](spark, data)
    cols = sorted(got.columns)
    have = rows(map(tuple, got.select(*cols).collect()))
    cursor = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in cursor.description]
    order = [names.index(c) for c in cols]
    assert sorted(names) == cols and have == rows(tuple(r[i] for i in order) for r in cursor.fetchall())


def test_entry_point_is_imported_without_a_session():
    """The driver imports it before it has a session."""
    root = Path(__file__).resolve().parents[1]
    code = "import __spark_entry__ as e; assert e.queries().keys() >= e.oracle_sql().keys() and e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
