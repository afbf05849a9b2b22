import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from granary.plans import registry

SF = "/root/testdata/sf0.001"
has_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(v):
    if v is None or isinstance(v, (bool, str, int)):
        return v
    if isinstance(v, float):
        return float(repr(v))
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return norm(float(v)) if hasattr(v, "as_tuple") else v


@has_data
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    sql = registry.oracles().get(name)
    if sql is None:
        return
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    result = con.sql(sql)
    assert sorted(result.columns) == sorted(df.columns)
    at = [result.columns.index(c) for c in df.columns]
    assert sorted((tuple(map(norm, r)) for r in rows), key=repr) == sorted((tuple(norm(r[i]) for i in at) for r in result.fetchall()), key=repr)


@has_data
def test_entry(spark):
    assert entry.entry(spark).count() == 100


def test_core_stands_without_the_text_problems(tmp_path):
    """The core imports and registers its queries where the subpackage is gone."""
    import shutil

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(root, "granary"), tmp_path / "granary", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p7_found' in q and 'p1_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
