"""Every query with SQL equals DuckDB on the smallest tables; the registry stands without the llm folder."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from cragline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].astype(float) if df[c].dtype.kind in "iufb" else df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


#: whole runs, which tests/test_terrain.py runs too
LONG = {"flow_face_count", "flow_extract", "flow_extract_memory", "flow_extract_face", "flow_single_edge", "str_progress"}


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) - LONG))
def test_query_equals_sql(spark, con, name):
    got, want = normal(registry.queries()[name](spark, SF).toPandas()), normal(con.sql(registry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    same = (got == want) | (got.isna() & want.isna())
    assert same.all().all()


def test_entry_without_llm(tmp_path):
    root = Path(__file__).resolve().parents[1]
    for name in ("cragline", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(root / name), str(tmp_path / name)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "cragline/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'agg_raster_mean' in q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
