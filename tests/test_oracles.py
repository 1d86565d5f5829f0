"""Every registered query of the library against its SQL form on the sf0.01 tables."""

import math
import os

import duckdb
import pytest

from crownlake.plans import catalog

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for f in os.listdir(DATA):
        out.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return out


def plain(rows):
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    return sorted((tuple(float(v) if number(v) and not (isinstance(v, float) and math.isnan(v)) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    other = con.sql(catalog.oracle_sql()[name])
    assert sorted(other.columns) == columns
    place = [list(other.columns).index(c) for c in columns]
    expected = [tuple(r[k] for k in place) for r in other.fetchall()]
    assert plain(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()) == plain(expected)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_entry_imports_without_optional_parts(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "crownlake", tmp_path / "crownlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == [str(len(catalog.queries())), "False"], said.stderr


def test_smote_keeps_all_rows_and_levels_the_classes(spark):
    rows = catalog._rows(spark, DATA)
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    out = catalog.smote(spark, DATA)
    assert len(set(counts.values())) > 1
    assert {r.y: r["count"] for r in out.groupBy("y").count().collect()} == dict.fromkeys(counts, max(counts.values()))
    assert out.select("y", "f0").intersectAll(catalog.r6(rows, "f0").select("y", "f0")).count() == sum(counts.values())
