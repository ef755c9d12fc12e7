"""The driver's contract: every raster query against its SQL."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
import __spark_entry__ as entry  # noqa: E402

from tesselle.plans import queries as raster  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("region", "supplier"):
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def test_names():
    assert set(raster.oracle_sql()) == set(raster.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [["tesselle/llm", "tests/llm"], ["tesselle/llm", "tests/llm", "corpus_pipeline.py"]])
def test_the_rest_stands_alone(tmp_path, gone):
    """Without the training-data operators, with and without their pipeline's file, the raster queries are there."""
    root, copy = Path(__file__).parents[1], tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = copy / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; import tesselle.cli, tesselle.streaming; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('pipeline') or n[:2] == 'op' and n[2].isdigit() for n in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == [str(len(raster.queries())), str(len(raster.oracle_sql())), "False"], done.stderr


def test_entry(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", sorted(raster.queries()))
def test_query(spark, tables, name):
    mine, sql = raster.queries()[name](spark, DATA).toArrow(), tables.sql(raster.oracle_sql()[name]).to_arrow_table()
    names = sorted(mine.schema.names)
    assert names == sorted(sql.schema.names)
    assert [str(mine.schema.field(n).type) for n in names] == [str(sql.schema.field(n).type) for n in names]
    rows = lambda t: sorted(map(str, zip(*(t.column(n).to_pylist() for n in names), strict=True)))
    assert rows(mine) == rows(sql)
