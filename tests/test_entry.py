"""The registered queries over the project's smallest tables."""

import subprocess
import sys
from pathlib import Path

import pytest
from conftest import DATA, needs_data

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith("p")])
def test_rows_only(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


@needs_data
def test_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")

    def plain(v):
        return round(float(v), 6) if isinstance(v, float) or hasattr(v, "as_tuple") else v

    core = {n: s for n, s in entry.oracle_sql().items() if n in {**entry.problems.SQL, **entry.catalog.SQL}}
    for name, sql in core.items():
        df = entry.queries()[name](spark, DATA)
        columns = sorted(df.columns)
        cur = c.execute(sql)
        heads = [d[0] for d in cur.description]
        want = sorted((tuple(plain(dict(zip(heads, r))[k]) for k in columns) for r in cur.fetchall()), key=str)
        got = sorted((tuple(plain(r[k]) for k in columns) for r in df.collect()), key=str)
        assert sorted(heads) == columns and got == want, name


def test_core_stands_without_the_subpackage(tmp_path):
    code = (
        "import sys\n"
        "class No:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('corvane.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, No())\n"
        f"sys.path.insert(0, {str(ROOT)!r})\n"
        "import __spark_entry__ as e\n"
        "assert 'p1_found' in e.queries() and 'p3_found' not in e.queries()\n"
    )
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True).returncode == 0
