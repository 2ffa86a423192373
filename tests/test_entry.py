"""The driver's entry: names, a query and its SQL, and life without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT, DATA = Path(__file__).resolve().parent.parent, "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.oracle_sql()) >= 55


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_flagship_and_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    expected = duckdb.sql(entry.oracle_sql()["compact_logs"].replace("FROM events", f"FROM '{DATA}/events.parquet'")).order("doc_id")
    got = entry.entry(spark).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in expected.columns) for r in got] == expected.fetchall()


def test_works_without_the_subpackage(tmp_path):
    (tmp_path / "tersely").mkdir()
    for path in [ROOT / "__spark_entry__.py", *(ROOT / "tersely").rglob("*.py")]:
        if "llm" not in path.relative_to(ROOT).parts:
            target = tmp_path / path.relative_to(ROOT)
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(path.read_text())
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()), 'pipeline' in e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.stdout.split()[1:] == ["False", "False"], done.stderr
