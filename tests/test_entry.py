"""The driver's contract: registered queries agree with their SQL, and the rest works without the corpus operators."""

import os
import re
import shutil
import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import duckdb
import pytest
from lakespark.plans.queries import ORACLE_SQL, QUERIES

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return c


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: round(v, 6) if isinstance(v, float) else str(v) if v is not None and not isinstance(v, (int, str)) else v
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def results(spark):
    """Rows of all queries; each makes tables of its own, so a few of them can run at a time."""

    def run(name):
        got = QUERIES[name](spark, DATA)
        return got.columns, [tuple(r) for r in got.collect()]

    with ThreadPoolExecutor(4) as pool:
        yield {name: pool.submit(run, name) for name in QUERIES}


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_sql(results, views, name):
    want = views.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert canonical(*results[name].result()) == canonical(columns, want.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5


def test_without_corpus_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    repo = tmp_path / "repo"
    shutil.rmtree(repo / "lakespark" / "llm", ignore_errors=True)
    shutil.rmtree(repo / "tests" / "llm", ignore_errors=True)
    (repo / "corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not [n for n in q if n.startswith('op')] and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); import bench"
    subprocess.run([sys.executable, "-c", code], cwd=repo, check=True, timeout=120)
    for p in (repo / "lakespark").rglob("*.py"):
        assert not re.search(r"\bllm\b", p.read_text()), p
