import duckdb
import pytest

import jobloom.plans.ingestion
import jobloom.plans.normalization
import jobloom.plans.postings
import jobloom.plans.registry  # noqa: F401
from jobloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr([plain(row[k]) for k in at]) for row in cursor.fetchall())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_entry_points_stand_without_the_training_data_part(tmp_path):
    """In a copy without the subpackage, its tests and the pipeline."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root, copy = Path(__file__).resolve().parents[1], tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.json"))
    said = "import __spark_entry__ as e; print(e.llm, e.pipeline, *sorted(e.queries()), *sorted(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-B", "-c", said], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == ["None", "None", *sorted(catalog.QUERIES), *sorted(catalog.ORACLE_SQL)]
