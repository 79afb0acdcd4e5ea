"""Each query beside its SQL, over the smallest tables."""

import duckdb
import pytest

from plazaflow import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def comparable(frame):
    plain = lambda v: str(round(v, 6)) if isinstance(v, float) else str(list(v)) if hasattr(v, "__len__") and not isinstance(v, (str, dict)) else str(v)
    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, sql, sf_dir, name):
    own = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(own) and own.columns.is_unique
        return
    other = sql.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(own.columns) == sorted(other.columns)
    assert comparable(own) == comparable(other)


def test_entry_works_without_the_corpus_operators(tmp_path):
    """The entry imports, and lists the engine's queries, where the corpus folders are gone."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parents[1]
    shutil.copytree(root / "plazaflow", tmp_path / "plazaflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'discover_page' in q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0
