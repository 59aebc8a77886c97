"""Every registered query with SQL against DuckDB on the smallest tables; the others must run."""

import os

import pytest

from corvane.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else float(v) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((repr(plain(list(r))) for r in df.select(*cols).collect()))
    if name in registry.ORACLES:
        want = sorted(repr(plain(list(r))) for r in duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({registry.ORACLES[name]})").fetchall())
        assert got == want


def test_works_without_the_optional_subpackage(tmp_path):
    """A copy of the repository without the optional folders imports, and has all other queries."""
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(top, tmp_path / "repo", ignore=lambda folder, names: {n for n in names if n in (".git", "llm", "corpus_pipeline.py", "__pycache__")})
    code = "import __spark_entry__ as e; assert 'dense_topk' in e.queries() and not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(e.queries())"
    alone = {**os.environ, "PYTHONPATH": os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and p != top)}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path / "repo", env=alone)
    broken = "import sys; sys.modules['pyarrow'] = None\ntry:\n    import __spark_entry__\nexcept ModuleNotFoundError:\n    print('raised')"
    out = subprocess.run([sys.executable, "-c", broken], check=True, cwd=top, env=alone, capture_output=True, text=True).stdout
    assert "raised" in out  # another missing module is no reason to drop queries in silence
