"""Driver contract and a fast oracle pass at sf0.001."""
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as E

from conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events labels".split()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "units_sold" in df.columns and "product_group_name" in df.columns


def test_every_oracle_key_is_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_works_without_the_training_data_operators(tmp_path, with_pipeline):
    """A copy without the operators' folders, with or without the pipeline's
    file: the other queries are all there."""
    repo = Path(E.__file__).resolve().parent
    leave = ["llm", "__pycache__", ".git"] + ([] if with_pipeline else ["corpus_pipeline.py"])
    shutil.copytree(repo, tmp_path / "copy", ignore=shutil.ignore_patterns(*leave))
    script = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(n for n in e.queries() if n[:2] == 'op' or n == 'pipeline'))"
    said = subprocess.run([sys.executable, "-B", "-c", script], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    own = [n for n in E.registry.queries()]
    assert said.stdout.split()[0] == str(len(own)) and said.stdout.strip().endswith("[]")


FAST = ["weekly_sales", "lag_features", "build_features", "pareto_curve", "price_profile", "baseline_report",
        "return_labels", "classifier_metrics", "scenario_pnl", "alpha_sweep", "risk_matrix"]


@pytest.mark.parametrize("name", FAST)
def test_oracle_small(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    sp = E.queries()[name](spark, SF_SMALL).toPandas()
    dp = con.execute(E.oracle_sql()[name]).df()
    assert sorted(sp.columns) == sorted(dp.columns)
    assert len(sp) == len(dp)
    cols = sorted(sp.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    a = sorted((tuple(None if v != v else v for v in r) for r in sp[cols].itertuples(index=False)), key=key)
    b = sorted((tuple(None if v != v else v for v in r) for r in dp[cols].itertuples(index=False)), key=key)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            if isinstance(u, float) or isinstance(v, float):
                assert u == pytest.approx(v, abs=1e-6)
            else:
                assert str(u)[:10] == str(v)[:10]
