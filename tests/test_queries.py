"""Every query runs; those with SQL give what DuckDB gives."""

import shutil
import subprocess
import sys

import pytest
from conftest import ROOT, same_rows

from kinmatch.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, duck, name):
    same_rows(QUERIES[name](spark, sf_dir), duck.execute(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns
    assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["s1_id", "cand_id", "p"]
    assert df.count() > 0


def test_entry_tables():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_without_llm(tmp_path, pipeline):
    """The rest of the library stands without the training-data part, whether or not the pipeline's file is left."""
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *([] if pipeline else ["corpus_pipeline.py"])))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'decide' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})


def test_joins_are_equi_joins(spark, sf_dir):
    for name in ("candidates_union", "decide", "tune_grid", "support_features"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        joined = [x for x in ("CartesianProduct", "BroadcastNestedLoopJoin") if x in plan]
        assert not joined or name == "tune_grid" and joined == ["BroadcastNestedLoopJoin"], name
    assert "WindowGroupLimit" in QUERIES["block_word"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
