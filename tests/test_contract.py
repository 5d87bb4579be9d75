import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract
from check_oracle import compare, connect

ROOT = Path(__file__).resolve().parent.parent
SLOW = {"train_all", "model_report", "fit_forest", "fit_gbt", "fit_gbt_tuned", "feature_importance"}


UNWANTED = ["NestedLoopJoin", "CartesianProduct", "BatchEvalPython", "PythonUDF"]


def test_registry_loads_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_entry(spark):
    assert contract.entry(spark).count() == 5


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, folder, name):
    df = contract.queries()[name](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [p for p in UNWANTED if p in plan]
    rel = connect(folder).sql(contract.oracle_sql()[name])
    assert compare(df.columns, df.collect(), rel.columns, rel.fetchall()) == ""


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql()) - SLOW))
def test_other_queries_return_rows(spark, folder, name):
    assert contract.queries()[name](spark, folder).count() > 0
