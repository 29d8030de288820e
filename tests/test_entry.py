import os

import pytest

import __spark_entry__ as entry

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60


def test_core_stands_alone():
    """Nothing outside the folder llm imports it."""
    for folder, _, files in os.walk(os.path.join(HERE, "cutlight")):
        if os.sep + "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    assert "cutlight.llm" not in open(os.path.join(folder, f)).read(), f


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables absent")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_wide_plan_prunes_columns(spark):
    """Periods of speech read a few columns of the segments, not their embeddings."""
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("test tables absent")
    plan = entry.queries()["p5_found"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "ReadSchema" in plan and "embedding" not in plan.split("ReadSchema")[1].split("\n")[0]
