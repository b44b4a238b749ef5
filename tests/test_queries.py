import importlib

import pytest
from compare import check

MODULES = [importlib.import_module(f"tunefold.plans.{m}") for m in ("general_queries", "playlist_queries", "file_queries", "semantic_queries", "model_queries")]
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, name):
    check(spark, data, name, QUERIES[name], SQL[name])


def test_entry_without_llm(spark):
    import __spark_entry__ as e

    assert set(SQL) <= set(e.oracle_sql())
    assert set(QUERIES) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1


def test_model_queries(spark, data):
    q = QUERIES
    fitted = q["hierarchy_ids"](spark, data).collect()
    assert len(fitted) == len({r["song_id"] for r in fitted}) > 0
    assert all(0 <= r[c] < 4 for r in fitted for c in ("l1", "l2", "l3"))
    same = q["hierarchy_predict"](spark, data).first()
    assert same["songs"] == same["same"] == len(fitted)
    assert q["stream_scoring"](spark, data).count() == len(fitted)
    assert q["random_negative_check"](spark, data).first()["inside"] == 0
    assert q["residual_quantization"](spark, data).count() == 3 * len(fitted)
