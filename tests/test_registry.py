"""The driver's correctness gate at small scale: every registered query is run
on the sf0.001 tables and compared with its DuckDB SQL (row count, column
names, order-insensitive value hash). Queries without SQL must run and keep
their invariants."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracles import digest, duck  # noqa: E402

from topicspace_cases import SF_SMALL  # noqa: E402

from topicspace.plans import oracles, registry  # noqa: E402

# the library's own queries: the training-data ones have their tests in tests/llm
SQL = oracles.oracle_sql()
NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_is_registered_with_its_sql():
    assert set(NAMES) <= set(E.queries())
    assert {k: SQL[k] for k in SQL} == {k: v for k, v in E.oracle_sql().items() if k in SQL}


def test_every_query_has_sql_or_is_a_model():
    models = {"recommend_users_for_items", "recommend_items_for_users", "classifier_predictions",
              "classifier_topk", "learned_embeddings", "pca_centroids"}
    assert set(NAMES) - set(SQL) == models
    assert all(f"{m}_checked" in SQL for m in models)


@pytest.mark.parametrize("name", [n for n in NAMES if n in SQL])
def test_query_matches_sql(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert len(rows) == len(drows)
    assert digest(df.columns, rows)[0] == digest(cols, drows)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["name1", "name2", "distance"]
    rows = df.collect()
    assert len(rows) > 0
    dist = [r.distance for r in rows]
    assert dist == sorted(dist)


def test_model_queries_invariants(spark):
    q = E.queries()
    recs = q["recommend_items_for_users"](spark, SF_SMALL).collect()
    per_user = {}
    for r in recs:
        per_user.setdefault(r.user, []).append(r)
    assert per_user and all(len(v) == 5 for v in per_user.values())
    top = q["classifier_topk"](spark, SF_SMALL).first()
    assert top.k == 5 and 0.0 <= top.accuracy <= 1.0 and top.n > 0
    pca = q["pca_centroids"](spark, SF_SMALL).collect()
    assert len(pca) == 10 and 0.0 < pca[0].explained_variance <= 1.0


def test_outputs_are_scalar_columns(spark):
    from pyspark.sql.types import ArrayType, MapType, StructType
    for name, fn in registry.queries().items():
        for field in fn(spark, SF_SMALL).schema.fields:
            assert not isinstance(field.dataType, (ArrayType, MapType, StructType)), (name, field)
