"""Physical-plan properties of every registered query: no Cartesian product or
nested-loop join, no row-at-a-time Python UDF, and scans that read only the
columns a query uses."""

import pytest

from topicspace.plans import registry as E

from topicspace_cases import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")
# Model queries fit a model while being built (their plans hold the fitted model).
MODELS = {"recommend_users_for_items", "recommend_items_for_users", "classifier_predictions",
          "recommend_users_for_items_checked", "recommend_items_for_users_checked",
          "classifier_topk", "learned_embeddings", "pca_centroids"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(E.queries()) - MODELS))
def test_no_cartesian_no_row_udf(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    for op in FORBIDDEN:
        assert op not in plan, f"{name}: {op}"


def test_scans_are_pruned(spark):
    # (the flagship's final plan starts from its checkpointed category vectors)
    import re
    plan = _plan(E.queries()["word_count"](spark, SF_SMALL))
    schemas = re.findall(r"ReadSchema: struct<[^>]*>", plan)
    assert schemas and all("text:string" in s and "n_chars" not in s and "lang" not in s
                           for s in schemas)
    plan = _plan(E.queries()["lookup_with_default"](spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint>" in plan
    assert "ReadSchema: struct<doc_id:bigint,quality:int>" in plan
    plan = _plan(E.queries()["hash_sample"](spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint>" in plan


def test_vector_sums_are_code_generated(spark):
    df = E.queries()["category_centroid_sum"](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
