"""Every registered query against its SQL, and plan shapes that must hold at scale."""

import pytest

from recordloom.plans import registry
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, small, name):
    assert differences(spark, name, registry.QUERIES[name], registry.SQL[name], small) is None


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)


def test_entry_points():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, small):
    q = registry.QUERIES
    for name in ("h1_best_order", "d11_best_display", "i3_kind_samples", "i4_group_samples", "i2_review_buckets"):
        assert "WindowGroupLimit" in plan(q[name](spark, small))
    for name in ("f1_longest_match", "f10_classified", "h13_customer_dossier", "e5_foreign_key", "c11_queue"):
        text = plan(q[name](spark, small))
        assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string,p_brand:string,p_type:string>" in plan(q["t1_key_staging"](spark, small))


def test_stored_manifest_needs_no_shuffle(spark, small):
    """Joins of tables in the same buckets: no exchange in the plan, whatever the size at which Spark would broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(registry.QUERIES["h13_stored_dossier"](spark, small))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert text.count("SortMergeJoin") == 3 and "Exchange" not in text
