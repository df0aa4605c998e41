"""Plan guard: no registered job may plan a cartesian product, a nested-loop
join or a Python UDF (the scale rules of the design)."""

import pytest

import __spark_entry__ as entry

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")
KEYS = sorted(k for k in entry.queries() if k not in entry._llm()[0] and (not k.startswith("ml_") or k in entry.oracle_sql()))


@pytest.mark.parametrize("key", KEYS)
def test_plan_has_no_forbidden_operators(spark, key):
    df = entry.queries()[key](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [f for f in FORBIDDEN if f in plan]


def test_scans_are_bounded(spark):
    """Reports that count many things read each table a few times only (size-based broadcast off)."""
    from mercato.params import FIXTURE_PARAMS as P
    from mercato.plans import quality as Q
    from mercato.plans import reports as R
    from mercato.plans.registry import star_for
    from mercato.sources.star import stored

    s = star_for(spark, "/root/testdata/sf0.001")
    loaded = stored(s)
    loaded.raw = s.raw
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        def scans(df):
            return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")

        assert scans(Q.constraint_violations(loaded)) <= 18
        assert scans(Q.cleaning_steps(s.raw, loaded, P)) <= 40
        u = spark.range(10).selectExpr("id as customer_unique_id", "'x' as segment", "id as order_id")
        assert R.unified_checks(u)._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_breakdowns_join_orders_and_customers_once(spark):
    from mercato.params import FIXTURE_PARAMS as P
    from mercato.plans import views as V
    from mercato.plans.registry import star_for
    from mercato.sources.star import stored

    s = stored(star_for(spark, "/root/testdata/sf0.001"))
    plan = V.cancellation_analysis(s, P)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 4  # orders, customers, items, products
    assert plan.count("customer_state") and "grouping_id" in plan.lower()


def test_profile_of_zeros_nulls_and_an_empty_table(spark):
    from mercato.plans.quality import profile_table

    df = spark.createDataFrame([(0.0, "a"), (-0.0, None), (1.5, "a"), (1.5, "a"), (None, "")], "x double, t string")
    got = {r.column_name: r for r in profile_table("t", df).collect()}
    assert (got["x"].rows, got["x"].nulls, got["x"].distinct_values, got["x"].dtype) == (5, 1, 2, "double")
    assert (got["t"].nulls, got["t"].distinct_values, got["t"].dtype, got["t"].duplicate_rows) == (1, 2, "string", 1)
    empty = profile_table("t", df.limit(0)).collect()
    assert [(r.rows, r.nulls, r.distinct_values) for r in empty] == [(0, 0, 0)] * 2
    plan = profile_table("t", df)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
