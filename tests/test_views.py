from millrace.plans.views import run


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    df = run(spark, sf_dir, ["orders", "customer"], "SELECT c_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY c_name")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "struct<o_custkey:bigint,o_totalprice:double>" in plan
    assert df.count() > 0
