import __spark_entry__ as entry


def test_names_match_and_entry_runs(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(oracles) > 120
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["c_custkey", "c_name", "orders", "lines"]


def test_masks_stay_in_the_jvm(spark):
    for name in ("twenty_masks", "smart_mask", "flagship", "best_entity"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan, name
