import __spark_entry__ as entry


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) > 90
    df = entry.entry(spark)
    assert df.limit(5).count() == 5 and "gate_reason" in df.columns


def test_prep_pipeline_reads_its_table_twice(spark, sf):
    """To profile it and to write it with types; the stages' fits and the result read what was written."""
    from checks.queries import QUERIES
    plan = QUERIES["prep_pipeline"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "l_linenumber" not in plan
