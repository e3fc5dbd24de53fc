"""The texts of pack_summary are read once, before anything is packed."""

from ctxloom.plans import queries as Q


def test_texts_are_not_read_for_the_packing(spark):
    plan = Q.pack_summary(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "tokens" in plan and "split(" not in plan
