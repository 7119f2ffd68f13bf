import pytest
from pyspark.sql import functions as F

from textguard.operators import policy


def test_a_policy_of_ones_own(spark):
    rows = [(1, 0.9, "harmful", False), (2, 0.5, "borderline", False), (3, 0.1, "clear", False), (4, 0.99, "harmful", True)]
    df = spark.createDataFrame(rows, "id int, score double, level string, self_directed boolean").withColumn("sensitivity", F.lit("x"))
    kind = "sensitivity string, threshold double, minimum_level int"
    own = spark.createDataFrame([("all", 0.0, 0), ("some", 0.4, 1), ("top", 0.4, 2), ("void", None, 0), (None, 0.8, 0)], kind)
    out = policy.hold_policy(df, own)
    assert {(r.id, r.sensitivity) for r in out.collect() if r.held} == {(1, "all"), (2, "all"), (3, "all"), (1, "some"), (2, "some"), (1, "top"), (1, None)}
    assert out.count() == 20 and out.filter("held IS NULL").count() == 0
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert policy.hold_policy(df, own.filter("false")).collect() == []
    with pytest.raises(ValueError):
        policy.hold_policy(df, spark.range(policy.MAX_PROFILES + 1).selectExpr("'a' AS sensitivity", "0e0 AS threshold", "0 AS minimum_level"))


def test_the_default_table_is_the_default(spark):
    df = spark.createDataFrame([(i, i / 20, "harmful" if i >= 14 else "borderline" if i >= 7 else "clear", i % 5 == 0) for i in range(21)], "id int, score double, level string, self_directed boolean")
    rows = [sorted((r.id, r.sensitivity, r.held) for r in policy.hold_policy(df, p).collect()) for p in (None, policy.policy_table(spark))]
    assert rows[0] == rows[1]
