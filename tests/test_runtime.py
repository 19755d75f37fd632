"""Helpers of the session: what the driver is sent and what stays on disk."""

from pyspark.sql import functions as F

from corpusloom.llm import shared_spans
from corpusloom.runtime import materialize, salted_join


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_side_with_copies_is_broadcast(spark, monkeypatch):
    # the planner takes an exploded side for as small as its source
    left = materialize(spark.range(400).select((F.col("id") % 2).alias("key"), "id"))
    joined = salted_join(left, spark.range(3).select(F.col("id").alias("key"), F.lit("x").alias("more")), "key", least=10)
    assert joined.count() == 400
    assert "SortMergeJoin" in plan(joined)
    plans = {}
    monkeypatch.setattr(shared_spans, "materialize", lambda df, label: (plans.__setitem__(label, plan(df)), materialize(df, label))[1])
    records = spark.createDataFrame([(i, "one passage of all of these records " * 2 + str(i)) for i in range(20)], "rec_id long, text string")
    assert shared_spans.shared_spans([records], 40, 20).count() == 20
    assert "BroadcastHashJoin" not in plans["blocks"] and "SortMergeJoin" in plans["blocks"]


def test_materialised_tables_leave_no_shuffle_files(spark):
    statuses = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    ids = lambda: set(statuses.keySet().mkString(",").split(","))
    before = ids()
    materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert ids() <= before
