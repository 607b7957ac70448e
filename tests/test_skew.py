"""Joins with one row per key, whatever the size of that table."""

import pytest
from pyspark.sql import functions as F

from cadenza.plans.skew import join_small


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_copies_are_shuffled_and_not_sent_through_the_driver(spark, rows, how):
    words = spark.range(500).select((F.col("id") % 7).alias("track_id"), "id")
    table = spark.range(2, 9).select(F.col("id").alias("track_id"), (F.col("id") * 10).alias("shift"))
    joined = join_small(words, table, ["track_id"], ["id"], how)
    assert rows(joined) == rows(words.join(table, ["track_id"], how).select(joined.columns))
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
