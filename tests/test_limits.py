"""A candidate past its deadline fails, leaves no job behind, and the next one runs."""

import time

import pytest
from pyspark.sql import functions as F

from cellweave.operators import evaluation as E
from cellweave.operators.limits import limited


@pytest.fixture(scope="module")
def tables(spark):
    meta = spark.createDataFrame([(i, f"c{i}", "b") for i in range(12)], "row_id long, cell_id string, batch_id string")
    steps = meta.select("row_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("cycle_index"), F.lit(1.0).alias("discharge_capacity"))
    labels = meta.select("row_id", (F.col("row_id") + 100.0).alias("y"))
    return meta, steps, labels


def active(spark):
    until = time.time() + 20
    while (left := list(spark.sparkContext.statusTracker().getActiveJobsIds())) and time.time() < until:
        time.sleep(0.2)
    return left


def endless_plan(meta, steps, labels, test_meta, test_steps):
    spark = test_meta.sparkSession
    slow = spark.range(10**15).groupBy((F.col("id") % 7).alias("k")).agg(F.sum(F.hash("id")).alias("s")).agg(F.sum("s").alias("s"))
    return test_meta.crossJoin(slow).select("row_id", F.col("s").cast("double").alias("y_pred"))


def endless_loop(meta, steps, labels, test_meta, test_steps):
    while True:
        test_meta.count()


def stubborn(meta, steps, labels, test_meta, test_steps):
    while True:
        try:
            test_meta.sparkSession.range(10**12).groupBy().sum().collect()
        except Exception:
            pass


def good(meta, steps, labels, test_meta, test_steps):
    return test_meta.select("row_id", F.lit(105.0).alias("y_pred"))


@pytest.mark.parametrize("candidate", [endless_plan, endless_loop, stubborn])
def test_endless_candidates_fail_in_their_limit(spark, tables, candidate):
    meta, steps, labels = tables
    part = lambda w: (meta.where(w), steps.where(w), labels.where(w))
    began = time.time()
    got = E.evaluated_candidate(candidate, part("row_id < 8"), part("row_id >= 8"), limit=8)
    assert not got.success and got.error_type == "TimeoutError" and "8 seconds" in got.reason
    assert time.time() - began < 40 and not active(spark)
    again = E.evaluated_candidate(good, part("row_id < 8"), part("row_id >= 8"), limit=120)
    assert again.success and again.metrics["n"] == 4


def test_results_and_errors_pass_through(spark):
    assert limited(spark, lambda: spark.range(5).count(), 60) == 5 and limited(spark, lambda: 3, None) == 3
    with pytest.raises(ZeroDivisionError):
        limited(spark, lambda: 1 / 0, 60)
