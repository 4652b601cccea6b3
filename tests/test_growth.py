"""What a query moves, holds or works out may grow no faster than its rows."""

import numpy as np
from cellweave.functions import digest
from cellweave.operators import curves, order_stats, series, trees
from pyspark.sql import functions as F


def test_a_digest_is_worked_out_once_a_text(spark):
    rows = spark.createDataFrame([('{"a": 1, "b": [2]}', 1), ('{"b": [2.0], "a": 1e0}', 2), ('{"a": 1, "b": [2]}', 3), ('{"a": 2}', 4), (None, 5)], "t string, v int")
    made = digest.by_digest(rows, "t", [F.count("*").alias("n"), F.max("v").alias("v")], [F.sum("n").alias("n"), F.max("v").alias("v")])
    assert sorted((r.digest is None, r.n, r.v) for r in made.collect()) == [(False, 1, 4), (False, 3, 3), (True, 1, 5)]
    plan = made._jdf.queryExecution().optimizedPlan().toString().split("\n")
    opened = next(i for i, line in enumerate(plan) if "parsejson" in line.lower().replace("_", ""))
    assert any("Aggregate [t" in line for line in plan[opened + 1 :])


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def test_moments_are_made_where_an_entity_lies(spark):
    """Partial moments, which are wide, were moved and held for all entities; now the rows move and are sorted."""
    rows = spark.createDataFrame([(e, s, float((e or 0) * s)) for e in (1, 2, None) for s in range(6)], "e int, s int, v double")
    made = series.window_stats(rows, "e", "s", "v", [(0, 4), (1, 5)])
    lines = _plan(made)
    sums = [i for i, line in enumerate(lines) if "SortAggregate" in line]
    assert len(sums) == 2
    below = lines[sums[-1] + 1 :]
    assert "Sort [e" in below[0] and "Exchange hashpartitioning(e" in below[1]
    assert {r.e: r.v_mean_0_4 for r in made.collect()} == {1: 2.0, 2: 4.0, None: 0.0}


def test_values_stay_where_cuts_come_to(spark):
    rows = spark.range(3000).selectExpr("0 AS g", "id * 7 % 3001 AS v")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = order_stats.ranked_values(rows, ["g"], spark.createDataFrame([(0, 10)], "g int, k long"), 100)
        assert sum("BroadcastHashJoin" in line for line in _plan(found)) >= 2
        assert found.first().v == sorted(i * 7 % 3001 for i in range(3000))[10]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_level_of_a_boosted_tree_moves_no_rows(spark):
    rows = spark.range(200).selectExpr("id", "array(CAST(id AS DOUBLE), CAST(id % 7 AS DOUBLE)) AS x", "array(CAST(id > 99 AS INT), 0) AS b", "CAST(id > 49 AS DOUBLE) AS r", "1.0D AS w")
    held = trees._laid_out(trees._by_feature(rows, ["id", "x", "w", "r"]).repartition("feature", "b"))
    made = trees._best(held.withColumn("node", F.when(F.col("r") >= 0, 0).cast("int")), ["node"], 1, 2, few=True)
    assert not [line for line in _plan(made) if "Exchange hashpartitioning" in line and "b#" in line and "REPARTITION_BY_COL" not in line]
    assert made.first().cut == 49.5


def test_a_tree_of_many_rows_is_one_task(spark, monkeypatch):
    monkeypatch.setattr(trees, "best_cuts", lambda *a: 1 / 0)
    train = spark.range(30_000).selectExpr("id", "array(CAST(id AS DOUBLE)) AS x", "CAST(id > 9999 AS DOUBLE) AS y")
    test = spark.createDataFrame([(1, [5.0]), (2, [20000.0])], "id long, x array<double>")
    assert {r.id: r.prediction for r in trees.forest(train, test, 1, trees=2).collect()} == {1: 0.0, 2: 1.0}


def test_places_of_single_curves_are_no_groups(spark):
    """Beside a pair, each of a single curve's 1,000 places was a group of a table in memory."""
    rows = spark.createDataFrame([(e, s, float(x), float(x * s + e)) for e in (1, 2) for s in (0, 1) for x in range(3)], "e int, s int, x double, y double")
    wanted = [curves.Curve("y", (0, 1)), curves.Curve("y", (0, 1), True)]
    made = curves.curve_stats(rows, "e", "s", "x", wanted, aggs=("mean", "max"))
    assert {(r.task, r.slot, r.e): (r.shape_max, r.identity_max) for r in made.collect()} == {(0, 0, 1): (1.0, None), (0, 0, 2): (2.0, None), (0, 1, 1): (3.0, None), (0, 1, 2): (4.0, None), (1, -2, 1): (None, 2.0), (1, -2, 2): (None, 2.0)}
    by = [line for line in _plan(made) if "HashAggregate(keys=" in line]
    assert by and not any(" i#" in line.split("functions=")[0] for line in by)


def test_a_small_node_of_a_tree_is_no_step_of_its_own(monkeypatch):
    """Each node was cut alone and compared all rows of its task."""
    monkeypatch.setattr(trees, "_cut", lambda *a: 1 / 0)
    x = np.arange(3000.0)[:, None] * 7 % 3001
    assert trees.grown(x, x[:, 0], np.ones(3000), 1, None).tolist() == x[:, 0].tolist()
