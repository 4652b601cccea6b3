"""Digests of settings, tables in and out, table checks, records and metric rows of campaigns."""

import itertools
import json

from pyspark.sql import functions as F

from cellweave.functions import digest as D
from cellweave.operators import campaign as K
from cellweave.operators import relational as R
from cellweave.operators import replay as P
from cellweave.sources import payload as L
from cellweave.sources import records as S

SAME = [
    ['{"a": 1, "b": {"x": [1, 2.50], "y": null}}', '{ "b" : {"y":null, "x":[1.0, 25e-1]}, "a": 1e0 }'], ['{"a": []}'], ['{"a": {}}'], ['{"a": null}', '{"a":null}'], ['{}'], ['[]'], ['1', '1.0', '10e-1'], ['"1"'], ['true'], ['"true"'],
    ['{"a": [1, 2]}'], ['{"a": [2, 1]}'], ['{"a": {"0": 1}}'], ['{"a": [1]}'], ['{"a.b": 1}'], ['{"a": {"b": 1}}'], ['{"a": "x=y"}'], ['{"a=x": "y"}'], ['12345678901234567890'], ['12345678901234567891'], ['-0.0', '0'], ['{"é\\n\\"": 1}', '{"\\u00e9\\n\\"": 1}'],
]


def test_equal_settings_share_a_digest(spark):
    rows = [(i, t) for i, group in enumerate(SAME) for t in group]
    got = spark.createDataFrame(rows, "i int, t string").select("i", D.settings_digest(F.parse_json("t")).alias("d")).collect()
    of = {i: {r.d for r in got if r.i == i} for i, _ in rows}
    assert all(len(v) == 1 for v in of.values())
    for a, b in itertools.combinations(of, 2):
        assert of[a] != of[b], (SAME[a], SAME[b])


def test_columns_as_settings(spark):
    df = spark.createDataFrame([(1, None, [1.0, 2.0]), (1, "x", [1.0, 2.0])], "b int, a string, c array<double>")
    x, y = (r[0] for r in df.select(D.columns_digest(["b", "a", "c"])).collect())
    assert x != y and x == df.select(D.columns_digest(["c", "a", "b"])).first()[0]
    lines = spark.range(1).select(D.canonical_lines(F.parse_json(F.lit('{"b": [true, {"k": "v"}], "a": 2.0}')))).first()[0]
    assert lines == ['$.{"k":"a"}=2.0', '$.{"k":"b"}[0]=true', '$.{"k":"b"}[1].{"k":"k"}={"t":"v"}']
    assert spark.range(1).select(D.settings_digest(F.lit(None).cast("variant"))).first()[0] is None


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text("y,x,z\n1.5,2,q\nbad,3,\n")
    got = L.read_table(spark, str(tmp_path / "a.csv"), "x int, y double, w string")
    assert got.dtypes == [("x", "int"), ("y", "double"), ("w", "string")] and [tuple(r) for r in got.collect()] == [(2, 1.5, None), (3, None, None)]
    (tmp_path / "b.csv").write_text("1,2.5\n3,4\n")
    assert [tuple(r) for r in L.read_table(spark, str(tmp_path / "b.csv"), "a int, b double", headless=True).collect()] == [(1, 2.5), (3, 4.0)]
    for compress in (False, True):
        L.write_json(spark.range(2), str(tmp_path / f"j{compress}"), compress)
        assert spark.read.json(str(tmp_path / f"j{compress}")).count() == 2
        assert any(p.name.endswith(".json.gz" if compress else ".json") for p in (tmp_path / f"j{compress}").iterdir())
    for i in range(2):
        L.append_events(spark.createDataFrame([(1, i)], "k int, at int"), str(tmp_path / "t"))
    assert [(r.k, r.at) for r in L.latest(spark.read.json(str(tmp_path / "t")), "k", "at").collect()] == [(1, 1)]


def test_table_problems_and_steps(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("inf")), ("B", None)], "k string, v double")
    assert R.table_problems(df, ["k", "w"], "k", "k") == ["missing column: w", "infinite numbers: v", "not in lower case: k", "repeated: k"]
    assert R.table_problems(df.where("v = 1"), ["k"], "k", "k") == []
    steps = spark.createDataFrame([(0.0,), (1.0,), (2.9,), (4.0,), (None,)], "cycle_index double")
    assert sorted(r[0] for r in S.step_rows(steps, 3).collect()) == [1, 2]


def test_campaign_tables(spark):
    runs = spark.createDataFrame([("r1", "c1", "raw", "p", 1, 5.0), ("r2", "c2", "raw", "p", 2, 4.0), ("r3", "c3", "mix", "q", 3, float("nan"))], "run_id string, best_candidate_id string, recipe string, split_mode string, split_seed int, best_rmse double")
    candidates = spark.createDataFrame([("c1", "r1", 5.0), ("c2", "r2", 4.0)], "candidate_id string, run_id string, rmse double")
    agg = spark.createDataFrame([("c1", "r1", 2.0), ("c2", "r9", 1.0)], "example_candidate_id string, example_run_id string, score double")
    made = K.campaign_summary(runs, candidates, agg)
    assert [(r.candidate_id, r.surrogate_rmse) for r in made["per_run"].collect()] == [("c2", 4.0), ("c1", 5.0)]
    assert made["eligible"].count() == 2 and {(r.split_mode, r.recipe, r.n) for r in made["recipes"].collect()} == {("p", "raw", 2), ("q", "mix", 1)}
    reviews = spark.createDataFrame([("c1", "pass", ["x"])], "candidate_id string, verdict string, issues array<string>")
    evaluations = spark.createDataFrame([("c1", True, 5.0), ("c2", False, None)], "candidate_id string, success boolean, score double")
    rows = K.metric_rows(candidates, reviews, evaluations).collect()
    assert {r.candidate_id for r in rows} == {"c1", "c2"} and all("review_status" in r.__fields__ for r in rows)
    text = K.markdown(candidates.orderBy("rmse"), ["candidate_id", "rmse"])
    assert text.splitlines() == ["| candidate_id | rmse |", "| --- | --- |", "| c2 | 4 |", "| c1 | 5 |"] and K.markdown(candidates.where("rmse > 9"), ["rmse"]) == "No rows."
    ranking = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (None, 1.0), (5.0, None)], "mean double, early double")
    one = P.author_metrics(ranking).first()
    assert one.n == 2 and abs(one.rmse - 0.5**0.5) < 1e-12 and one.mae == 0.5
    assert json.loads(json.dumps(one.asDict()))["n"] == 2
