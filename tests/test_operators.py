"""Operators on small hand-made tables."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def fade(spark):
    """Three entities, steps 0 to 100, a capacity that fades by 0.001 a step."""
    return spark.range(3).withColumnRenamed("id", "entity").crossJoin(spark.range(101).withColumnRenamed("id", "step")).withColumn("q", 1.12 - 0.001 * F.col("step") - 0.0005 * F.col("entity"))


def test_values_and_slopes(spark, fade):
    from cellweave.operators import series as S

    at = {r.entity: r for r in S.value_at_step(fade, "entity", "step", ["q"], [9, 500]).collect()}
    assert at[0].q_step_9 == pytest.approx(1.111) and at[0].q_step_500 is None
    w = S.window_stats(fade, "entity", "step", "q", [(0, 9)]).where("entity = 0").first()
    assert w.q_slope_0_9 == pytest.approx(-0.001) and w.q_delta_0_9 == pytest.approx(-0.009) and w.q_curvature_0_9 == pytest.approx(0, abs=1e-12)
    d = S.step_delta(fade, "entity", "step", "q", [(0, 9), (0, 500)], ["difference", "log"]).where("entity = 0").first()
    assert d.q_difference_0_9 == pytest.approx(-0.009) and d.q_difference_0_500 is None


def test_missing_values_are_null(spark):
    from cellweave.functions.expr import finite, g1_skew, log10_abs, number, r2, safe_log10

    rows = spark.createDataFrame([(float("nan"), "x"), (float("inf"), "1.5"), (0.0, "nan"), (2.0, None)], "v double, t string")
    got = rows.select(finite("v").alias("f"), number("t").alias("n"), log10_abs("v").alias("l"), safe_log10("v", 1e-12).alias("s")).collect()
    assert [r.f for r in got] == [None, None, 0.0, 2.0] and [r.n for r in got] == [None, 1.5, None, None]
    assert [r.l for r in got] == [None, None, None, pytest.approx(math.log10(2))] and got[2].s == pytest.approx(-12)
    skew = lambda values: spark.createDataFrame([(float(v),) for v in values], "v double").agg(g1_skew("v")).first()[0]
    assert skew([1, 2, 4, 9]) == pytest.approx(1.3309, abs=1e-4) and skew([5, 5, 5]) == 0.0 and skew([1, 2]) == 0.0
    assert spark.createDataFrame([(1.0, 3.0), (2.0, 3.0)], "x double, y double").agg(r2("y", "x")).first()[0] is None


def test_curves(spark):
    from cellweave.operators import curves as C

    rng = np.random.default_rng(0)
    rows = [(e, s, "d", float(x), float(y)) for e in range(4) for s in (1, 7) for x, y in zip(rng.uniform(0, 10, 17), rng.normal(size=17))]
    rows += [(9, 1, "d", 1.0, 2.0), (9, 7, "d", 1.0, 2.0), (1, 1, "d", 3.0, float("nan"))]
    df = spark.createDataFrame(rows, "entity int, step int, kind string, x double, y double")
    for window in (None, (2.0, 12.0)):
        got = {(r.entity, r.step): r for r in C.curve_shape(df, "entity", "step", "x", "y", [1, 7], "kind", "D", grid=50, window=window).collect()}
        for (e, s), r in got.items():
            pts = sorted((x, y) for a, b, _, x, y in rows if (a, b) == (e, s) and y == y and (not window or window[0] <= x <= window[1]))
            if len(pts) < 2:
                assert r.y_mean is None
                continue
            x, y = map(np.array, zip(*pts))
            g = np.linspace(*(window or (x[0], x[-1])), 50)
            v = np.interp(g, x, y)
            assert r.y_mean == pytest.approx(v.mean()) and r.y_var == pytest.approx(v.var()) and r.y_area == pytest.approx(np.trapezoid(v, g)) and r.y_gradient == pytest.approx(np.gradient(v, g).mean())
    same = df.withColumn("y", F.col("x") * 2)
    flat = C.curve_delta(same.where("step = 1").unionByName(same.where("step = 1").withColumn("step", F.lit(7))), "entity", "step", "x", "y", (1, 7)).where("entity = 0").first()
    assert flat.identity_sum_abs == pytest.approx(0) and flat.identity_skew == 0 and flat.identity_log_var == pytest.approx(-30, abs=1e-6)


def test_metrics(spark, monkeypatch):
    from cellweave.operators import metrics as M

    rng = np.random.default_rng(1)
    y = rng.integers(0, 40, 400).astype(float)
    p = np.round(y + rng.normal(0, 9, 400))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, y_pred double")
    s = np.sign(y[:, None] - y) * np.sign(p[:, None] - p)
    tau = s.sum() / np.sqrt(np.abs(np.sign(y[:, None] - y)).sum() * np.abs(np.sign(p[:, None] - p)).sum())
    import pandas as pd

    rho = pd.DataFrame({"y": y, "p": p}).rank().corr().iloc[0, 1]
    for points in (50_000, 100, 10):
        monkeypatch.setattr(M, "RANGE_POINTS", points)
        assert M.rank_correlations(df) == (pytest.approx(rho), pytest.approx(tau))
    fine = df.withColumn("y", F.col("y") + F.rand(1) / 9).withColumn("y_pred", F.col("y_pred") + F.rand(2) / 9).toPandas()
    s = np.sign(fine["y"].to_numpy()[:, None] - fine["y"].to_numpy()) * np.sign(fine["y_pred"].to_numpy()[:, None] - fine["y_pred"].to_numpy())
    assert M.rank_correlations(spark.createDataFrame(fine)) == (pytest.approx(fine.rank().corr().iloc[0, 1]), pytest.approx(s.sum() / (400 * 399)))
    assert M.rank_correlations(df.withColumn("y", F.lit(1.0))) == (None, None) and M.rank_correlations(df.limit(0)) == (None, None)
    assert M.concordance(np.array([1, 1, 2, 2]), np.array([1, 2, 1, 3]), np.array([1.0, 2.0, 3.0, 4.0])) == 12 - 6
    one = spark.createDataFrame([(10.0, 11.0), (20.0, 22.0), (-1.0, 0.0)], "y double, y_pred double").agg(*M.error_metrics()).first()
    assert one.mape == pytest.approx(0.1)
    gain = spark.range(1).select(M.gain_recovered(F.lit(200.0), F.lit(150.0), F.lit(100.0)).alias("a"), M.gain_recovered(F.lit(100.0), F.lit(90.0), F.lit(100.0)).alias("b")).first()
    assert gain.a == 0.5 and gain.b is None


def test_policy_space_and_loop(spark):
    from cellweave.operators import model as D

    arms = D.policy_space(spark)
    assert arms.count() == 224
    toy = arms.limit(4).select("C1", "C2", "C3").withColumn("prediction", F.lit(1200.0))
    ranked = D.closed_loop(spark, arms, [toy]).orderBy("rank").collect()
    assert len(ranked) == 224 and ranked[0].mean > 947
    a = np.random.default_rng(0).normal(size=(9, 9))
    a = a @ a.T + np.eye(9)
    assert np.allclose(D.inverted(a) @ a, np.eye(9))


def test_ridge_matches_its_closed_form(spark):
    from cellweave.operators import model as D

    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2))
    y = x @ [2.0, -1.0] + rng.normal(size=60)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, life double")
    rows = df.withColumn("id", F.monotonically_increasing_id())
    made = D.evaluated(rows, rows, ["a", "b"], "life", "ridge", "id", alpha=3.0).collect()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    want = y.mean() + z @ np.linalg.solve(z.T @ z + 3.0 * np.eye(2), z.T @ (y - y.mean()))
    got = {(round(r.a, 9)): r.y_pred for r in made}
    assert [got[round(float(a), 9)] for a in x[:, 0]] == pytest.approx(want.tolist(), rel=1e-9)


def test_splits_have_no_leaks(spark):
    from cellweave.operators import splits as T

    rows = spark.range(40).withColumn("g", F.col("id") % 7)
    made = T.group_split(rows, "g", 0.25, 1)
    assert T.leaks(made, "split", "g").isEmpty() and made.count() == 40
    assert made.where("split = 'validation'").select("g").distinct().count() == 2
    assert sorted(made.collect()) == sorted(T.group_split(rows, "g", 0.25, 1).collect())


def test_payload_reader(spark, tmp_path):
    import gzip

    from cellweave.sources import payload as L

    doc = {"cycles": {"cycle_index": [9, 9, 10], "step_type": [" Charge", "discharge", "discharge"], "voltage": [], "V": [1.0, 2.0, 3.0], "current": [1, -1, "x"], "temperature": [7.0, 8.0]}}
    with gzip.open(tmp_path / "a_structure.json.gz", "wt") as f:
        f.write(json.dumps(doc))
    (tmp_path / "b.json").write_text("{broken")
    got = L.read_payloads(spark, str(tmp_path))
    assert {r.entity: r.payload is None for r in got.collect()} == {"a": False, "b": True}
    rows = sorted(L.exploded(got, "cycles", ["voltage", "temperature", "internal_resistance"]).collect())
    assert [(r.entity, r.step, r.kind, r.voltage, r.temperature, r.internal_resistance) for r in rows] == [("a", 9.0, "charge", 1.0, 7.0, None), ("a", 9.0, "discharge", 2.0, 8.0, None)]


def test_programs(spark, fade):
    from cellweave.plans import program as G

    assert G.Program.from_json(G.recipe("broad_physics").to_json()) == G.recipe("broad_physics")
    assert {n: G.metadata(spark, G.recipe(n)).count() for n in G.recipes()} == {"scalar_baseline": 438, "curve_delta": 33, "literature": 25, "broad_physics": 751, "minimal_debug": 5}
    p = G.Program("p", [G.Spec("value_at_step", "q", {"steps": [1, 500]})])
    assert not G.requires_samples(p) and G.wide_features(p, G.Inputs(fade)).columns == ["entity", "q_step_1"]
    with pytest.raises(KeyError):
        G.registry.get("nothing")


def test_identity(spark):
    from cellweave.operators import relational as R

    names = spark.createDataFrame([("/a/B_Channel_3_structure.json.gz",), ("x.csv",)], "n string").select(R.identity("n").alias("i")).collect()
    assert [r.i for r in names] == ["b_ch03", "x"]


def test_stream(spark, tmp_path):
    from cellweave.streaming import trace as X

    spark.sql("SELECT TIMESTAMP '2024-01-01 00:10:00' AS ts, 'a' AS kind UNION ALL SELECT TIMESTAMP '2024-01-01 00:20:00', 'a'").write.json(str(tmp_path / "in"))
    counts = X.windowed_counts(X.read_trace(spark, str(tmp_path / "in"), "ts timestamp, kind string"), "ts", "kind")
    q = counts.writeStream.format("memory").queryName("trace_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("trace_counts").first().n == 2
