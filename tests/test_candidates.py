"""Candidates end to end, the acquisition loop against explicit features, ragged sources, tables and the tool calls."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave import tools
from cellweave.functions import coerce
from cellweave.operators import evaluation as V
from cellweave.operators import model as D
from cellweave.operators import replay as P
from cellweave.operators import splits as T
from cellweave.plans import candidates as C
from cellweave.plans import entity_features as E
from cellweave.plans import program as G
from cellweave.sources import records as L


@pytest.fixture(scope="module")
def cells(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("cells")
    for name, t in zip("msl", L.generated(spark, cells=60, upto=40, seed=3)):
        t.write.parquet(f"{d}/{name}")
    return tuple(spark.read.parquet(f"{d}/{n}") for n in "msl")


def halves(labels):
    return T.halves(labels, "row_id", 0.25, 1)


@pytest.mark.parametrize("family", list(C.MODELS))
def test_every_family_beats_the_mean(spark, cells, family):
    meta, steps, labels = cells
    splits = halves(labels)
    judge = V.HiddenEvaluator(meta, steps, labels, splits, upto=40)
    settings = {"n_estimators": 8, "learning_rate": 0.3} if family.startswith("Grad") else {"n_estimators": 8} if "Regressor" in family else {"n_alphas": 4, "eps": 0.01} if family.endswith("CV") else {"alpha": 1.0, "nonsense": object()}
    got = judge.evaluate(C.runnable(C.Candidate("c", family, "log10" if family == "Ridge" else "raw", settings=settings), upto=40))
    assert got.success, got.reason
    part = lambda s: labels.join(splits.where(F.col("split") == s), "row_id", "left_semi")
    weak = V.weak_baseline(part("train"), part("validation")).first()
    assert got.metrics["rmse"] < 0.7 * weak.rmse and got.metrics["n"] == 15 and got.predictions.count() == 15


def test_bad_predictions_fail(spark, cells):
    meta, steps, labels = cells
    judge = V.HiddenEvaluator(meta, steps, labels, halves(labels), weak=200.0, strong=100.0)
    one = lambda *cols: lambda tm, ts, tl, vm, vs: vm.select(*cols)
    good = judge.evaluate(one("cell_id", F.lit(700.0).alias("y_pred")))
    assert good.success and good.metrics["gain"] == pytest.approx((200 - good.metrics["rmse"]) / 100)
    for bad, what in (
        (one("row_id"), "y_pred"), (one(F.lit(1.0).alias("y_pred")), "row_id or cell_id"), (one("row_id", F.lit(float("nan")).alias("y_pred")), "non-finite"),
        (one((F.col("row_id") + 1000).alias("row_id"), F.lit(1.0).alias("y_pred")), "extra"), (one(F.lit("anon_cell_99999").alias("cell_id"), F.lit(1.0).alias("y_pred")), "unknown"),
        (lambda tm, ts, tl, vm, vs: vm.union(vm).select("row_id", F.lit(1.0).alias("y_pred")), "duplicate"), (lambda *a: 1 / 0, "division"),
    ):
        got = judge.evaluate(bad)
        assert not got.success and what in got.reason, got
    seen = []
    judge.evaluate(lambda *frames: seen.extend(frames) or frames[3].select("row_id", F.lit(1.0).alias("y_pred")))
    assert not any({"batch_id", "label_source", "cc1", "C1"} & set(f.columns) for f in seen) and seen[2].columns == ["row_id", "cell_id", "y"]
    with pytest.raises(Exception, match="no alias"):
        V.with_alias(spark.range(3).withColumnRenamed("id", "row_id"), V.aliases(spark.range(2).withColumnRenamed("id", "row_id"))).collect()


def test_names_settings_and_variants():
    assert [C.model_family(x) for x in ("GBR", "random-forest", None, "what", "Lasso CV")] == ["GradientBoostingRegressor", "RandomForestRegressor", "Ridge", "Ridge", "LassoCV"]
    assert C.model_family("linear", "elastic net") == "ElasticNetCV"
    assert [C.target_transform(x) for x in ("Log-Y", "log10", "identity", None)] == ["log10", "log10", "raw", "raw"]
    assert [C.feature_set(x) for x in ("Scalars and Curves", "physics", "odd", None)] == ["scalar_plus_curve", "broad_physics", "all_available", "all_available"]
    assert C.clean_settings("Ridge", {"alpha": 2, "bad": 1, "positive": {}}) == {"alpha": 2}
    assert C.clean_settings("LassoCV", None) == {"cv": 3, "max_iter": 10000, "random_state": 0}
    made = C.variants(C.Candidate("x", tables=["t"]), 1, 200, True)
    assert len({c.key() for c in made}) == len(made) == 100 and made[0].family == "Ridge" and made[0].target == "log10" and made[0].features == "curve_only"
    assert len(C.variants(C.Candidate("x"), 0, 1)) == 1 and C.variants(C.Candidate("x", "ridge"), 2, 1)[0].settings == {"alpha": 1.0}
    assert C.from_plans("n", {"include_protocol": 1}, {"family": "forest", "target": "log"}).family == "RandomForestRegressor"
    about = {"a": "capacity_summary", "qdiff": "curve_difference_approximate", "protocol_C1": "protocol"}
    pick = lambda s, p, known=about: C.selected_columns(list(about), known, s, p)
    assert pick("scalar_only", False) == ["a"] and pick("curve_only", True) == ["qdiff"] and pick("protocol_only", True) == ["protocol_C1"] and pick("protocol_only", False) == ["a", "qdiff"]
    assert C.selected_columns(list(about), about, "all_available", True, ["capacity_summary"]) == ["a", "protocol_C1"] and C.selected_columns(list(about), about, "scalar_only", True, ["capacity_summary"]) == ["a"]
    assert C.selected_columns(list(about), about, "all_available", False, ["capacity_summary"]) == ["a"]
    assert pick("all_available", False) == ["a", "qdiff"] and pick("all_available", True) == list(about) and pick("scalar_only", True, {}) == ["a"] and pick("curve_only", True, {}) == ["qdiff"]


def test_feature_tables_are_merged(spark, cells):
    meta, steps, _ = cells
    ids = meta.select("row_id")
    one = E.FeatureTable("p1", ids.withColumn("x", F.lit(1.0)).withColumn("none", F.lit(None).cast("double")), spark.createDataFrame([("x", "curve_shape")], "feature string, family string"))
    two = E.FeatureTable("p2", ids.withColumn("x", F.lit(2.0)))
    made, about = E.all_features(meta, steps, 40, True, [one, two])
    row = made.where("row_id = 5").first()
    assert (row.x, row.p2_x) == (1.0, 2.0) and "none" not in made.columns and about["x"] == "curve_shape" and about["protocol_C1"] == "protocol"
    assert "capacity_cycle_98" not in made.columns and "approx_qdiff_n_10" in made.columns
    assert "x" not in E.all_features(meta, steps, 40, False, [one], ["capacity_summary"])[1]
    frame, cols = C.feature_frame(meta, steps, C.Candidate("c", features="protocol_only"), upto=40, columns=["x", "constant_feature"])
    assert cols == ["x", "constant_feature"] and frame.where("row_id = 1").first().x is None
    with pytest.raises(ValueError):
        E.key_column(["id"])


def test_posterior_equals_explicit_features():
    """The kernel form against the linear model on features whose products are the kernel."""
    r = np.random.default_rng(0)
    arms = np.round(r.uniform(3, 8, (12, 4)), 3)
    best = D.BestArm(arms, gamma=0.3, seed=4)
    gap = ((best.arms[:, None, :3] - best.arms[None, :, :3]) ** 2).sum(axis=2)
    x = np.linalg.cholesky(np.exp(-0.3 * gap) + 1e-12 * np.eye(12))
    seen, y = [3, 7, 3, 11], [1000.0, 800.0, 900.0, 1100.0]
    for turn in (0, 1, 3):
        a = x[seen[: turn + 1]]
        inv = np.linalg.inv(a.T @ a / 164**2 + np.eye(12) / 164**2)
        mean = inv @ a.T @ (np.array(y[: turn + 1]) - 947) / 164**2
        beta = 5 * 0.5**turn
        half = beta * np.sqrt(np.einsum("ij,jk,ik->i", x, inv, x))
        low, high = best.bounds(seen[: turn + 1], y[: turn + 1], turn)
        assert low == pytest.approx(x @ mean - half + 947, abs=2e-4) and high == pytest.approx(x @ mean + half + 947, abs=2e-4)
        left, want = list(range(12)), []
        for _ in range(5):
            gaps = [np.delete(high, k).max() - low[k] if k in left else np.inf for k in range(12)]
            big = int(np.argmin(gaps))
            small = int(np.argmax([high[k] if k in left and k != big else -np.inf for k in range(12)]))
            want.append(big if high[big] - low[big] >= high[small] - low[small] else small)
            left.remove(want[-1])
        chosen, proposal = best.batch(low, high, 5)
        assert chosen == want and proposal == int(np.argmin([np.delete(high, k).max() - low[k] for k in range(12)]))


def test_loop_and_published_check(spark):
    arms = D.policy_space(spark)
    rows = arms.where("C1 = 4.8 AND C2 = 5.2 AND C3 = 5.2").withColumn("prediction", F.lit(1500.0)).unionByName(arms.where("C1 = 3.6").withColumn("prediction", F.lit(500.0)))
    ranking = D.closed_loop(spark, arms, [rows, rows])
    check = {(r.C1, r.C2, r.C3): r for r in D.published_check(ranking).collect()}
    assert check[4.8, 5.2, 5.2].rank == 1 and not check[4.8, 5.2, 5.2].same_top and all(r.found for r in check.values())
    missing = D.published_check(ranking, ((1.0, 2.0, 3.0, 4.0),)).first()
    assert not missing.found and missing.rank is None
    batches = D.next_batches(spark, arms, [rows], batch=7)
    assert batches.groupBy("round").count().collect() == [(0, 7), (1, 7)] or {r["round"]: r["count"] for r in batches.groupBy("round").count().collect()} == {0: 7, 1: 7}
    _, made = D.loop_rounds(arms, [rows, rows])
    assert made[2]["winner"] in (made[0]["proposal"], made[1]["proposal"]) and made[1]["gap"] is not None
    with pytest.raises(ValueError):
        D.closed_loop(spark, arms, [rows.withColumn("C1", F.lit(9.9))])


def test_search_split_guards(spark):
    meta = spark.createDataFrame([(i, f"b{i % 3}", None, 3.6 + i % 2, 4.0, 4.4, 5.0) for i in range(12)], "row_id int, batch_id string, protocol_readable string, C1 double, C2 double, C3 double, C4 double")
    rows, manifest = T.search_split(meta, meta, "protocol", 0.5, 1)
    assert {r.group_key for r in rows.collect()} == {"3.6-4-4.4-5", "4.6-4-4.4-5"} and manifest["n_validation_groups"] == 1 and manifest["n_train_cells"] == 6
    table = meta.select("row_id", F.when(F.col("row_id") < 6, "train").when(F.col("row_id") < 9, "primary_test").otherwise("secondary_test").alias("split"))
    assert T.table_kind(table) == "canonical" and T.table_kind(None) == "absent" and T.table_kind(meta.select("row_id", F.lit("val").alias("split"))) == "legacy"
    rows, manifest = T.search_split(meta, meta, "primary_test", splits=table)
    assert {(r.row_id, r.split) for r in rows.collect()} == {(i, "train" if i < 6 else "validation") for i in range(9)}
    assert {r.row_id for r in T.search_split(meta, meta, "random", splits=table)[0].collect()} == set(range(6))
    assert [r.group_key for r in T.held_groups(T.search_split(meta, meta, "leave_one_batch_out", held_batch="b1")[0]).collect()] == ["b1"]
    assert T.held_groups(T.search_split(meta, meta, "random")[0]).isEmpty()
    for kwargs in ({"mode": "primary_test"}, {"mode": "odd"}, {"mode": "batch", "held_batch": "none"}, {"mode": "random", "share": 1.5}):
        with pytest.raises(ValueError):
            T.search_split(meta, meta, **kwargs)
    with pytest.raises(ValueError):
        T.search_split(meta.withColumn("batch_id", F.lit(T.LOCKED_BATCH)), meta)
    assert {r.split for r in T.parts_of_table(meta, table.where("split = 'train'")).collect()} == {"train", "validation"}


def test_files_and_processed_tables(spark, tmp_path, cells):
    (tmp_path / "raw").mkdir()
    for n in ("b_structure.json", "a_structure.json", "c.json", "list.txt"):
        (tmp_path / "raw" / n).write_text("# why\nx1\n\n x2 \n" if n == "list.txt" else "{}")
    assert [r.path.rsplit("/", 1)[1] for r in L.raw_files(spark, str(tmp_path / "raw")).collect()] == ["a_structure.json", "b_structure.json"]
    assert sorted(r.cell_id for r in L.excluded_ids(spark, str(tmp_path / "raw" / "list.txt")).collect()) == ["x1", "x2"]
    assert L.processed_tables(spark, str(tmp_path / "none"))[3] == "synthetic"
    with pytest.raises(FileNotFoundError):
        L.processed_tables(spark, str(tmp_path / "none"), required=True)
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "metadata.csv").write_text("row_id,cycle_life\n1,500\n2,nan\n3,\n")
    (tmp_path / "p" / "cycle_summary.csv").write_text("row_id,cycle_index\n1,1\n")
    meta, steps, labels, kind = L.processed_tables(spark, str(tmp_path / "p"))
    assert kind == "processed" and [(r.row_id, r.y) for r in labels.collect()] == [(1, 500.0)]
    again = L.generated(spark, cells=60, upto=40, seed=3)
    assert sorted(again[2].collect()) == sorted(cells[2].collect()) and again[1].count() == 2400


def test_ragged_leaves(spark):
    doc = json.dumps({"V": [[1, 2], [3, "x"], None], "step_type": ["Charge ", ["DIS"]], "I": -2, "cycle_index": [7], "Qd": []})
    rows = spark.createDataFrame([("e", json.dumps({"10": json.loads(doc), "9": {"V": 4}, "1": 5}))], "entity string, d string").select("entity", F.parse_json("d").alias("d"))
    got = L.padded_samples(L.step_records(rows, ["entity"], "d"), ["entity"])
    assert [(r.cycle_index, r.step_type, r.voltage, r.current) for r in got.orderBy("cycle_index", F.col("voltage").asc_nulls_last(), "step_type").collect()] == [
        (1.0, "", 4.0, None), (7.0, "charge", 1.0, -2.0), (7.0, "dis", 2.0, -2.0), (7.0, "", 3.0, -2.0),
    ]
    assert got.where("cycle_index = 1").first().voltage == 4.0


def test_replay_checks(spark):
    made = P.checked_model([1, 2, 3], [1, 1, 1], [0.5], [2], [[2.0, 0.0], [0.0, 4.0]])
    assert made["picked"] == [1] and made["inverse"][1][1] == 0.25
    for bad in (([1], [1, 2], [], [], [[1.0]]), ([1, 2], [1, 1], [0.5], [3], [[1, 0], [0, 1]]), ([1, 2], [1, 1], [0.5], [1], [[1.0]])):
        with pytest.raises(ValueError):
            P.checked_model(*bad)
    rows = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 9.0, False)], "C1 double, C2 double, C3 double, C4 double, prediction double, anomaly boolean")
    with pytest.raises(ValueError, match="not in cycles"):
        P.acquisition_input(rows)
    good, bad, _ = P.acquisition_input(rows.withColumn("prediction", F.lit(900.0)))
    assert good.count() == 1 and bad.count() == 0
    assert P.batch_names(["2", "1"], ["x=oed9"]) == {"1": "oed1", "2": "oed2", "x": "oed9"}
    flags = spark.createDataFrame([(i, f, a) for i in (False, True) for f in (False, True) for a in (False, True)], "i boolean, f boolean, a boolean")
    assert [r.s for r in flags.select(P.validation_status(F.col("i"), F.col("f"), F.col("a")).alias("s")).collect()] == ["skipped_missing", "skipped_archive_present", "skipped_by_default", "skipped_archive_present", "failed", "failed", "included", "included"]


def test_values_and_programs(spark):
    rows = spark.createDataFrame([(1, 9, 1.0, 1), (1, 9, 3.0, 2), (1, 8, None, 3), (2, 9, None, 4)], "entity int, step int, q double, at int")
    samples = spark.createDataFrame([(1, 8, 5.0, "a", 1), (1, 8, 7.0, "b", 2), (2, 9, 4.0, "a", 1)], "entity int, step int, q double, kind string, at int")
    from cellweave.operators import series as S

    got = {r.entity: r for r in S.value_at_step(rows, "entity", "step", ["q"], [8, 9], ["last", "max", "std"], order="at").collect()}
    assert (got[1].q_step_9, got[1].q_max_step_9, got[1].q_std_step_9) == (2.0, 3.0, 1.0)
    got = {r.entity: r for r in S.value_at_step(rows, "entity", "step", ["q"], [8, 9], ["mean", "max"], samples, "at", "kind", "A").collect()}
    assert (got[1].q_mean_step_8, got[1].q_mean_step_9, got[1].q_max_step_8, got[2].q_mean_step_9) == (6.0, 2.0, 5.0, 4.0)
    w = {r.entity: r for r in S.window_stats(rows, "entity", "step", "q", [(8, 9)], samples).collect()}
    assert w[1].q_mean_8_9 == 2.0 and w[2].q_mean_8_9 == 4.0  # the second has no value of its own
    p = G.Program("p", [G.Spec("value_at_step", "q", {"steps": [9]}), G.Spec("nothing", "q")])
    made = G.build_table(p, G.Inputs(rows, samples), spark.createDataFrame([(1,), (2,), (3,)], "entity int"))
    assert {r.entity for r in made.exclusions.collect()} == {3} and [s.status for s in made.statuses] == ["ok", "failed"] and made.card["entities_featurized"] == 2
    with pytest.raises(KeyError):
        G.parts(p, G.Inputs(rows), strict=True)
    plan = G.wide_features(G.recipe("scalar_baseline", 30), G.Inputs(rows.select("entity", "step", *[F.col("q").alias(s) for s in G.SIGNALS])), prune=False)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Scan ExistingRDD") == 1 and len(plan.columns) == 1 + 6 * (16 + 45 + 12)


def test_table_is_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 2.0)], "entity int, step int, discharge_capacity double")
    p = G.Program("p", [G.Spec("value_at_step", "discharge_capacity", {"steps": [1, 2]})])
    made = G.build_table(p, G.Inputs(rows), rows.select("entity"))
    G.write_result(made, str(tmp_path / "t"), p)
    assert spark.read.parquet(str(tmp_path / "t/features")).columns == ["entity", "discharge_capacity_step_1"]
    card = json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "t/card")).collect()))
    assert card["families"] == {"capacity_summary": 1} and card["pruned_features"] == 1
    assert G.json_ready({"a": float("nan"), 1: (np.float64(2.0), float("inf"))}) == {"a": None, "1": [2.0, None]} and G.safe_name("a-b.c d") == "ambpc_d"


def test_loose_values():
    assert [coerce.as_text(x, "d") for x in (None, " a ", "", True, [1, None, "b"], {"b": 1, "a": 2})] == ["d", "a", "d", "true", "1, b", '{"a": 2, "b": 1}']
    assert [coerce.as_int(x, 7) for x in ("3.9", None, True, {"n": "4"}, "x", 5.2, {})] == [3, 7, 7, 4, 7, 5, 7]
    assert coerce.as_texts({"a": ["x", ""], "b": 1}) == ["x", "1"] and coerce.as_object('{"a": 1}') == {"a": 1} and coerce.as_object("[1]") == {}
    assert coerce.embedded_object('```json\n{"a": 1}\n```') == {"a": 1} and coerce.embedded_object('so: {"b": 2} done') == {"b": 2} and coerce.unfenced("x\n```py\n1\n```") == "1"
    with pytest.raises(ValueError):
        coerce.embedded_object("[1]")


def test_tool_calls(spark, cells, tmp_path):
    meta, steps, labels = cells
    t = tools.Tools(spark, str(tmp_path / "trace"))
    assert t.list_tools().values["tools"] == list(tools.CALLS) and t.list_feature_programs().values["recipes"] == G.recipes()
    profile = t.profile_dataset(meta, steps, labels)
    assert profile.values["last_step"] == 40 and profile.frames["batch_id_counts"].count() == 4
    assert t.build_battery_features(meta, steps, 40).values["families"]["capacity_summary"] > 10
    got = t.evaluate_candidate(C.Candidate("c", "Ridge"), meta, steps, labels, halves(labels), upto=40)
    assert got.success and got.values["metrics"]["n"] == 15
    assert not t.evaluate_candidate(C.Candidate("c"), meta, steps.drop("row_id"), labels).success
    assert t.review_candidate("x = open('f')\nridge = 1").values == {"verdict": "needs_attention", "issues": ["line 1: file access"], "n_issues": 1, "model": "Ridge"}
    assert t.review_candidate(C.Candidate("c", settings={"bad": 1})).values["verdict"] == "needs_attention"
    runs = spark.createDataFrame([("a",), ("b",)], "run_id string")
    assert t.compare_runs(runs, ["b"]).values["n_runs"] == 1
    trace = spark.read.json(str(tmp_path / "trace"))
    assert trace.count() == 9 and trace.where("NOT success").count() == 1
