"""Estimators against plain versions: penalty paths, ridge, boosted trees, forests; large-data paths forced on small data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import model, penalty, trees

NAMES = list("abcde")


@pytest.fixture(scope="module")
def sample(spark):
    g = np.random.default_rng(0)
    x = g.normal(size=(240, 5)) * [1, 10, 0.1, 1, 1] + [0, 5000, 0, 3, 0]
    x[:, 4] = np.round(x[:, 4])
    y = 50 + 30 * x[:, 0] + 2 * (x[:, 1] - 5000) + 100 * x[:, 2] + g.normal(size=240) * 20
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "entity int, a double, b double, c double, d double, e double, y0 double").repartition(5), x, y


def descent(x, y, alpha, ratio, rounds=3000):
    """Elastic net by coordinate descent on the rows, with an intercept."""
    xc, yc = x - x.mean(0), y - y.mean()
    w, n = np.zeros(x.shape[1]), len(y)
    for _ in range(rounds):
        for j in range(len(w)):
            rho = xc[:, j] @ (yc - xc @ w + xc[:, j] * w[j]) / n
            w[j] = np.sign(rho) * max(abs(rho) - alpha * ratio, 0) / (xc[:, j] @ xc[:, j] / n + alpha * (1 - ratio))
    return w, y.mean() - x.mean(0) @ w


@pytest.mark.parametrize("family, ratios", [("lassocv", [1.0]), ("elasticnetcv", [0.5]), ("elasticnetcv", [0.15, 0.9])])
def test_penalty_paths(spark, sample, family, ratios):
    df, x, y = sample
    x, y = x[:239], y[:239]
    df = df.where("entity < 239")
    settings = {"n_alphas": 8} | ({"l1_ratio": ratios if len(ratios) > 1 else ratios[0]} if family != "lassocv" else {})
    one = penalty.Linear("m", {"lassocv": "LassoCV"}.get(family, "ElasticNetCV"), tuple(NAMES), False, tuple(settings.items()))
    line = penalty.fit_many(df, "y0", "entity", [one])[0]["m"]
    fold = np.concatenate([np.full(len(p), k) for k, p in enumerate(np.array_split(np.arange(239), 3))])  # runs by position
    z = (x - x.mean(0)) / x.std(0)
    errors = {}
    for ratio in ratios:
        top = np.abs((z * (y - y.mean())[:, None]).mean(0)).max() / ratio
        for alpha in np.geomspace(top, top * 1e-3, 8):
            fits = [(k, *descent(z[fold != k], y[fold != k], alpha, ratio, 300)) for k in range(3)]
            errors[(alpha, ratio)] = np.mean([((y[fold == k] - z[fold == k] @ w - b) ** 2).mean() for k, w, b in fits])
    alpha, ratio = min(errors, key=errors.get)
    w, b = descent(z, y, alpha, ratio)
    assert line.chosen["alpha"] == pytest.approx(alpha, rel=1e-9) and line.chosen["l1_ratio"] == ratio
    assert line.chosen["fold_error"] == pytest.approx(errors[(alpha, ratio)], rel=1e-6)
    assert np.abs(line.weights * x.std(0) - w).max() < 1e-6 * np.abs(w).max()
    made = df.select("entity", line.prediction().alias("p")).orderBy("entity").collect()
    assert [r.p for r in made] == pytest.approx((z @ w + b).tolist(), rel=1e-6)


def test_sums_of_folds(spark, sample):
    """Means far from zero lose nothing; folds are runs of neighbours, the first ones longer."""
    df, x, y = sample
    far = df.withColumn("a", F.col("a") + 1e9)
    folded = penalty.positional_folds(far, "entity", 7)
    sizes = [r["count"] for r in folded.groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [35, 35, 34, 34, 34, 34, 34]
    made = penalty.sums_by_fold(folded, [*NAMES, "y0"])
    both = np.column_stack([x, y])
    assert sum(s.n for s in made.values()) == 240
    for k, part in enumerate(np.array_split(both, 7)):
        dev = part - part.mean(0)
        assert np.allclose(made[k].cross, dev.T @ dev, rtol=1e-5) and np.allclose(made[k].mean - [1e9, 0, 0, 0, 0, 0], part.mean(0), rtol=1e-6, atol=1e-6)
    total = sum(list(made.values())[1:], made[0])
    dev = both - both.mean(0)
    assert np.allclose(total.cross, dev.T @ dev, rtol=1e-5)


def test_many_candidates_from_one_pass(spark, sample):
    """A leaderboard of twenty reads the features once for all of them and equals single evaluations."""
    df, x, y = sample
    df = df.withColumn("y0", F.col("y0") + 4000).withColumn("c", F.when(F.col("entity") % 9 > 0, F.col("c")))
    families = [("Ridge", (("alpha", 3.0),)), ("Ridge", (("alpha", 30.0),)), ("LassoCV", (("n_alphas", 6),)), ("ElasticNetCV", (("n_alphas", 6), ("l1_ratio", 0.5))), ("Ridge", (("alpha", 1.0), ("fit_intercept", False)))]
    wanted = [penalty.Linear(f"{f}{i}{j}", f, t, i == 3, s) for i, t in enumerate([("a", "b"), ("c", "d", "e"), tuple(NAMES), ("b", "c")]) for j, (f, s) in enumerate(families)]
    train = F.col("entity") % 4 > 0
    lines, scores = penalty.fit_many(df, "y0", "entity", wanted, train)
    assert len(lines) == len(scores) == 20
    for c in wanted[::3]:
        made = model.evaluated(df.where(train), df.where(~train), list(c.features), "y0", c.family, "entity", c.log_target, **dict(c.settings)).collect()
        want = np.array([np.log10(r.y) if c.log_target else r.y for r in made]) - np.array([np.log10(r.y_pred) if c.log_target else r.y_pred for r in made])
        assert scores[c.name]["n"] == 60 and scores[c.name]["rmse"] == pytest.approx(np.sqrt((want**2).mean()), rel=1e-6)


def best_cut(x, y, w, least):
    best = None
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        for a, b in zip(v, v[1:]):
            left = x[:, f] <= a
            if min(left.sum(), (~left).sum()) < least:
                continue
            n, m = w[left].sum(), w[~left].sum()
            fall = np.float32(n * m / (n + m) * ((w[left] @ y[left]) / n - (w[~left] @ y[~left]) / m) ** 2)
            if best is None or fall > best[0]:
                best = fall, f, (a + b) / 2 if (a + b) / 2 < b else a
    return best


def tree(x, y, w, least, depth):
    """A function of a row."""
    if (depth is None or depth > 0) and len(y) > 1 and y.max() > y.min() and (cut := best_cut(x, y, w, least)):
        _, f, c = cut
        left = x[:, f] <= c
        sides = [tree(x[s], y[s], w[s], least, None if depth is None else depth - 1) for s in (left, ~left)]
        return lambda r: sides[0 if r[f] <= c else 1](r)
    mean = (w @ y) / w.sum()
    return lambda r: mean


def small_sample(spark):
    g = np.random.default_rng(4)
    x = np.round(g.normal(size=(90, 3)), 1)
    y = np.round(3 * x[:, 0] + np.abs(x[:, 1]) * 2 + g.normal(size=90), 3)
    rows = [(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, x array<double>, y double").repartition(3), x, y


@pytest.mark.parametrize("small, ranges", [(20_000, 50_000), (0, 50_000), (0, 20)])
def test_boosted_trees(spark, monkeypatch, small, ranges):
    df, x, y = small_sample(spark)
    monkeypatch.setattr(trees, "SMALL", small)
    monkeypatch.setattr(trees, "RANGE_VALUES", ranges)
    monkeypatch.setattr(trees, "SETTLE", 2)
    n = 12 if small else 5
    made = trees.boosted(df, 3, trees=n, rate=0.3, depth=2, least=3)
    want, one = np.full(90, y.mean()), np.ones(90)
    for _ in range(n):
        grown = tree(x, y - want, one, 3, 2)
        want = want + 0.3 * np.array([grown(r) for r in x])
    got = df.select("id", made.prediction().alias("p")).orderBy("id").collect()
    assert len(made.trees) == n and [r.p for r in got] == pytest.approx(want.tolist(), rel=1e-9)


@pytest.mark.parametrize("small, depth", [(20_000, None), (40, None), (30, 3)])
def test_forest(spark, monkeypatch, small, depth):
    """Every tree of the forest is a brute-force one on its sample; large nodes are cut by jobs."""
    df, x, y = small_sample(spark)
    monkeypatch.setattr(trees, "SMALL", small)
    test = df.select("id", "x").where("id % 3 = 0")
    got = {r.id: r.prediction for r in trees.forest(df, test, 3, trees=4, depth=depth, least=2, seed=7).collect()}
    w = np.array([[r.w for r in df.select("id", trees.drawn(F.lit(t), F.col("id"), 7).alias("w")).orderBy("id").collect()] for t in range(4)])
    assert 0.7 < w.mean() < 1.3
    want = np.zeros(90)
    for t in range(4):
        there = w[t] > 0
        grown = tree(x[there], y[there], w[t][there], 2, depth)
        want += np.array([grown(r) for r in x]) / 4
    assert len(got) == 30 and all(got[i] == pytest.approx(want[i], rel=1e-9) for i in got)


def test_ensembles_have_the_reference_sizes():
    assert model.FOREST_SIZES == {"trees": 160, "least": 2, "seed": 19} and model.BOOSTED_SIZES == {"trees": 120, "depth": 2, "rate": 0.05, "seed": 23}


def test_awkward_tables(spark):
    """No rows, equal labels, missing features, one row."""
    empty = spark.createDataFrame([], "id int, a double, b double, y double")
    some = spark.createDataFrame([(1, 2.0, None, 5.0), (2, None, None, 5.0), (3, 4.0, None, 5.0)], empty.schema)
    for family in ("ridge", "lasso", "elasticnet", "gbr", "forest"):
        extra = {"trees": 3} if family in ("gbr", "forest") else {}
        assert [r.y_pred for r in model.evaluated(some, some, ["a", "b"], "y", family, "id", **extra).collect()] == pytest.approx([5.0] * 3)
        assert model.evaluated(some, empty, ["a", "b"], "y", family, "id", **extra).count() == 0


@pytest.mark.parametrize("least, subsample", [(1, 1.0), (4, 0.6)])
def test_blocks_and_one_task_grow_the_same_boosted_trees(spark, monkeypatch, least, subsample):
    """A feature with a value so common that it is dealt in parts, a constant one, and one with many values."""
    g = np.random.default_rng(11)
    x = np.column_stack([g.normal(size=400), np.where(g.random(400) < 0.7, 1.0, g.integers(0, 5, 400)), np.full(400, 2.0)])
    y = np.round(x[:, 0] + 2 * (x[:, 1] > 2) + g.normal(size=400), 3)
    df = spark.createDataFrame([(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))], "id int, x array<double>, y double").repartition(3)
    made = []
    for few in (20_000, 0):
        monkeypatch.setattr(trees, "FEW", few)
        monkeypatch.setattr(trees, "RANGE_VALUES", 30)
        monkeypatch.setattr(trees, "SETTLE", 2)
        model = trees.boosted(df, 3, trees=5, rate=0.3, depth=3, least=least, subsample=subsample)
        made.append([r.p for r in df.select("id", model.prediction().alias("p")).orderBy("id").collect()])
    assert made[1] == pytest.approx(made[0], rel=1e-9)


def test_boosted_trees_leave_the_driver_no_plans(spark, monkeypatch):
    """A level was a query whose plan held all before it; now levels are no queries."""
    df, _, _ = small_sample(spark)
    monkeypatch.setattr(trees, "FEW", 0)
    monkeypatch.setattr(trees, "SETTLE", 2)
    queries = lambda: spark._jsparkSession.sharedState().statusStore().executionsCount()
    counts = []
    for n in (1, 6):
        before = queries()
        assert len(trees.boosted(df, 3, trees=n, rate=0.3, least=3).trees) == n
        counts.append(queries() - before)
    assert counts[0] == counts[1]


@pytest.mark.parametrize("least, depth, fewest", [(2, None, 2), (1, 4, 2), (3, None, 9)])
def test_nodes_that_grow_together_grow_as_alone(monkeypatch, least, depth, fewest):
    g = np.random.default_rng(8)
    x = np.column_stack([np.round(g.normal(size=700), 1), g.normal(size=700), np.full(700, 1.0)])
    x = np.column_stack([x, x[:, 0]])
    y, w = np.round(g.normal(size=700) * 100, 2), g.poisson(1, 700).astype(float)
    made = []
    for together in (0, 60, 20_000):
        monkeypatch.setattr(trees, "TOGETHER", together)
        made.append(trees.grown(x, y, w, least, depth, fewest=fewest).tolist())
    assert made[0] == pytest.approx(made[1], rel=1e-12) and made[0] == pytest.approx(made[2], rel=1e-12)
    there = w > 0
    if fewest == 2:
        brute = tree(x[there], y[there], w[there], least, depth)
        assert made[2] == pytest.approx([brute(r) for r in x], rel=1e-9)
