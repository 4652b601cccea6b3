"""Sums, cuts and candidates that learn, on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import model as D
from ..operators import penalty as P
from ..operators import splits as T
from ..operators import trees as B
from ..operators import series as S
from .tables import SERIES, daily, r, rounded, table

FEATURES = ["q0", "q1", "qn", "slope", "max_diff", "mean", "std"]


def _labelled(spark, d):
    feats = S.heuristic_features(daily(spark, d), "entity", "step", "value")
    return feats.join(table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), (F.col("c_acctbal") + 1500).alias("life")), "entity")


def feature_sums(spark, d):
    """The sums behind linear candidates, by fold: as correlations, which do not depend on the features' sizes."""
    rows = P.positional_folds(_labelled(spark, d), "entity", 3)
    made = P.combined(P.gram(rows, [*FEATURES, "life"], "fold"))
    own = made.where("i = j")
    a, b = (own.select("fold", F.col("i").alias(c), F.col("sum").alias(f"s{c}")) for c in ("i", "j"))
    share = F.when((F.col("si") > 0) & (F.col("sj") > 0), F.col("sum") / F.sqrt(F.col("si") * F.col("sj")))
    return rounded(made.join(a, ["fold", "i"]).join(b, ["fold", "j"]).select("fold", "i", "j", F.col("n").cast("long").alias("n"), "mean_i", share.alias("share")), 5)


CUT = ["l_linenumber", "l_quantity", "l_discount", "l_tax"]


def first_cuts(spark, d):
    """The best first cut of each kind of line item: what a tree over its price would begin with."""
    li = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.array(*[F.col(c).cast("double") for c in CUT]).alias("x"), (F.col("l_extendedprice") / 1000).alias("r"), F.lit(1.0).alias("w"))
    rows, ranges = B.with_ranges(li, len(CUT))
    made = B.best_cuts(rows, ["l_returnflag", "l_linestatus"], 5, ranges)
    return rounded(made.select("l_returnflag", "l_linestatus", "feature", "cut", F.col("n").cast("long").alias("n"), F.col("n_left").cast("long").alias("n_left"), (F.col("s_left") / F.col("n_left")).alias("left"), ((F.col("s") - F.col("s_left")) / (F.col("n") - F.col("n_left"))).alias("right")), 5)


def _candidate(spark, d, family, **settings):
    rows = T.group_split(_labelled(spark, d), "entity", 0.25, 0)
    made = D.evaluated(rows.where("split = 'train'"), rows.where("split = 'validation'").select("entity", *FEATURES, "life"), FEATURES, "life", family, "entity", **settings)
    return made.select("entity", "y", "y_pred")


def ridge_candidate(spark, d):
    return rounded(_candidate(spark, d, "ridge", alpha=3.0), 4)


def lasso_candidate(spark, d):
    return rounded(_candidate(spark, d, "lasso_cv"), 4)


def elastic_net_candidate(spark, d):
    return rounded(_candidate(spark, d, "elastic_net_cv", l1_ratio=[0.15, 0.5, 0.85]), 4)


def boosted_candidate(spark, d):
    return rounded(_candidate(spark, d, "gradient_boosting"), 4)


def forest_candidate(spark, d):
    return _candidate(spark, d, "random_forest")


def linear_leaderboard(spark, d):
    """Twenty linear candidates, best first: one pass over the features for all of them."""
    rows = T.group_split(_labelled(spark, d), "entity", 0.25, 0)
    parts = {"ends": ("q0", "qn"), "trend": ("slope", "max_diff", "mean"), "spread": ("mean", "std"), "all": tuple(FEATURES)}
    families = [("Ridge", (("alpha", a),)) for a in (0.3, 3.0, 30.0)] + [("LassoCV", (("n_alphas", 25),)), ("ElasticNetCV", (("n_alphas", 25), ("l1_ratio", 0.5)))]
    wanted = [P.Linear(f"{part}_{i}", f, of, False, s) for part, of in parts.items() for i, (f, s) in enumerate(families)]
    lines, scores = P.fit_many(rows, "life", "entity", wanted, F.col("split") == "train")
    board = [(c.name, c.family, len(c.features), scores[c.name]["n"], scores[c.name]["rmse"], lines[c.name].chosen.get("alpha")) for c in wanted]
    return rounded(spark.createDataFrame(board, "name string, family string, n_features int, n int, rmse double, alpha double").orderBy("rmse", "name"), 4)


QUERIES = {f.__name__: f for f in (feature_sums, first_cuts, ridge_candidate, lasso_candidate, elastic_net_candidate, boosted_candidate, forest_candidate, linear_leaderboard)}

_STATS = {"q0": "arg_min(v, step)", "q1": "max(v) FILTER (WHERE i = 2)", "qn": "arg_max(v, step)", "slope": "CASE WHEN count(*) >= 2 THEN regr_slope(v, step) END", "max_diff": "max(d)", "mean": "avg(v)", "std": "stddev_pop(v)"}
_LABELLED = f"""{SERIES}, p AS (SELECT *, row_number() OVER o AS i, v - lag(v) OVER o AS d FROM series WINDOW o AS (PARTITION BY entity ORDER BY step)),
labelled AS (SELECT entity, {', '.join(f'coalesce({e}, 0)::DOUBLE AS {n}' for n, e in _STATS.items())}, max(c_acctbal + 1500)::DOUBLE AS life FROM p JOIN customer ON c_custkey = entity GROUP BY entity)"""
_ALL = [*FEATURES, "life"]
_WIDTH = len(FEATURES)
_sums = " UNION ALL ".join(
    f"SELECT fold, {i} AS i, {j} AS j, count(*) AS n, round(avg({a}), 5) + 0.0 AS mean_i, round(CASE WHEN var_pop({a}) > 0 AND var_pop({b}) > 0 THEN corr({a}, {b}) END, 5) + 0.0 AS share FROM f GROUP BY fold"
    for i, a in enumerate(_ALL) for j, b in enumerate(_ALL) if i <= j
)
_cut_sides = " UNION ALL ".join(f"SELECT l_returnflag, l_linestatus, {i} AS feature, CAST({c} AS DOUBLE) AS v, l_extendedprice / 1000 AS y FROM lineitem" for i, c in enumerate(CUT))

ORACLE_SQL = {
    "feature_sums": f"WITH {_LABELLED}, f AS (SELECT *, CAST(ntile(3) OVER (ORDER BY entity) - 1 AS INTEGER) AS fold FROM labelled) {_sums}",
    "first_cuts": f"""WITH l AS ({_cut_sides}), g AS (SELECT l_returnflag, l_linestatus, feature, v, count(*) AS m, sum(y) AS s FROM l GROUP BY ALL),
c AS (SELECT *, sum(m) OVER o AS ml, sum(s) OVER o AS sl, sum(m) OVER e AS ma, sum(s) OVER e AS sa, lead(v) OVER o AS next FROM g WINDOW o AS (PARTITION BY l_returnflag, l_linestatus, feature ORDER BY v), e AS (PARTITION BY l_returnflag, l_linestatus, feature)),
f AS (SELECT *, CAST(ml * (ma - ml) / ma * (sl / ml - (sa - sl) / (ma - ml)) * (sl / ml - (sa - sl) / (ma - ml)) AS FLOAT) AS fall FROM c WHERE next IS NOT NULL AND ml >= 5 AND ma - ml >= 5)
SELECT l_returnflag, l_linestatus, feature, round((v + next) / 2, 5) + 0.0 AS cut, ma::BIGINT AS n, ml::BIGINT AS n_left, round(sl / ml, 5) + 0.0 AS left, round((sa - sl) / (ma - ml), 5) + 0.0 AS right
FROM f QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY fall DESC, feature, v) = 1""",
    "ridge_candidate": f"""WITH RECURSIVE {_LABELLED}, h AS (SELECT *, md5(CAST(entity AS VARCHAR) || '|0') AS h FROM labelled), k AS (SELECT *, row_number() OVER (ORDER BY h, entity) AS place, count(*) OVER () AS n FROM h),
split AS (SELECT *, place > greatest(1, least(n - 1, round_even(n * 0.25, 0))) AS train FROM k), t AS (SELECT * FROM split WHERE train),
s AS (SELECT avg(life) AS my, {', '.join(f'avg({c}) AS m{i}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS d{i}' for i, c in enumerate(FEATURES))} FROM t),
z AS (SELECT entity, train, life, life - my AS y, {', '.join(f'({c} - m{i}) / d{i} AS z{i}' for i, c in enumerate(FEATURES))} FROM split, s),
m AS ({' UNION ALL '.join(f"SELECT {i + 1} AS i, [{', '.join(f'sum(z{i} * z{j})' + (' + 3.0' if i == j else '') for j in range(_WIDTH))}, sum(z{i} * y)] AS a FROM z WHERE train" for i in range(_WIDTH))}),
g AS (SELECT 0 AS k, i, a FROM m UNION ALL
  SELECT g.k + 1, g.i, CASE WHEN g.i = g.k + 1 THEN list_transform(b.a, lambda x: x / b.a[g.k + 1]) ELSE list_transform(range(1, {_WIDTH + 2}), lambda j: g.a[j] - g.a[g.k + 1] * b.a[j] / b.a[g.k + 1]) END
  FROM g JOIN g b ON b.i = g.k + 1 AND b.k = g.k WHERE g.k < {_WIDTH}),
w AS (SELECT {', '.join(f'max(a[{_WIDTH + 1}]) FILTER (WHERE i = {i + 1}) AS w{i}' for i in range(_WIDTH))} FROM g WHERE k = {_WIDTH})
SELECT entity, {r('life', 'y').replace(', 6)', ', 4)')}, {r('my + ' + ' + '.join(f'w{i} * z{i}' for i in range(_WIDTH)), 'y_pred').replace(', 6)', ', 4)')} FROM z, w, s WHERE NOT train""",
}
