"""Series, curve, protocol and program queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import g1_skew
from ..operators import curves as C
from ..operators import protocol as P
from ..operators import series as S
from ..plans import program as G
from .tables import DAILY, SAMPLES, SERIES, daily, r, rounded, samples, table

STEPS, WINDOWS, PAIRS = [0, 1, 9, 29], [(0, 9), (0, 29), (10, 29)], [(0, 9), (9, 29)]
HOW = ["difference", "ratio", "relative", "log"]


def series_value_at_step(spark, d):
    return rounded(S.value_at_step(daily(spark, d), "entity", "step", ["value"], STEPS, ["last", "mean"]))


def series_value_fallback(spark, d):
    rows = daily(spark, d)
    return rounded(S.value_with_fallback(rows.where("kind = 'view'"), rows, "entity", "step", "value", STEPS))


def raw_step_aggregates(spark, d):
    return rounded(S.raw_aggregate(daily(spark, d), "entity", "step", "event_id", "value", [1, 9], ["last", "max", "min", "std", "var", "skew"], "kind", "Click"))


def series_window_stats(spark, d):
    return rounded(S.window_stats(daily(spark, d), "entity", "step", "value", WINDOWS))


def series_step_delta(spark, d):
    return rounded(S.step_delta(daily(spark, d), "entity", "step", "value", PAIRS, HOW))


def curve_shape_stats(spark, d):
    return rounded(C.curve_shape(samples(spark, d), "entity", "step", "x", "y", [1, 7], "kind", "r", grid=200))


def curve_shape_windowed(spark, d):
    return rounded(C.curve_shape(samples(spark, d), "entity", "step", "x", "y", [1, 7], "kind", "r", grid=200, window=(10.0, 40.0)))


def curve_delta_stats(spark, d):
    return rounded(C.curve_delta(samples(spark, d), "entity", "step", "x", "y", (1, 7), "kind", "r", grid=200))


def curve_delta_transforms(spark, d):
    return rounded(C.curve_delta(samples(spark, d), "entity", "step", "x", "y", (1, 7), "kind", "r", grid=200, window=(10.0, 40.0), transforms=("abs", "log_abs"), later_less_earlier=False))


def protocol_features(spark, d):
    li = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("c1"), (F.col("p_retailprice") / 777).alias("c2"), F.when(F.col("p_size") % 3 != 0, F.col("p_size") / 7.0).alias("c3"), F.lit(None).cast("double").alias("c4"))
    return rounded(P.protocol_features(li, "p_partkey", ["c1", "c2", "c3", "c4", "c5"], products=True))


def adjusted_skew(spark, d):
    return rounded(samples(spark, d).groupBy("entity").agg(g1_skew("y").alias("skew"), g1_skew(F.lit(1.0)).alias("flat_skew")))


def signal_alias_choice(spark, d):
    rows = daily(spark, d).select("entity", "event_id", F.when(F.col("entity") % 3 == 0, F.lit(None)).otherwise(F.col("value")).alias("a"), F.col("value").alias("b"))
    return rounded(S.chosen_alias(rows, "entity", ["a", "b"], "signal").groupBy("entity", "signal_from").agg(F.sum("signal").alias("total"), F.count("signal").alias("n")))


def capacity_summary(spark, d):
    return rounded(S.capacity_summary(daily(spark, d), "entity", "step", "value", 29, [1, 2, 10, 29], late=20))


def first_crossing_lifetime(spark, d):
    return S.first_crossing(daily(spark, d), "entity", "step", "value")


def heuristic_features(spark, d):
    return rounded(S.heuristic_features(daily(spark, d), "entity", "step", "value"))


def step_convention(spark, d):
    return S.step_convention(daily(spark, d), "entity", "step").unionByName(S.step_convention(samples(spark, d).withColumn("entity", -F.col("entity") - 1), "entity", "step"))


def _pairs(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("late"))
    return e.withColumnRenamed("embedding", "early").join(nxt, "vec_id")


def array_difference_stats(spark, d):
    return rounded(P.array_difference(_pairs(spark, d), "vec_id", "early", "late"))


def fifteen_feature_vector(spark, d):
    arrays = _pairs(spark, d).withColumn("axis", F.transform("early", lambda v, i: 2.8 + i.cast("double") / 100)).withColumnRenamed("vec_id", "entity")
    return rounded(P.vector_features(daily(spark, d), arrays, "entity", "step", "value", "early", "late", "axis", 29, 20))


MU, SIGMA, PICKED, BETA, INVERSE = [0.0, 0.1, 0.2, 0.3], [1.0, 0.5, 2.0, 1.5], [0, 1, 3], [0.1, -0.2, 0.3], [[1.0, 0.1, 0.0, 0.0], [0.1, 1.0, 0.0, 0.2], [0.0, 0.0, 1.0, 0.0], [0.0, 0.2, 0.0, 1.0]]


def linear_replay_ci(spark, d):
    return rounded(P.linear_replay(table(spark, d, "embeddings"), "vec_id", "embedding", MU, SIGMA, PICKED, BETA, 2.8, 0.01, 2.0, INVERSE, widest=900.0), 5)


def target_transform_inference(spark, d):
    raw = table(spark, d, "orders").select(F.log10(F.col("o_totalprice") / 200).alias("raw"))
    other = raw.select((-F.col("raw")).alias("raw"))
    return rounded(P.target_transform(raw, "raw").withColumn("batch", F.lit(1)).unionByName(P.target_transform(other, "raw").withColumn("batch", F.lit(2))))


def _program(spark, d):
    p = G.Program("demo", [
        G.Spec("value_at_step", "value", {"steps": [1, 9], "aggs": ["last"]}),
        G.Spec("step_delta", "value", {"pairs": [(1, 9)], "how": ["difference", "log"]}),
        G.Spec("curve_delta", "y", {"pair": (1, 7), "kind_value": "r", "grid": 50}),
        G.Spec("value_at_step", "value", {"steps": [400]}),
        G.Spec("protocol", "", {}, enabled=False),
        G.Spec("learned_embedding_placeholder", "", {}),
    ])
    return p, G.Inputs(daily(spark, d), samples(spark, d), None)


def program_long_features(spark, d):
    return rounded(G.long_features(*_program(spark, d)))


def program_wide_features(spark, d):
    return rounded(G.wide_features(*_program(spark, d)))


def feature_family_counts(spark, d):
    return G.metadata(spark, G.recipe("broad_physics")).groupBy("family").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    series_value_at_step, series_value_fallback, raw_step_aggregates, series_window_stats, series_step_delta, curve_shape_stats, curve_shape_windowed, curve_delta_stats, curve_delta_transforms,
    protocol_features, adjusted_skew, signal_alias_choice, capacity_summary, first_crossing_lifetime, heuristic_features, step_convention, array_difference_stats, fifteen_feature_vector, linear_replay_ci,
    target_transform_inference, program_long_features, program_wide_features, feature_family_counts,
)}

_at = lambda c, v="v": f"max({v}) FILTER (WHERE step = {c})"
_g1 = lambda v: f"CASE WHEN count({v}) = 0 THEN NULL WHEN count({v}) < 3 OR max({v}) - min({v}) <= 1e-12 + 1e-9 * greatest(1.0, max(abs({v}))) OR stddev_pop({v}) <= 1e-12 + 1e-9 * greatest(1.0, max(abs({v}))) THEN 0.0 ELSE skewness({v}) END"


def _window_sql(lo, hi):
    n = lambda s: f"value_{s}_{lo}_{hi}"
    return f"""SELECT entity, {r('avg(v)', n('mean'))}, {r('stddev_pop(v)', n('std'))}, {r('min(v)', n('min'))}, {r('max(v)', n('max'))},
  {r('CASE WHEN count(*) >= 2 THEN arg_max(v, step) - arg_min(v, step) END', n('delta'))}, {r('CASE WHEN count(*) >= 2 THEN regr_slope(v, step) END', n('slope'))},
  {r('CASE WHEN count(*) >= 2 THEN regr_intercept(v, step) END', n('intercept'))}, {r('CASE WHEN count(*) >= 2 AND var_pop(v) > 0 THEN regr_r2(v, step) END', n('r2'))},
  {r('CASE WHEN count(*) >= 3 THEN (sum(t*t) * sum(t*t*e) - sum(t*t*t) * sum(t*e)) / nullif(sum(t*t) * (sum(t*t*t*t) - sum(t*t) * sum(t*t) / count(*)) - sum(t*t*t) * sum(t*t*t), 0) END', n('curvature'))}
  FROM (SELECT *, step - avg(step) OVER (PARTITION BY entity) AS t, v - avg(v) OVER (PARTITION BY entity) AS e FROM series WHERE step BETWEEN {lo} AND {hi}) GROUP BY entity"""


def _delta_sql(a, b, h):
    x, y = _at(a), _at(b)
    return {"difference": f"{y} - {x}", "ratio": f"{y} / nullif({x} + 1e-12, 0)", "relative": f"({y} - {x}) / nullif(abs({x}) + 1e-12, 0)", "log": f"log10(abs({y} - {x}) + 1e-12)"}[h]


def _grid_sql(points, keys, n, window=None):
    """Resampled curves by looking up each place's neighbours: another way than the query's."""
    k = ", ".join(keys)
    rng = f"{window[0]}::DOUBLE AS lo, {window[1]}::DOUBLE AS hi" if window else "min(x) AS lo, max(x) AS hi"
    join = " AND ".join(f"g.{c} = p.{c}" for c in keys)
    return f"""rng AS (SELECT {k}, {rng}, count(*) AS points FROM {points} GROUP BY {k} HAVING count(*) >= 2),
places AS (SELECT {k}, lo, hi, (hi - lo) / {n - 1} AS h, unnest(range(0, {n})) AS i FROM rng WHERE hi > lo),
g AS (SELECT *, CASE WHEN i = {n - 1} THEN hi ELSE lo + i * h END AS q FROM places),
seg AS (SELECT *, lead(x) OVER (PARTITION BY {k} ORDER BY x) AS x2, lead(y) OVER (PARTITION BY {k} ORDER BY x) AS y2, first_value(x) OVER (PARTITION BY {k} ORDER BY x) AS xf, first_value(y) OVER (PARTITION BY {k} ORDER BY x) AS yf FROM {points}),
grid AS (SELECT {', '.join('g.' + c for c in keys)}, g.i, g.h, CASE WHEN g.q < p.xf THEN p.yf WHEN p.x2 IS NULL THEN p.y ELSE p.y + (p.y2 - p.y) * (g.q - p.x) / (p.x2 - p.x) END AS v
  FROM g JOIN seg p ON {join} AND ((g.q >= p.x AND (p.x2 IS NULL OR g.q < p.x2)) OR (p.x = p.xf AND g.q < p.x)))"""


def _points_sql(where, clip=None):
    more = f" AND x BETWEEN {clip[0]} AND {clip[1]}" if clip else ""
    return f"{SAMPLES}, points AS (SELECT entity, step, x, avg(y) AS y FROM samples WHERE lower(kind) = 'r' AND {where}{more} GROUP BY entity, step, x)"


def _shape_sql(window=None):
    return f"""WITH {_points_sql('step IN (1, 7)', window)}, {_grid_sql('points', ['entity', 'step'], 200, window)},
w AS (SELECT *, lag(v) OVER o AS v0, lead(v) OVER o AS v2 FROM grid WINDOW o AS (PARTITION BY entity, step ORDER BY i)),
a AS (SELECT entity, step, {r('min(v)', 'y_min')}, {r('max(v)', 'y_max')}, {r('avg(v)', 'y_mean')}, {r('stddev_pop(v)', 'y_std')}, {r('var_pop(v)', 'y_var')}, {r(_g1('v'), 'y_skew')},
  {r('sum((v + v0) / 2 * h)', 'y_area')}, {r('avg(CASE WHEN v0 IS NULL THEN (v2 - v) / h WHEN v2 IS NULL THEN (v - v0) / h ELSE (v2 - v0) / (2 * h) END)', 'y_gradient')} FROM w GROUP BY entity, step)
SELECT * FROM (SELECT DISTINCT entity, step FROM points) LEFT JOIN a USING (entity, step)"""


def _delta_curve_sql(n, window=None, transforms=("identity",), sign=1, digits_entity="entity"):
    rng = f"{window[0]}::DOUBLE AS lo, {window[1]}::DOUBLE AS hi" if window else "max(lo) AS lo, min(hi) AS hi"
    of = {"identity": "d", "abs": "abs(d)", "log_abs": "log10(abs(d) + 1e-12)"}
    out = []
    for t in transforms:
        out += [r(f"min({t})", f"{t}_min"), r(f"max({t})", f"{t}_max"), r(f"avg({t})", f"{t}_mean"), r(f"stddev_pop({t})", f"{t}_std"), r(f"var_pop({t})", f"{t}_var"), r(_g1(t), f"{t}_skew"),
                r(f"sum(abs({t}))", f"{t}_sum_abs"), r(f"sum({t} * {t})", f"{t}_sum_sq"), r(f"log10(var_pop({t}) + 1e-30)", f"{t}_log_var"),
                r(f"sum((abs({t}) + abs({t}_0)) / 2 * h)", f"{t}_area_abs"), r(f"sum(({t} + {t}_0) / 2 * h)", f"{t}_area_signed")]
    cols = ", ".join(f"{of[t]} AS {t}" for t in transforms)
    lags = ", ".join(f"lag({t}) OVER (PARTITION BY entity ORDER BY i) AS {t}_0" for t in transforms)
    return f"""{_points_sql('step IN (1, 7)', window)},
spans AS (SELECT entity, step, min(x) AS lo, max(x) AS hi, count(*) AS points FROM points GROUP BY entity, step),
both_steps AS (SELECT entity, {rng} FROM spans GROUP BY entity HAVING count(*) = 2 AND min(points) >= 2),
places AS (SELECT entity, lo, hi, (hi - lo) / {n - 1} AS h, unnest(range(0, {n})) AS i FROM both_steps WHERE hi > lo),
g AS (SELECT *, CASE WHEN i = {n - 1} THEN hi ELSE lo + i * h END AS q FROM places),
seg AS (SELECT *, lead(x) OVER o AS x2, lead(y) OVER o AS y2, first_value(x) OVER o AS xf, first_value(y) OVER o AS yf FROM points WINDOW o AS (PARTITION BY entity, step ORDER BY x)),
grid AS (SELECT g.entity, p.step, g.i, g.h, CASE WHEN g.q < p.xf THEN p.yf WHEN p.x2 IS NULL THEN p.y ELSE p.y + (p.y2 - p.y) * (g.q - p.x) / (p.x2 - p.x) END AS v
  FROM g JOIN seg p ON g.entity = p.entity AND ((g.q >= p.x AND (p.x2 IS NULL OR g.q < p.x2)) OR (p.x = p.xf AND g.q < p.x))),
diff AS (SELECT entity, i, max(h) AS h, {sign} * (max(v) FILTER (WHERE step = 7) - max(v) FILTER (WHERE step = 1)) AS d FROM grid GROUP BY entity, i),
t AS (SELECT entity, i, h, {cols} FROM diff), l AS (SELECT *, {lags} FROM t),
agg AS (SELECT entity, {', '.join(out)} FROM l GROUP BY entity),
deltas AS (SELECT * FROM (SELECT DISTINCT entity FROM points) LEFT JOIN agg USING (entity))"""


_PAIRS = "pairs AS (SELECT a.vec_id, a.embedding AS early, b.embedding AS late FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
_DIFF = _PAIRS + ", d AS (SELECT vec_id, unnest(range(1, len(early) + 1)) AS i, early, late FROM pairs), e AS (SELECT vec_id, i, CAST(late[i] AS DOUBLE) - CAST(early[i] AS DOUBLE) AS d, CAST(early[i] AS DOUBLE) AS qa, CAST(late[i] AS DOUBLE) AS qb FROM d)"
_biased = lambda v: f"CASE WHEN var_pop({v}) > 0 THEN skewness({v}) * (count({v}) - 2) / sqrt(count({v}) * (count({v}) - 1)) END"
_log = lambda v: f"log10(nullif(abs({v}), 0))"
_cap = lambda lo: f"FILTER (WHERE step >= {lo})"
_zs = {i: f"((CAST(embedding[{i + 1}] AS DOUBLE) - {MU[i]}) / {SIGMA[i]})" for i in PICKED}
_x = ["1.0", *[_zs[i] for i in PICKED]]
_form = " + ".join(f"{INVERSE[i][j]} * {a} * {b}" for i, a in enumerate(_x) for j, b in enumerate(_x) if INVERSE[i][j])
_fc = "regr_slope(value, step)"

ORACLE_SQL = {
    "series_value_at_step": f"WITH {SERIES} SELECT entity, " + ", ".join(r(_at(c), f"value{a}_step_{c}") for c in STEPS for a in ("", "_mean")) + " FROM series GROUP BY entity",
    "series_value_fallback": f"WITH {DAILY}, s AS (SELECT entity, step, avg(value) AS v FROM daily WHERE kind = 'view' GROUP BY ALL), w AS (SELECT entity, step, avg(value) AS v FROM daily GROUP BY ALL) SELECT w.entity, "
    + ", ".join(r(f"coalesce(max(s.v) FILTER (WHERE w.step = {c}), max(w.v) FILTER (WHERE w.step = {c}))", f"value_step_{c}") for c in STEPS) + " FROM w LEFT JOIN s ON s.entity = w.entity AND s.step = w.step GROUP BY w.entity",
    "raw_step_aggregates": f"WITH {DAILY} SELECT entity, " + ", ".join(
        r(e.replace("$", f"CASE WHEN step = {c} THEN value END"), f"value_{a}_step_{c}") for c in (1, 9)
        for a, e in (("last", f"arg_max(value, event_id) FILTER (WHERE step = {c})"), ("max", "max($)"), ("min", "min($)"), ("std", "stddev_pop($)"), ("var", "var_pop($)"), ("skew", _g1("$")))
    ) + " FROM daily WHERE kind = 'click' AND step IN (1, 9) GROUP BY entity",
    "series_window_stats": f"WITH {SERIES} SELECT * FROM ({_window_sql(*WINDOWS[0])}) FULL JOIN ({_window_sql(*WINDOWS[1])}) USING (entity) FULL JOIN ({_window_sql(*WINDOWS[2])}) USING (entity)",
    "series_step_delta": f"WITH {SERIES} SELECT entity, " + ", ".join(r(_delta_sql(a, b, h), f"value_{h}_{a}_{b}") for a, b in PAIRS for h in HOW) + " FROM series GROUP BY entity",
    "curve_shape_stats": _shape_sql(),
    "curve_shape_windowed": _shape_sql((10.0, 40.0)),
    "curve_delta_stats": f"WITH {_delta_curve_sql(200)} SELECT * FROM deltas",
    "curve_delta_transforms": f"WITH {_delta_curve_sql(200, (10.0, 40.0), ('abs', 'log_abs'), -1)} SELECT * FROM deltas",
    "protocol_features": f"""WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS c1, p_retailprice / 777 AS c2, CASE WHEN p_size % 3 <> 0 THEN p_size / 7.0 END::DOUBLE AS c3, NULL::DOUBLE AS c4 FROM part),
f AS (SELECT *, list_filter([c1, c2, c3, c4], lambda x: x IS NOT NULL) AS l FROM p)
SELECT p_partkey, {r('c1', 'protocol_c1')}, {r('c2', 'protocol_c2')}, {r('c3', 'protocol_c3')}, {r('c4', 'protocol_c4')}, {r('list_avg(l)', 'protocol_mean')}, {r('list_max(l)', 'protocol_max')}, {r('list_var_pop(l)', 'protocol_var')},
  {r('c1 * c2', 'c1_x_c2')}, {r('c2 * c3', 'c2_x_c3')}, {r('c3 * c4', 'c3_x_c4')} FROM f""",
    "adjusted_skew": f"WITH {SAMPLES} SELECT entity, {r(_g1('y'), 'skew')}, 0.0 AS flat_skew FROM samples GROUP BY entity",
    "signal_alias_choice": f"WITH {DAILY} SELECT entity, CASE WHEN entity % 3 = 0 THEN 'b' ELSE 'a' END AS signal_from, {r('sum(value)', 'total')}, count(value) AS n FROM daily GROUP BY entity",
    "capacity_summary": f"""WITH {DAILY}, s AS (SELECT *, min(step) OVER (PARTITION BY entity) AS fs, max(step) OVER (PARTITION BY entity) AS ls FROM daily WHERE step <= 29),
a AS (SELECT entity, {', '.join(f'avg(value) FILTER (WHERE step = {c}) AS at_{c}' for c in (1, 2, 10, 29))}, max(value) AS max, min(value) AS min, avg(value) AS mean, stddev_pop(value) AS std,
  count(*) FILTER (WHERE step >= 2) AS n2, var_pop(step) FILTER (WHERE step >= 2) AS v2, count(*) FILTER (WHERE step >= 20) AS n20, var_pop(step) FILTER (WHERE step >= 20) AS v20,
  regr_slope(value, step) {_cap(2)} AS es, regr_intercept(value, step) {_cap(2)} AS ei, regr_slope(value, step) {_cap(20)} AS ts, regr_intercept(value, step) {_cap(20)} AS ti,
  avg(value) FILTER (WHERE step = fs) AS first, avg(value) FILTER (WHERE step = ls) AS last FROM s GROUP BY entity)
SELECT entity, {', '.join(r(f'at_{c}', f'at_{c}') for c in (1, 2, 10, 29))}, {r('max', 'max')}, {r('max - at_2', 'max_less_2')}, {r('coalesce(at_29, last) - at_10', 'last_less_10')},
  {r('CASE WHEN n2 >= 2 AND v2 > 0 THEN es END', 'early_slope')}, {r('CASE WHEN n2 >= 2 AND v2 > 0 THEN ei END', 'early_intercept')}, {r('CASE WHEN n20 >= 2 AND v20 > 0 THEN ts END', 'late_slope')}, {r('CASE WHEN n20 >= 2 AND v20 > 0 THEN ti END', 'late_intercept')},
  {r('mean', 'mean')}, {r('std', 'std')}, {r('min', 'min')}, {r('first', 'first')}, {r('last', 'last')}, {r('first - last', 'fade')}, {r('(first - last) / nullif(first, 0)', 'fade_share')} FROM a""",
    "first_crossing_lifetime": f"WITH {SERIES}, p AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY step) AS i FROM series), b AS (SELECT entity, coalesce(max(v) FILTER (WHERE i = 2), max(v) FILTER (WHERE i = 1)) AS base FROM p GROUP BY entity) SELECT entity, coalesce(min(i) FILTER (WHERE v < 0.8 * base), max(i))::BIGINT AS life FROM p JOIN b USING (entity) GROUP BY entity",
    "heuristic_features": f"WITH {SERIES}, p AS (SELECT *, row_number() OVER o AS i, v - lag(v) OVER o AS d FROM series WINDOW o AS (PARTITION BY entity ORDER BY step)) SELECT entity, "
    + ", ".join(r(f"coalesce({e}, 0)", n) for e, n in (("arg_min(v, step)", "q0"), ("max(v) FILTER (WHERE i = 2)", "q1"), ("arg_max(v, step)", "qn"), ("CASE WHEN count(*) >= 2 THEN regr_slope(v, step) END", "slope"), ("max(d)", "max_diff"), ("min(d)", "min_diff"), ("avg(v)", "mean"), ("stddev_pop(v)", "std"), ("min(v)", "min")))
    + " FROM p GROUP BY entity",
    "step_convention": f"WITH {DAILY}, a AS (SELECT entity, step FROM daily UNION ALL SELECT -l_suppkey - 1, l_linenumber FROM lineitem) SELECT entity, CASE min(step) WHEN 0 THEN 'raw_zero_based' WHEN 1 THEN 'raw_one_based' ELSE 'unknown' END AS convention, CAST(min(step) AS INTEGER) AS first_step, CAST(max(step) AS INTEGER) AS last_step FROM a GROUP BY entity",
    "array_difference_stats": f"WITH {_DIFF} SELECT vec_id, " + ", ".join(r(e, n) for e, n in (("avg(d)", "d_mean"), (_log("min(d)"), "log_min"), ("abs(avg(d))", "abs_mean"), ("var_pop(d)", "abs_var"), (f"abs(coalesce({_biased('d')}, 0))", "abs_skew"), ("sum(abs(d))", "sum_abs"), ("sum(d * d)", "sum_sq"))) + " FROM e GROUP BY vec_id",
    "fifteen_feature_vector": f"""WITH {DAILY}, {_DIFF},
s AS (SELECT entity, avg(value) FILTER (WHERE step = 2) AS f1, max(value) - avg(value) FILTER (WHERE step = 2) AS f2, avg(value) FILTER (WHERE step = 29) AS f3,
  CASE WHEN count(*) {_cap(2)} >= 2 AND var_pop(step) {_cap(2)} > 0 THEN regr_slope(value, step) {_cap(2)} END AS f4, CASE WHEN count(*) {_cap(2)} >= 2 THEN regr_intercept(value, step) {_cap(2)} END AS f5,
  CASE WHEN count(*) {_cap(20)} >= 2 AND var_pop(step) {_cap(20)} > 0 THEN regr_slope(value, step) {_cap(20)} END AS f6, CASE WHEN count(*) {_cap(20)} >= 2 THEN regr_intercept(value, step) {_cap(20)} END AS f7 FROM daily WHERE step <= 29 GROUP BY entity),
w AS (SELECT *, 2.8 + (i - 1) / 100 AS a, 2.8 + (i - 2) / 100 AS a0, qa - lag(qa) OVER (PARTITION BY vec_id ORDER BY i) AS da, qb - lag(qb) OVER (PARTITION BY vec_id ORDER BY i) AS db FROM e),
t AS (SELECT vec_id AS entity, {_log('min(d)')} AS f8, {_log('avg(d)')} AS f9, {_log('var_samp(d)')} AS f10, {_log(_biased('d'))} AS f11, {_log('max(d) FILTER (WHERE i = 1)')} AS f12, {_log('sum(abs(d))')} AS f13, {_log('sum(d * d)')} AS f14,
  sum((a + a0) / 2 * da) - sum((a + a0) / 2 * db) AS area FROM w GROUP BY vec_id),
j AS (SELECT *, CASE WHEN area > 0 THEN log10(area) END AS f15 FROM s FULL JOIN t USING (entity))
SELECT entity, {', '.join(r(f'f{i}', f'f{i}') for i in range(1, 16))}, {' AND '.join(f'f{i} IS NOT NULL' for i in range(1, 16))} AS available FROM j""",
    "linear_replay_ci": f"""WITH q AS (SELECT vec_id, 2.8 + {' + '.join(f'{b} * {_zs[i]}' for b, i in zip(BETA, PICKED))} AS raw, 2.0 * sqrt(0.01 + 0.01 * ({_form})) AS se FROM embeddings),
c AS (SELECT vec_id, raw, pow(10, raw - se) AS ci_lo, pow(10, raw + se) AS ci_hi, pow(10, raw) AS mid FROM q)
SELECT vec_id, {', '.join(f'round({e}, 5) + 0.0 AS {n}' for e, n in (('raw', 'raw'), ('ci_lo', 'ci_lo'), ('ci_hi', 'ci_hi'), ('ci_hi - ci_lo', 'ci_width'), ('CASE WHEN ci_hi - ci_lo > 900 THEN -1 ELSE mid END', 'prediction')))}, ci_hi - ci_lo > 900 AS anomaly FROM c""",
    "target_transform_inference": f"""WITH a AS (SELECT 1 AS batch, log10(o_totalprice / 200) AS raw FROM orders UNION ALL SELECT 2, -log10(o_totalprice / 200) FROM orders),
m AS (SELECT batch, median(pow(10, raw)) AS dm, median(pow(10, -raw)) AS im FROM a GROUP BY batch)
SELECT batch, {r('dm', 'direct_median')}, {r('im', 'inverse_median')}, CASE WHEN dm BETWEEN 100 AND 3000 THEN 'direct' WHEN im BETWEEN 100 AND 3000 AND dm < 1 THEN 'inverse' ELSE 'error' END AS transform FROM m""",
}

_NAMES = ["identity_" + n for n in ("min", "max", "mean", "std", "var", "skew", "sum_abs", "sum_sq", "log_var", "area_abs", "area_signed")]
_wide = f"""WITH {SERIES}, {_delta_curve_sql(50)},
a AS (SELECT entity, {r(_at(1), 'value_step_1')}, {r(_at(9), 'value_step_9')}, {r(_delta_sql(1, 9, 'difference'), 'value_difference_1_9')}, {r(_delta_sql(1, 9, 'log'), 'value_log_1_9')} FROM series GROUP BY entity),
j AS (SELECT * FROM a FULL JOIN (SELECT entity, {', '.join(f'{n} AS y_{n}_1_7' for n in _NAMES)} FROM deltas) USING (entity))"""
_COLUMNS = ["value_step_1", "value_step_9", "value_difference_1_9", "value_log_1_9", *[f"y_{n}_1_7" for n in _NAMES]]
ORACLE_SQL["program_wide_features"] = _wide + " SELECT * FROM j"
ORACLE_SQL["program_long_features"] = _wide + " " + " UNION ALL ".join(f"SELECT entity, '{c}' AS feature, {c} AS value FROM {'a' if c.startswith('value') else 'j'} WHERE {c} IS NOT NULL" for c in _COLUMNS)
ORACLE_SQL["feature_family_counts"] = """SELECT * FROM (VALUES ('capacity_summary', CAST(122 AS BIGINT)), ('capacity_summary_delta', 24), ('energy_summary', 122), ('energy_summary_delta', 24), ('resistance_summary', 61), ('resistance_summary_delta', 12),
('thermal_summary', 61), ('thermal_summary_delta', 12), ('curve_shape', 280), ('curve_delta', 33)) AS t(family, n)"""
