"""The recipes and the entity features on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as S
from ..plans import entity_features as E
from ..plans import program as G
from .features import _at, _delta_sql, _g1
from .tables import DAILY, r, rounded, table
from .tables import daily as daily_rows

# The signals as functions of the events' value, and of a line item's price in thousands.
SIGNALS = {"discharge_capacity": "value", "charge_capacity": "value * 1.5 + 1", "internal_resistance": "5 - value", "temperature": "value / 3 + 20", "discharge_energy": "value * 3.5", "charge_energy": "CASE WHEN kind <> 'view' THEN value * 2 END"}
CURVES = {"discharge_capacity": "y", "charge_capacity": "2 * y", "current": "3 - y", "temperature": "y / 2 + 7"}
FIRST, EARLY, LATE = 30, 1, 7
KIND = "CASE l_returnflag WHEN 'R' THEN 'Discharge' WHEN 'A' THEN 'charge ' ELSE 'rest' END"


def _inputs(spark, d):
    rows = daily_rows(spark, d).select("entity", "step", *[F.expr(e).alias(s) for s, e in SIGNALS.items()])
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_linenumber").alias("step"), F.expr(KIND).alias("kind"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return G.Inputs(rows, li.select("entity", "step", "kind", "x", *[F.expr(e).cast("double").alias(s) for s, e in CURVES.items()]))


def _program(name):
    return G.recipe(name, first=FIRST if name == "scalar_baseline" else LATE + 1, early=EARLY, late=LATE)


def _long(spark, d, name):
    i = _inputs(spark, d)
    if name in ("literature", "broad_physics"):  # the samples' entities are others than the series', so these show the fallback
        i.samples = i.samples.withColumn("entity", -F.col("entity") - 1)
    return rounded(G.long_features(_program(name), i))


def recipe_scalar_baseline(spark, d):
    return _long(spark, d, "scalar_baseline")


def recipe_minimal_debug(spark, d):
    return _long(spark, d, "minimal_debug")


def recipe_curve_delta(spark, d):
    return _long(spark, d, "curve_delta")


def recipe_literature(spark, d):
    return _long(spark, d, "literature")


def recipe_broad_physics(spark, d):
    return _long(spark, d, "broad_physics")


def program_status_counts(spark, d):
    p = G.Program("p", [
        G.Spec("value_at_step", "temperature", {"steps": [1, 2]}), G.Spec("window_stats", "no_such_signal", {"windows": [[0, 9]]}), G.Spec("step_delta", "discharge_capacity", {"pairs": [[0, 9]], "how": ["log"]}),
        G.Spec("protocol", "", {"columns": ["C1"]}), G.Spec("generic_timeseries_placeholder", ""), G.Spec("value_at_step", "temperature", {"steps": [3]}, enabled=False), G.Spec("no_such_operator", ""),
    ])
    manifest = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"))
    made = G.build_table(p, _inputs(spark, d), manifest)
    rows = [(o["operator"], s, n) for o in made.card["operators"] for s, n in o["statuses"].items()]
    rows += [("featurized", "entities", made.card["entities_featurized"]), ("excluded", "entities", made.card["entities_excluded"]), ("pruned", "features", len(made.pruned)), *(("family", f, n) for f, n in made.card["families"].items())]
    return spark.createDataFrame(rows, "what string, name string, n bigint")


def ordered_picks(spark, d):
    e = daily_rows(spark, d)
    last = S.last_up_to(e, "entity", "step", "value", 12).withColumnRenamed("value", "last_12")
    nth = S.nth_value(e.select("entity", "event_id", "value"), "entity", "event_id", "value", [0, 2, 5000])
    arrays = e.withColumn("a", F.when(F.col("kind") != "view", F.array("value", "value")))
    first = S.first_array(arrays, ["entity"], "a", "event_id").select("entity", F.size("a").alias("n"), F.get("a", F.lit(1)).alias("first"))
    return rounded(last.join(nth, "entity", "full_outer").join(first, "entity", "full_outer"))


def _cycles(spark, d):
    return daily_rows(spark, d).select(F.col("entity").alias("row_id"), F.col("step").alias("cycle_index"), F.col("value").alias("discharge_capacity"))


def _metadata(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("row_id"), (F.col("c_nationkey") / 4).alias("C1"), F.when(F.col("c_nationkey") > 9, F.col("c_nationkey") / 8).alias("cc2"), F.lit(2.5).alias("C4"))


def entity_feature_table(spark, d):
    made, _ = E.all_features(_metadata(spark, d), _cycles(spark, d), upto=29, prune=False)
    return rounded(made)


def entity_difference_arrays(spark, d):
    """Two steps an entity with arrays: those of every fifth one differ in length, so the scalar difference stands in."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    axis = lambda a: F.transform(a, lambda v, i: 2 + i.cast("double") / 50)
    one = e.select(F.col("vec_id").alias("row_id"), F.lit(10).alias("cycle_index"), F.lit(3.0).alias("discharge_capacity"), F.col("a").alias("Qdlin"), axis(F.col("a")).alias("Vdlin"))
    two = e.select((F.col("vec_id") - 1).alias("row_id"), F.lit(100), F.lit(1.0), F.when(F.col("vec_id") % 5 == 0, F.slice("a", 1, 3)).otherwise(F.col("a")), axis(F.col("a")))
    return rounded(E.difference_features(one.union(two)))


QUERIES = {f.__name__: f for f in (recipe_scalar_baseline, recipe_minimal_debug, recipe_curve_delta, recipe_literature, recipe_broad_physics, program_status_counts, ordered_picks, entity_feature_table, entity_difference_arrays)}


def _windows(signal, windows, stats):
    out = []
    for lo, hi in windows:
        f = f"FILTER (WHERE step BETWEEN {lo} AND {hi} AND v IS NOT NULL)"
        n, name = f"count(v) {f}", lambda s: f"{signal}_{s}_{lo}_{hi}"  # noqa: B023, E731
        of = {
            "mean": f"avg(v) {f}", "std": f"stddev_pop(v) {f}", "min": f"min(v) {f}", "max": f"max(v) {f}", "delta": f"CASE WHEN {n} >= 2 THEN arg_max(v, step) {f} - arg_min(v, step) {f} END",
            "slope": f"CASE WHEN {n} >= 2 THEN regr_slope(v, step) {f} END", "intercept": f"CASE WHEN {n} >= 2 THEN regr_intercept(v, step) {f} END", "r2": f"CASE WHEN {n} >= 2 AND var_pop(v) {f} > 0 THEN regr_r2(v, step) {f} END",
        }
        out += [r(of[s], name(s)) for s in stats if s != "curvature"]
    return out


def _series_sql(signal, raw=False):
    """Per-step means, and with ``raw`` those of the samples' entities."""
    own = f"SELECT entity, step, avg({SIGNALS[signal]}) AS v FROM daily GROUP BY entity, step"
    return own + (f" UNION ALL SELECT -entity - 1, step, avg({CURVES[signal]}) FROM li GROUP BY entity, step" if raw and signal in CURVES else "")


def _signal_sql(signal, columns, raw=False):
    return f"SELECT entity, {', '.join(columns)} FROM ({_series_sql(signal, raw)}) GROUP BY entity"


def _unpivot(sqls):
    return " UNION ALL ".join(f"SELECT entity, feature, value FROM (UNPIVOT ({q}) ON COLUMNS(* EXCLUDE (entity)) INTO NAME feature VALUE value)" for q in sqls)


def _curvature(signal, windows, raw=False):
    one = lambda lo, hi: f"""SELECT entity, '{signal}_curvature_{lo}_{hi}' AS feature, round(CAST((sum(t*t) * sum(t*t*e) - sum(t*t*t) * sum(t*e)) / nullif(sum(t*t) * (sum(t*t*t*t) - sum(t*t) * sum(t*t) / count(*)) - sum(t*t*t) * sum(t*t*t), 0) AS DOUBLE), 6) + 0.0 AS value
  FROM (SELECT entity, step - avg(step) OVER (PARTITION BY entity) AS t, v - avg(v) OVER (PARTITION BY entity) AS e FROM ({_series_sql(signal, raw)}) WHERE v IS NOT NULL AND step BETWEEN {lo} AND {hi}) GROUP BY entity HAVING count(*) >= 3"""  # noqa: E731
    return [f"SELECT * FROM ({one(lo, hi)}) WHERE value IS NOT NULL" for lo, hi in windows]


def _scalars_sql(late, raw=False):
    """Every feature of the scalar specifications up to a last step."""
    windows = [(0, 4), (0, 9), (0, 49), (0, late), (10, late)]
    texts = [
        _signal_sql(s, [r(_at(c), f"{s}{a}_step_{c}") for c in G.SCALAR_STEPS for a in ("", "_mean")] + _windows(s, windows, G.WINDOW_STATS) + [r(_delta_sql(a, b, h), f"{s}_{h}_{a}_{b}") for a, b in [(0, 9), (1, late), (9, late)] for h in ("difference", "ratio", "relative", "log")], raw)
        for s in SIGNALS
    ]
    return _unpivot(texts) + " UNION ALL " + " UNION ALL ".join(x for s in SIGNALS for x in _curvature(s, windows, raw))


_POINTS = f"li AS (SELECT l_suppkey AS entity, l_linenumber AS step, trim(lower({KIND})) AS kind, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem)"


def _curve_sql(expr, kind, where, n=1000, per_step=True):
    """Resampled curves by a lookup of each place's neighbours; ranges by step, or what both steps share."""
    rng = "SELECT entity, step, min(x) AS lo, max(x) AS hi FROM pts GROUP BY entity, step HAVING count(*) >= 2" if per_step else "SELECT entity, s.step, max(lo) OVER (PARTITION BY entity) AS lo, min(hi) OVER (PARTITION BY entity) AS hi FROM (SELECT entity, step, min(x) AS lo, max(x) AS hi, count(*) AS k, count(*) OVER (PARTITION BY entity) AS pair FROM pts GROUP BY entity, step) s WHERE pair = 2 AND k >= 2"
    return f"""pts AS (SELECT entity, step, x, avg({expr}) AS y FROM li WHERE kind = '{kind}' AND {where} GROUP BY entity, step, x),
seg AS (SELECT *, lead(x) OVER o AS x2, lead(y) OVER o AS y2, first_value(x) OVER o AS xf, first_value(y) OVER o AS yf FROM pts WINDOW o AS (PARTITION BY entity, step ORDER BY x)),
places AS (SELECT entity, step, lo, hi, (hi - lo) / {n - 1} AS h, unnest(range(0, {n})) AS i FROM ({rng}) WHERE hi > lo),
q AS (SELECT *, CASE WHEN i = {n - 1} THEN hi ELSE lo + i * h END AS q FROM places),
grid AS (SELECT q.entity, q.step, q.i, q.h, CASE WHEN q.q < p.xf THEN p.yf WHEN p.x2 IS NULL THEN p.y ELSE p.y + (p.y2 - p.y) * (q.q - p.x) / (p.x2 - p.x) END AS v
  FROM q ASOF JOIN seg p ON q.entity = p.entity AND q.step = p.step AND q.q >= p.x)"""


def _delta_aggs(transforms, aggs):
    of = {"min": "min($)", "max": "max($)", "mean": "avg($)", "std": "stddev_pop($)", "var": "var_pop($)", "skew": _g1("$"), "sum_abs": "sum(abs($))", "sum_sq": "sum($ * $)", "log_var": "log10(var_pop($) + 1e-30)", "area_abs": "sum((abs($) + abs($_0)) / 2 * h)", "area_signed": "sum(($ + $_0) / 2 * h)"}
    return ", ".join(r(of[a].replace("$", t), f"discharge_capacity_{t}_{a}_{EARLY}_{LATE}") for t in transforms for a in aggs)


_deltas = lambda transforms, aggs: f"""WITH {_POINTS}, {_curve_sql('y', 'discharge', f'step IN ({EARLY}, {LATE})', per_step=False)},
diff AS (SELECT entity, i, max(h) AS h, max(v) FILTER (WHERE step = {LATE}) - max(v) FILTER (WHERE step = {EARLY}) AS d FROM grid GROUP BY entity, i HAVING count(*) = 2),
t AS (SELECT entity, i, h, d AS identity, abs(d) AS abs, log10(abs(d) + 1e-12) AS log_abs FROM diff), l AS (SELECT *, lag(identity) OVER o AS identity_0, lag(abs) OVER o AS abs_0, lag(log_abs) OVER o AS log_abs_0 FROM t WINDOW o AS (PARTITION BY entity ORDER BY i)),
a AS (SELECT entity, {_delta_aggs(transforms, aggs)} FROM l GROUP BY entity) """  # noqa: E731


def _shapes():
    parts = []
    steps = (0, 1, 9, LATE)
    for kind in ("discharge", "charge"):
        for s, e in CURVES.items():
            of = {"min": "min(v)", "max": "max(v)", "mean": "avg(v)", "std": "stddev_pop(v)", "var": "var_pop(v)", "area": "sum((v + v0) / 2 * h)", "gradient": "avg(CASE WHEN v0 IS NULL THEN (v2 - v) / h WHEN v2 IS NULL THEN (v - v0) / h ELSE (v2 - v0) / (2 * h) END)"}
            cols = ", ".join(r(c, a) for a, c in of.items())
            parts.append(f"""SELECT -entity - 1 AS entity, '{s}_{kind}_' || stat || '_at_' || step AS feature, value FROM (UNPIVOT (WITH {_POINTS}, {_curve_sql(e, kind, f'step IN {steps}')},
w AS (SELECT *, lag(v) OVER o AS v0, lead(v) OVER o AS v2 FROM grid WINDOW o AS (PARTITION BY entity, step ORDER BY i)) SELECT entity, step, {cols} FROM w GROUP BY entity, step) ON COLUMNS(* EXCLUDE (entity, step)) INTO NAME stat VALUE value)""")
    return " UNION ALL ".join(parts)


_q = "discharge_capacity"
_early, _late = EARLY, LATE
_curve_stats = lambda hi: _windows(_q, [(0, hi), (max(0, hi - 8), hi)], ["max", "delta", "slope", "intercept"])
_lit_windows = list(dict.fromkeys(_curve_stats(_late)))
_cap = lambda lo: f"FILTER (WHERE step >= {lo})"

ORACLE_SQL = {
    "recipe_scalar_baseline": f"WITH {DAILY} " + _scalars_sql(29),
    "recipe_minimal_debug": f"WITH {DAILY} " + _unpivot([_signal_sql(_q, [r(_at(c), f"{_q}_step_{c}") for c in (0, 1, 9)] + [r(_delta_sql(0, 9, h), f"{_q}_{h}_0_9") for h in ("difference", "log")])]),
    "recipe_curve_delta": _deltas(["identity", "abs", "log_abs"], G.DELTA_AGGS) + "SELECT entity, feature, value FROM (UNPIVOT a ON COLUMNS(* EXCLUDE (entity)) INTO NAME feature VALUE value)",
    "recipe_literature": f"WITH {DAILY}, {_POINTS} " + _unpivot([_signal_sql(_q, [r(_at(c), f"{_q}_step_{c}") for c in dict.fromkeys((1, _early, _late))] + _lit_windows, True)])
    + " UNION ALL SELECT -entity - 1, feature, value FROM (" + _deltas(["identity", "log_abs"], ["min", "mean", "var", "log_var", "skew", "sum_abs", "sum_sq"]) + "SELECT entity, feature, value FROM (UNPIVOT a ON COLUMNS(* EXCLUDE (entity)) INTO NAME feature VALUE value))",
    "recipe_broad_physics": f"WITH {DAILY}, {_POINTS} " + _scalars_sql(LATE, True) + " UNION ALL " + _shapes(),
    "program_status_counts": f"""WITH {DAILY}, e AS (SELECT DISTINCT entity FROM daily), c AS (SELECT count(*) FILTER (WHERE c_custkey IN (SELECT entity FROM e)) AS a, count(*) FILTER (WHERE c_custkey NOT IN (SELECT entity FROM e)) AS b FROM customer)
SELECT * FROM (VALUES ('value_at_step', 'ok', CAST(1 AS BIGINT)), ('value_at_step', 'disabled', 1), ('window_stats', 'failed', 1), ('step_delta', 'ok', 1), ('protocol', 'skipped', 1), ('generic_timeseries_placeholder', 'warning', 1), ('no_such_operator', 'failed', 1), ('pruned', 'features', 0), ('family', 'thermal_summary', 2), ('family', 'capacity_summary_delta', 1)) AS t(what, name, n)
UNION ALL SELECT 'featurized', 'entities', a FROM c UNION ALL SELECT 'excluded', 'entities', b FROM c""",
    "ordered_picks": f"""WITH {DAILY}, s AS (SELECT entity, step, avg(value) AS v FROM daily GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY event_id) - 1 AS i FROM daily)
SELECT entity, {r('l', 'last_12')}, {r('a', 'value_0')}, {r('b', 'value_2')}, {r('c', 'value_5000')}, n, {r('f', 'first')} FROM (SELECT entity, arg_max(v, step) AS l FROM s WHERE step <= 12 GROUP BY entity)
FULL JOIN (SELECT entity, max(value) FILTER (WHERE i = 0) AS a, max(value) FILTER (WHERE i = 2) AS b, max(value) FILTER (WHERE i = 5000) AS c, CASE WHEN count(*) FILTER (WHERE kind <> 'view') > 0 THEN 2 END::INTEGER AS n, arg_min(value, event_id) FILTER (WHERE kind <> 'view') AS f FROM p GROUP BY entity) USING (entity)""",
    "entity_feature_table": f"""WITH {DAILY}, s AS (SELECT entity, step, value AS q FROM daily WHERE step <= 29), m AS (SELECT entity, step, avg(q) AS m FROM s GROUP BY ALL),
b AS (SELECT entity, max(m) FILTER (WHERE step = 2) AS c2, max(m) FILTER (WHERE step = 10) AS c10, coalesce(max(m) FILTER (WHERE step = 29), arg_max(m, step)) AS cn, max(m) FILTER (WHERE step = 1) AS c1, arg_min(m, step) AS cf, arg_max(m, step) AS cl FROM m GROUP BY entity),
a AS (SELECT entity, max(q) AS mx, min(q) AS mn, avg(q) AS av, stddev_pop(q) AS sd, regr_slope(q, step) {_cap(2)} AS es, regr_intercept(q, step) {_cap(2)} AS ei, regr_slope(q, step) {_cap(20)} AS ts, regr_intercept(q, step) {_cap(20)} AS ti,
  count(DISTINCT step) {_cap(2)} AS n2, count(DISTINCT step) {_cap(20)} AS n20 FROM s GROUP BY entity),
c AS (SELECT c_custkey AS row_id, c_nationkey / 4 AS p1, CASE WHEN c_nationkey > 9 THEN c_nationkey / 8 END AS p2, 2.5::DOUBLE AS p4 FROM customer),
j AS (SELECT *, cn - c10 AS d, list_filter([p1, p2, p4], lambda x: x IS NOT NULL) AS l FROM (SELECT a.entity AS row_id, a.* EXCLUDE (entity), b.* EXCLUDE (entity) FROM a JOIN b USING (entity)) FULL JOIN c USING (row_id))
SELECT row_id, {r('c1', 'capacity_cycle_1')}, {r('c2', 'capacity_cycle_2')}, {r('c10', 'capacity_cycle_10')}, {', '.join(r('NULL', f'capacity_cycle_{x}') for x in (50, 95, 98, 100))},
  {r('mx', 'capacity_max_first_n')}, {r('mx - c2', 'capacity_max_minus_cycle_2')}, {r('d', 'capacity_cycle_n_minus_cycle_10')}, {r('CASE WHEN n2 > 1 THEN es END', 'capacity_slope_cycle_2_to_n')}, {r('CASE WHEN n2 > 1 THEN ei END', 'capacity_intercept_cycle_2_to_n')},
  {r('CASE WHEN n20 > 1 THEN ts END', 'capacity_late_slope')}, {r('CASE WHEN n20 > 1 THEN ti END', 'capacity_late_intercept')}, {r('av', 'capacity_mean_first_n')}, {r('sd', 'capacity_std_first_n')}, {r('mn', 'capacity_min_first_n')}, {r('mx', 'capacity_max_stat_first_n')},
  {r('cf', 'capacity_first')}, {r('cl', 'capacity_last')}, {r('cf - cl', 'capacity_first_minus_last')}, {r('(cf - cl) / nullif(cf, 0)', 'capacity_fractional_fade')},
  {r('d', 'approx_qdiff_n_10')}, {', '.join(r('log10(nullif(abs(d), 0))', f'approx_log_{x}') for x in ('abs_qdiff_min', 'abs_qdiff_mean', 'sum_abs_qdiff', 'abs_energy_diff'))}, {r('log10(nullif(d * d, 0))', 'approx_log_sum_sq_qdiff')}, {r('NULL', 'approx_log_abs_qdiff_var')}, {r('NULL', 'approx_log_abs_qdiff_skew')},
  {r('p1', 'protocol_C1')}, {r('p2', 'protocol_C2')}, {r('NULL', 'protocol_C3')}, {r('p4', 'protocol_C4')}, {r('list_avg(l)', 'protocol_current_mean')}, {r('list_max(l)', 'protocol_current_max')}, {r('list_var_pop(l)', 'protocol_current_variance')}, {r('p1 * p2', 'protocol_c1_c2')}, {r('NULL', 'protocol_c2_c3')}, {r('NULL', 'protocol_c3_c4')} FROM j""",
    "entity_difference_arrays": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings),
p AS (SELECT x.vec_id AS row_id, x.a AS q1, y.a AS q2, y.vec_id % 5 <> 0 AND y.vec_id IS NOT NULL AS whole, y.vec_id IS NOT NULL AS two FROM v x LEFT JOIN v y ON y.vec_id = x.vec_id + 1),
e AS (SELECT row_id, q2[i] - q1[i] AS d, i, q1[i] AS a, q2[i] AS b, lag(q1[i]) OVER o AS a0, lag(q2[i]) OVER o AS b0 FROM (SELECT *, unnest(range(1, len(q1) + 1)) AS i FROM p WHERE whole) WINDOW o AS (PARTITION BY row_id ORDER BY i)),
w AS (SELECT row_id, avg(d) AS m, min(d) AS lo, var_pop(d) AS va, {_g1('d')} AS sk, sum(abs(d)) AS sa, sum(d * d) AS sq, sum((a + a0) / 2 / 50) - sum((b + b0) / 2 / 50) AS en FROM e GROUP BY row_id),
s AS (SELECT row_id, CASE WHEN two THEN -2.0 ELSE 0.0 END AS d FROM p WHERE NOT whole UNION ALL SELECT -1, NULL WHERE false)
SELECT row_id, {r('m', 'qdiff_n_10')}, {r('log10(nullif(abs(lo), 0))', 'log_abs_qdiff_min')}, {r('log10(nullif(abs(m), 0))', 'log_abs_qdiff_mean')}, {r('log10(nullif(abs(va), 0))', 'log_abs_qdiff_var')}, {r('log10(nullif(abs(sk), 0))', 'log_abs_qdiff_skew')}, {r('log10(nullif(sa, 0))', 'log_sum_abs_qdiff')}, {r('log10(nullif(sq, 0))', 'log_sum_sq_qdiff')}, {r('log10(nullif(abs(en), 0))', 'log_abs_energy_diff')},
  {r('d', 'approx_qdiff_n_10')}, {', '.join(r('log10(nullif(abs(d), 0))', f'approx_log_{x}') for x in ('abs_qdiff_min', 'abs_qdiff_mean', 'sum_abs_qdiff', 'abs_energy_diff'))}, {r('log10(nullif(d * d, 0))', 'approx_log_sum_sq_qdiff')}, {r('NULL', 'approx_log_abs_qdiff_var')}, {r('NULL', 'approx_log_abs_qdiff_skew')} FROM w FULL JOIN s USING (row_id)""",
}
