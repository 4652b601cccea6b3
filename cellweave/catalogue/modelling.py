"""Metric, campaign and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import campaign as K
from ..operators import metrics as M
from ..operators import model as D
from .tables import r, rounded, table

PRED = "o_totalprice / 1000 * 0.9 + (o_custkey % 7) * 3"


def _scored(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_custkey", (F.col("o_totalprice") / 1000).alias("y"), F.expr(PRED).alias("y_pred"))


def regression_metrics(spark, d):
    return rounded(M.regression_metrics(_scored(spark, d)))


def metrics_by_group(spark, d):
    return rounded(_scored(spark, d).groupBy("o_orderpriority").agg(*M.error_metrics()))


def protocol_metrics(spark, d):
    means = _scored(spark, d).groupBy("o_custkey").agg(F.avg("y").alias("y"), F.avg("y_pred").alias("y_pred"))
    return rounded(means.agg(*M.error_metrics()))


def weak_baseline_gain(spark, d):
    rows = _scored(spark, d)
    train = rows.where("o_orderstatus = 'F'").agg(F.avg("y").alias("m"))
    both = rows.where("o_orderstatus <> 'F'").crossJoin(F.broadcast(train))
    out = both.agg(F.sqrt(F.avg((F.col("m") - F.col("y")) ** 2)).alias("weak"), F.sqrt(F.avg((F.col("y_pred") - F.col("y")) ** 2)).alias("candidate"))
    return rounded(out.withColumn("gain", M.gain_recovered(F.col("weak"), F.col("candidate"), F.lit(10.0))).withColumn("none", M.gain_recovered(F.lit(1.0), F.col("candidate"), F.lit(1.0))))


def prediction_diagnostics(spark, d):
    return rounded(_scored(spark, d).agg(*M.diagnostics()))


def rank_protocols(spark, d):
    c = table(spark, d, "orders").select((F.col("o_custkey") % 11 / 4).alias("C1"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 5 / 8).alias("C2"), (F.col("o_totalprice") / 777).alias("life"), F.col("o_orderstatus").alias("status"))
    early = c.where("status <> 'F'").withColumn("prediction", F.col("life") * 1.1)
    post = c.where("C1 > 1").withColumn("posterior", F.col("life") / 3)
    return rounded(M.protocol_ranking(c, early, post, ["C1", "C2"]).withColumn("early_rank", F.coalesce("early_rank", F.lit(0))), 5)


def _runs(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_returnflag", "l_linestatus", "l_linenumber", F.col("l_suppkey").alias("run"), (F.col("l_partkey") % 3).alias("seed"), (F.col("l_extendedprice") / 777).alias("rmse"), (F.col("l_discount") - 0.05).alias("bias"))


def campaign_config_aggregate(spark, d):
    agg = K.config_aggregate(_runs(spark, d), ["l_returnflag", "l_linestatus", "l_linenumber"], "rmse", "run", "seed", ["bias"])
    return rounded(K.selection(agg, "mean_bias"), 5)


def topk_shortlist(spark, d):
    agg = K.config_aggregate(_runs(spark, d), ["l_returnflag", "l_linestatus", "l_linenumber"], "rmse", "run", "seed", ["bias"])
    return rounded(K.shortlist(K.selection(agg, "mean_bias"), 5, "l_returnflag", "l_linestatus", "l_linenumber").select("l_returnflag", "l_linestatus", "l_linenumber", "score"), 5)


def leaderboard_best_by(spark, d):
    rows = _runs(spark, d).withColumn("success", F.col("seed") > 0)
    return rounded(K.leaderboard_best(rows.select("l_returnflag", "l_linestatus", "l_linenumber", "run", "rmse", "success"), "l_linenumber", "rmse", "run", "l_returnflag", "l_linestatus"), 5)


def failure_summary(spark, d):
    return K.failure_summary(table(spark, d, "orders").withColumn("why", F.when(F.col("o_custkey") % 4 != 0, (F.col("o_custkey") % 4).cast("string"))), "o_orderstatus", "why")


def resource_bump(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") * 8).alias("mem"), (F.col("p_size") * 20000).alias("sec")).select("p_partkey", *K.bumped("mem", "sec"))


def policy_space(spark, d):
    return D.policy_space(spark)


def posterior_ranking(spark, d):
    arms = D.policy_space(spark)
    first = arms.orderBy("C1", "C2", "C3").select("C1", "C2", "C3", (F.lit(700.0) + 40 * F.col("C1") - 10 * F.col("C3")).alias("prediction"))
    return rounded(D.closed_loop(spark, arms, [first, first.withColumn("prediction", F.col("prediction") + 30)]), 4)


QUERIES = {f.__name__: f for f in (
    regression_metrics, metrics_by_group, protocol_metrics, weak_baseline_gain, prediction_diagnostics, rank_protocols, campaign_config_aggregate, topk_shortlist, leaderboard_best_by, failure_summary, resource_bump,
    policy_space, posterior_ranking,
)}

_SCORED = f"scored AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, o_custkey, o_totalprice / 1000 AS y, {PRED} AS p FROM orders)"
_ERR = ", ".join(["count(*) AS n", r("sqrt(avg((p - y) * (p - y)))", "rmse"), r("avg(abs(p - y))", "mae"), r("CASE WHEN count(*) > 1 AND var_pop(y) > 0 THEN 1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)) END", "r2"),
                  r("avg(abs(p - y) / y) FILTER (WHERE y > 0)", "mape"), r("100 * avg(abs(p - y) / y) FILTER (WHERE y > 0)", "error_pct"), r("CASE WHEN var_pop(y) > 0 AND var_pop(p) > 0 THEN corr(y, p) END", "pearson")])
_RUNS = "runs AS (SELECT l_returnflag, l_linestatus, l_linenumber, l_suppkey AS run, l_partkey % 3 AS seed, l_extendedprice / 777 AS rmse, l_discount - 0.05 AS bias FROM lineitem)"
_AGG = _RUNS + """, agg AS (SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n_evals, count(DISTINCT run) AS n_runs, count(DISTINCT seed) AS n_seeds, array_to_string(list_sort(list(DISTINCT CAST(run AS VARCHAR))), ';') AS runs, array_to_string(list_sort(list(DISTINCT seed)), ';') AS seeds,
  avg(rmse) AS mean, coalesce(stddev_samp(rmse), 0) AS std, min(rmse) AS min, max(rmse) AS max, avg(bias) AS mean_bias FROM runs GROUP BY ALL), sel AS (SELECT *, mean + 0.25 * std + 0.1 * abs(mean_bias) AS score FROM agg WHERE n_evals >= 2)"""
_r5 = lambda e, n: f"round({e}, 5) + 0.0 AS {n}"
_KEY = "CAST(round_even(C1, 3) AS VARCHAR) || '|' || coalesce(CAST(round_even(C2, 3) AS VARCHAR), 'nan')"

ORACLE_SQL = {
    "regression_metrics": f"""WITH {_SCORED}, k AS (SELECT *, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ra, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rb FROM scored),
q AS (SELECT sum(sign(a.y - b.y) * sign(a.p - b.p)) AS s, sum(abs(sign(a.y - b.y))) AS ny, sum(abs(sign(a.p - b.p))) AS np FROM scored a JOIN scored b ON a.o_orderkey < b.o_orderkey)
SELECT {_ERR}, (SELECT {r('corr(ra, rb)', 'x').rsplit(' AS ', 1)[0]} FROM k) AS spearman, (SELECT {r('s / sqrt(ny * np)', 'x').rsplit(' AS ', 1)[0]} FROM q) AS kendall FROM scored""",
    "metrics_by_group": f"WITH {_SCORED} SELECT o_orderpriority, {_ERR} FROM scored GROUP BY o_orderpriority",
    "protocol_metrics": f"WITH {_SCORED}, m AS (SELECT o_custkey, avg(y) AS y, avg(p) AS p FROM scored GROUP BY o_custkey) SELECT {_ERR} FROM m",
    "weak_baseline_gain": f"WITH {_SCORED}, t AS (SELECT avg(y) AS m FROM scored WHERE o_orderstatus = 'F'), e AS (SELECT sqrt(avg((m - y) ** 2)) AS weak, sqrt(avg((p - y) ** 2)) AS candidate FROM scored, t WHERE o_orderstatus <> 'F') SELECT {r('weak', 'weak')}, {r('candidate', 'candidate')}, {r('(weak - candidate) / nullif(weak - 10, 0)', 'gain')}, NULL::DOUBLE AS none FROM e",
    "prediction_diagnostics": f"WITH {_SCORED} SELECT " + ", ".join(r(e, n) for e, n in (("avg(y)", "y_mean"), ("min(y)", "y_min"), ("max(y)", "y_max"), ("avg(p)", "pred_mean"), ("min(p)", "pred_min"), ("max(p)", "pred_max"), ("avg(p - y)", "residual_mean"), ("stddev_pop(p - y)", "residual_std"))) + ", count(*) FILTER (WHERE p < 0) AS n_negative, count(*) - count(p) AS n_missing FROM scored",
    "rank_protocols": f"""WITH c AS (SELECT CAST(o_custkey % 11 AS DOUBLE) / 4 AS C1, CASE WHEN o_custkey % 3 <> 0 THEN CAST(o_custkey % 5 AS DOUBLE) / 8 END AS C2, o_totalprice / 777 AS life, o_orderstatus AS status FROM orders), k AS (SELECT *, {_KEY} AS key FROM c),
o AS (SELECT key, count(life) AS n, avg(life) AS mean, median(life) AS median FROM k GROUP BY key), e AS (SELECT key, avg(life * 1.1) AS early FROM k WHERE status <> 'F' GROUP BY key), p AS (SELECT key, max(life / 3) AS posterior FROM k WHERE C1 > 1 GROUP BY key),
b AS (SELECT *, row_number() OVER (ORDER BY mean DESC, key) AS observed_rank, CASE WHEN early IS NOT NULL THEN row_number() OVER (ORDER BY early DESC NULLS LAST, key) END AS early_rank FROM o LEFT JOIN e USING (key) LEFT JOIN p USING (key))
SELECT key, n, {_r5('mean', 'mean')}, {_r5('median', 'median')}, {_r5('early', 'early')}, {_r5('posterior', 'posterior')}, CAST(observed_rank AS INTEGER) AS observed_rank, CAST(coalesce(early_rank, 0) AS INTEGER) AS early_rank, {_r5('early - mean', 'residual')} FROM b""",
    "campaign_config_aggregate": f"WITH {_AGG} SELECT l_returnflag, l_linestatus, l_linenumber, n_evals, n_runs, n_seeds, runs, seeds, {', '.join(_r5(c, c) for c in ('mean', 'std', 'min', 'max', 'mean_bias', 'score'))} FROM sel",
    "topk_shortlist": f"WITH {_AGG} SELECT l_returnflag, l_linestatus, l_linenumber, {_r5('score', 'score')} FROM sel ORDER BY sel.score, mean, std, l_returnflag, l_linestatus, l_linenumber LIMIT 5",
    "leaderboard_best_by": f"WITH {_RUNS} SELECT l_returnflag, l_linestatus, l_linenumber, run, {_r5('rmse', 'rmse')}, true AS success FROM runs WHERE seed > 0 QUALIFY row_number() OVER (PARTITION BY l_linenumber ORDER BY runs.rmse, run, l_returnflag, l_linestatus) = 1",
    "failure_summary": "SELECT o_orderstatus, CASE WHEN o_custkey % 4 <> 0 THEN CAST(o_custkey % 4 AS VARCHAR) END AS why, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY n DESC, 1 NULLS FIRST, 2 NULLS FIRST LIMIT 10",
    "resource_bump": "SELECT p_partkey, least(p_size * 16, 256) AS mem, least(p_size * 40000, 604740) AS sec FROM part",
    "policy_space": "WITH a AS (SELECT unnest([" + ", ".join(map(str, D.C1)) + "])::DOUBLE AS C1), b AS (SELECT unnest([" + ", ".join(map(str, D.C2)) + "])::DOUBLE AS C2), c AS (SELECT unnest([" + ", ".join(map(str, D.C3)) + """])::DOUBLE AS C3),
g AS (SELECT C1, C2, C3, 0.2::DOUBLE / (1::DOUBLE / 6 - 0.2::DOUBLE / C1 - 0.2::DOUBLE / C2 - 0.2::DOUBLE / C3) AS C4 FROM a, b, c)
SELECT C1, C2, C3, round_even(C4, 3) AS C4 FROM g WHERE C4 BETWEEN 0.1 AND 4.81 AND NOT (C1 = 4.8 AND C2 = 4.8 AND C3 = 4.8)""",
}
