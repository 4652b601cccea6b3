"""Ragged records, further splits, replay helpers, evaluation checks and campaign bookkeeping on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import campaign as K
from ..operators import evaluation as V
from ..operators import relational as R
from ..operators import replay as P
from ..operators import splits as T
from ..plans import candidates as C
from ..sources import records as L
from .modelling import PRED
from .tables import r, rounded, table


def _orders_by_customer(spark, d):
    """A document a customer: one record an order, keyed by its place as text, with arrays of unequal length."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 1000).alias("p"))
    rec = F.struct(
        F.transform(F.sequence(F.lit(0), F.pmod("o_orderkey", F.lit(4)).cast("int")), lambda i: F.col("p") + i).alias("Qd"),
        F.transform(F.sequence(F.lit(0), F.pmod("o_orderkey", F.lit(3)).cast("int")), lambda i: F.when(i == 1, -F.col("p")).otherwise(F.col("p"))).alias("I"), F.array(F.lit(25)).alias("T"),
    )
    whole = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", rec.alias("r")))).alias("l"))
    return whole.select(F.col("o_custkey").alias("entity"), F.try_parse_json(F.to_json(F.transform("l", lambda x: x["r"]))).alias("doc"))


def ragged_records(spark, d):
    rows = L.padded_samples(L.step_records(_orders_by_customer(spark, d), ["entity"], "doc"), ["entity"], 5)
    return rounded(rows.groupBy("entity", "cycle_index", "step_type").agg(F.count("*").alias("n"), F.sum("discharge_capacity").alias("q"), F.sum("current").alias("i"), F.sum("temperature").alias("t")))


def ragged_leaves(spark, d):
    """A list an order: numbers, truth values, nulls and texts, and for all but the finished ones lists and objects in it."""
    inner = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.concat(F.lit(',[['), F.col("o_custkey") + 1, F.lit(',{"k":7}],null,[[-0.5]],"'), F.col("o_orderpriority"), F.lit('"]')))
    doc = F.concat(F.lit("["), F.col("o_custkey"), F.lit(","), (F.col("o_totalprice") > 150000).cast("string"), F.lit(',null," '), F.col("o_orderkey"), F.lit(' "'), inner, F.lit("]"))
    v = F.parse_json(doc)
    made = table(spark, d, "orders").select("o_orderkey", L.numeric_leaves(v).alias("n"), L.string_leaves(v).alias("t"))
    number = F.transform("n", lambda x: F.coalesce((x * 2).cast("long").cast("string"), F.lit("-")))
    return made.select("o_orderkey", F.array_join(number, "|").alias("doubled"), F.array_join("t", "|").alias("texts"))


def ragged_summary(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", (F.col("o_totalprice") / 1000).alias("p")))).alias("l"))
    doc = F.struct(F.transform("l", lambda x: -x["o_orderkey"]).alias("cycle"), F.transform("l", lambda x: x["p"]).alias("QDischarge"), F.slice(F.transform("l", lambda x: x["p"] * 2), F.lit(1), F.greatest(F.size("l") - 1, F.lit(1))).alias("QCharge"), F.array().cast("array<double>").alias("IR"))
    return rounded(L.summary_rows(o.select(F.col("o_custkey").alias("entity"), F.try_parse_json(F.to_json(doc)).alias("doc")), ["entity"], "doc", 3).select("entity", "cycle_index", "discharge_capacity", "charge_capacity", F.col("internal_resistance").isNull().alias("no_ir")))


def struct_of_lists(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("l"))
    held = li.select("l_orderkey", F.transform("l", lambda x: x["l_linenumber"]).alias("a"), F.transform("l", lambda x: x["l_quantity"]).alias("b"), F.array(F.lit(9)).alias("c"))
    return rounded(L.struct_rows(held, ["l_orderkey"], ["a", "b", "c"]))


def batch_labels(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("/raw/"), F.col("o_orderdate").cast("date").cast("string"), F.lit("_batchdata_v7.mat")).alias("p"))
    return o.select("o_orderkey", L.source_batch("p").alias("batch"), L.batch_date(L.source_batch("p")).alias("day"), L.batch_date("p").alias("none"))


def merged_batches(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    b = table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("k"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    return L.merged_batches([a, b], "k")


def resolved_sources(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_nationkey") < 8, F.concat(F.lit("/old/store/raw/data/"), "s_name", F.lit(".json"))).when(F.col("s_nationkey") < 16, F.concat(F.lit("rel/"), "s_name")).alias("source"), F.lit("b1").alias("batch"), F.concat(F.lit("CH"), F.col("s_suppkey").cast("string")).alias("cell"))
    files = table(spark, d, "supplier").select(F.when(F.col("s_nationkey") < 4, F.concat(F.lit("/raw/data/"), "s_name", F.lit(".json"))).when(F.col("s_nationkey") < 12, F.concat(F.lit("/raw/rel/"), "s_name")).otherwise(F.concat(F.lit("/raw/data/b1/b1_CH"), F.col("s_suppkey").cast("string"), F.lit(".json"))).alias("path"))
    return R.resolved_sources(s, "s_suppkey", ["source"], "/raw", "/store/raw", "batch", ["cell"], files)


def search_split_modes(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_mktsegment").alias("batch_id"), F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("protocol_readable"))
    out = None
    for mode, held in (("batch", None), ("leave_one_batch_out", "BUILDING"), ("protocol", None)):
        one = T.search_split(c, c, mode, 0.25, 3, held)[0].groupBy("group_key", "split", "split_mode").agg(F.count("*").alias("n")).withColumn("asked", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


def split_three_parts(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"))
    return T.three_parts(c, "row_id", 4).join(T.halves(c, "row_id", 0.25, 5).withColumnRenamed("split", "half"), "row_id")


def replay_in_cycles(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 20).alias("raw"), (F.col("p_size") / 500).alias("se"), F.when(F.col("p_size") < 25, "direct").otherwise("inverse").alias("t"), F.concat(F.lit("oed"), F.pmod("p_size", F.lit(5)).cast("string")).alias("batch"))
    return rounded(p.select("p_partkey", *P.in_cycles("raw", "se", "t"), P.cutoff("batch").alias("cutoff"), P.model_file("batch").alias("model")))


def protocols_in_names(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") < 10, "C:\\x\\bad.sdu").otherwise(F.concat(F.lit("/a/2018-"), F.col("p_size").cast("string"), F.lit("pt5_4pt8_"), F.when(F.col("p_size") > 40, "x").otherwise("5pt2"), F.lit("_4pt16_extra.sdu"))).alias("path"))
    return p.select("p_partkey", P.protocol_of_path("path").alias("protocol"), *P.currents_of(P.protocol_of_path("path")))


def _replayed(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", *[(F.col("o_custkey") % k / 2).alias(c) for c, k in (("C1", 7), ("C2", 5), ("C3", 3))], F.when(F.col("o_orderstatus") != "P", 1.0).alias("C4"),
        (F.col("o_totalprice") / 100 - 150).alias("prediction"), (F.col("o_totalprice") > 350000).alias("anomaly"), F.log10(F.col("o_totalprice") / 100).alias("raw"), (F.col("o_totalprice") / 100).alias("ci_width"), F.lit(1.0).alias("ci_lo"),
        F.lit(None).cast("double").alias("ci_hi"), F.when(F.col("o_orderstatus") == "F", "unavailable").alias("status"))


def acquisition_reasons(spark, d):
    return P.acquisition_input(_replayed(spark, d))[2]


def scale_diagnostics(spark, d):
    return rounded(P.scale_diagnostics(_replayed(spark, d)), 4)


def replay_summary(spark, d):
    return P.prediction_summary(_replayed(spark, d))


def prediction_problems(spark, d):
    want = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"))
    got = table(spark, d, "orders").select(F.col("o_custkey").alias("row_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("y_pred"))
    return V.prediction_problems(want, got).groupBy("what").agg(F.count("*").alias("n"))


def sanitised_tables(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_name").alias("cell_id"), F.col("c_mktsegment").alias("batch_id"), F.lit(3.6).alias("C1"), "c_acctbal", F.col("c_nationkey").alias("cycle_life"))
    s = c.select("row_id", F.lit(1).alias("cycle_index"), F.col("c_acctbal").alias("discharge_capacity"), F.lit("x").alias("note"), F.lit(1.5).alias("y"), F.lit(2.5).alias("more"))
    names = V.aliases(c)
    return V.sanitised_metadata(c, names).join(V.sanitised_steps(s, names).drop("cell_id"), "row_id")


def train_validation_ids(spark, d):
    return V.train_and_validation(table(spark, d, "customer").select(F.col("c_custkey").alias("row_id")))


def weak_baseline_by_status(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", (F.col("o_totalprice") / 1000).alias("y"))
    return rounded(V.weak_baseline(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'")))


def predictions_with_metadata(spark, d):
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.expr(PRED).alias("y_pred"), F.col("o_orderstatus").alias("status"))
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_linestatus").alias("status"), "l_suppkey", "l_linenumber")
    return rounded(V.with_metadata(p, m, F.struct("l_linenumber", "l_suppkey", "status")))


def standard_names(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.upper(F.substring("c_mktsegment", 1, 1)), F.lit(" only")).alias("x"), "c_mktsegment")
    words = F.when(F.col("c_mktsegment") == "BUILDING", " Scalar-Features ").when(F.col("c_mktsegment") == "MACHINERY", "curves").when(F.col("c_mktsegment") == "HOUSEHOLD", "PHYSICS aware").otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", C.named(words, C.FEATURE_SETS, "all_available").alias("feature_set"))


def _jobs(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("FAILED").alias("was"), F.when(F.col("o_orderpriority") == "1-URGENT", "OOM").when(F.col("o_orderpriority") == "2-HIGH", "TIMEOUT").when(F.col("o_orderpriority") == "3-MEDIUM", "BUG").otherwise("NODE_FAIL").alias("class"),
        F.pmod("o_custkey", F.lit(4)).cast("int").alias("resubmits"), F.lit(3).alias("max_resubmits"), (F.pmod("o_custkey", F.lit(5)) * 40 + 8).cast("int").alias("mem_gb"), F.when(F.pmod("o_custkey", F.lit(3)) == 0, "8h").otherwise("110:30:05").alias("time"), "o_orderstatus")


def job_states_and_actions(spark, d):
    j = _jobs(spark, d)
    queue = j.where("o_orderstatus = 'P'").select("job_id", F.lit("RUNNING").alias("state"))
    books = j.select("job_id", F.col("was").alias("state")).unionByName(j.select(F.concat("job_id", F.lit(".batch")).alias("job_id"), F.lit("CANCELLED").alias("state")))
    states = K.job_states(j.drop("was", "o_orderstatus"), queue, books)
    acted = K.job_actions(states.where("over"))
    return acted.select("job_id", "state", "action", "mem_gb", "time", "resubmits", "needs_human")


def candidate_tags(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.when(F.col("p_size") < 10, " Ridge(alpha) slope").when(F.col("p_size") < 20, " RandomForestRegressor log diff").otherwise(" nothing")).alias("code"))
    return p.select("p_partkey", K.model_class("code").alias("model"), F.array_join(K.feature_tags("code"), "; ").alias("tags"))


def review_statuses(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") < 10, "PASS").when(F.col("p_size") < 30, "needs_attention").when(F.col("p_size") < 40, "fail").alias("verdict"), F.slice(F.array(F.lit("a")), F.lit(1), F.pmod("p_partkey", F.lit(2)).cast("int")).alias("issues"), (F.col("p_size") > 15).alias("success"))
    return p.select("p_partkey", K.review_status("verdict", "issues", "success").alias("status"))


def recipe_from_paths(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") < 5, "given").alias("recipe"), F.when(F.col("p_size") < 20, "/x/oed_broad_physics_idx3_50/feature_table.csv").when(F.col("p_size") < 35, "/runs/trackA_my_mix_batch_7/out").otherwise("/none").alias("path"))
    return p.select("p_partkey", K.run_recipe("recipe", "path").alias("recipe"), *[c.alias(f"table_{n}") for c, n in zip(K.recipe_settings("path"), ("recipe", "early", "late", "first"))])


def _results(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.concat_ws("-", F.lit("c"), F.col("l_partkey").cast("string")).alias("candidate_id"), F.col("l_suppkey").cast("string").alias("run_id"), "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 777).alias("rmse"), (F.col("l_returnflag") != "N").alias("success"), F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("config"))


def deduplicated_configs(spark, d):
    rows, counts = K.deduplicated(_results(spark, d), "config", "rmse", "l_orderkey", "l_linenumber")
    both = rows.select("config", "candidate_id", "rmse").unionByName(counts.select(F.lit("counts").alias("config"), F.concat_ws("/", "n_successful", "n_unique", "n_pruned").alias("candidate_id"), F.lit(0.0).alias("rmse")))
    return rounded(both.unionByName(K.best_successful(_results(spark, d), "rmse", "l_orderkey", "l_linenumber").select(F.lit("best").alias("config"), "candidate_id", "rmse")), 5)


def shortlist_with_secondary(spark, d):
    rows = _results(spark, d).select(F.concat_ws("/", "candidate_id", "l_orderkey", "l_linenumber").alias("candidate_id"), "run_id", F.when(F.col("l_linenumber") != 2, F.col("l_linenumber").cast("string")).alias("split_seed"), (F.round("rmse", 4)).cast("string").alias("surrogate_rmse"),
        F.lit("1.5").alias("surrogate_mae"), F.when(F.col("l_linenumber") == 3, "none").otherwise("0.5").alias("surrogate_mape"), F.lit(0.1).alias("surrogate_spearman"))
    board = rows.select("candidate_id", F.col("surrogate_rmse").cast("double").alias("secondary_rmse"), F.lit(1).alias("seq")).unionByName(rows.select("candidate_id", F.lit(5.0).alias("secondary_rmse"), F.lit(0).alias("seq")))
    short = K.with_secondary(K.shortlist_entries(rows, 6), board, "seq")
    titles = K.champions(short, "secondary_rmse").select("candidate_id", "title")
    return rounded(short.select("candidate_id", "run_id", "rank_in_shortlist", "secondary_rmse").join(titles, "candidate_id", "left"), 4)


def campaign_examples(spark, d):
    rows = _results(spark, d)
    agg = K.config_aggregate(rows, ["config"], "rmse", "run_id", "l_linenumber", [], ["candidate_id", "run_id"], ["l_orderkey", "l_linenumber", "candidate_id", "run_id"]).withColumn("score", F.col("mean"))
    made = K.example_rows(agg, rows)
    return rounded(made.select("config", "candidate_id", "run_id", F.col("example.config").isNotNull().alias("found"), "seeds", "mean"), 5)


def full_campaigns(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 3 + 6).cast("int").alias("iterations"), F.lit(20).alias("candidates_per_iteration"), F.when(F.col("c_mktsegment") == "BUILDING", "not_run").when(F.col("c_mktsegment") == "MACHINERY", "done").alias("locked_batch9_status"))
    return R.within(c, K.full_runs(c), "c_custkey").select("c_custkey")


QUERIES = {f.__name__: f for f in (
    ragged_records, ragged_leaves, ragged_summary, struct_of_lists, batch_labels, merged_batches, resolved_sources, search_split_modes, split_three_parts, replay_in_cycles, protocols_in_names, acquisition_reasons, scale_diagnostics, replay_summary,
    prediction_problems, sanitised_tables, train_validation_ids, weak_baseline_by_status, predictions_with_metadata, standard_names, job_states_and_actions, candidate_tags, review_statuses, recipe_from_paths, deduplicated_configs,
    shortlist_with_secondary, campaign_examples, full_campaigns,
)}

_seeded = lambda g, seed: f"row_number() OVER (ORDER BY md5(CAST({g} AS VARCHAR) || '|{seed}'), {g})"


def _mode(group, seed, mode, asked):
    return f"""SELECT g AS group_key, CASE WHEN i <= greatest(1, least(k - 1, round_even(k * 0.25, 0))) THEN 'validation' ELSE 'train' END AS split, '{mode}' AS split_mode, n, '{asked}' AS asked
FROM (SELECT g, n, {_seeded('g', seed)} AS i, count(*) OVER () AS k FROM (SELECT {group} AS g, count(*) AS n FROM customer GROUP BY 1))"""


_REPLAYED = """r AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN 1.0 END AS C4, o_totalprice / 100 - 150 AS prediction, o_totalprice > 350000 AS anomaly, log10(o_totalprice / 100) AS raw, o_totalprice / 100 AS w, o_orderstatus FROM orders)"""
_spread = lambda e, n: ", ".join(f"round(CAST({f}({e}) AS DOUBLE), 4) + 0.0 AS {n}_{x}" for f, x in (("min", "min"), ("median", "median"), ("max", "max")))
_RESULTS = "res AS (SELECT 'c-' || l_partkey AS candidate_id, CAST(l_suppkey AS VARCHAR) AS run_id, l_orderkey, l_linenumber, l_extendedprice / 777 AS rmse, l_returnflag <> 'N' AS success, l_returnflag || l_linestatus || l_linenumber AS config FROM lineitem)"
_DOUBLE = "CASE WHEN o_custkey % 3 = 0 THEN '12:00:00' ELSE '167:59:00' END"

ORACLE_SQL = {
    "ragged_records": f"""WITH o AS (SELECT o_custkey AS entity, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place, o_orderkey % 4 + 1 AS nq, o_orderkey % 3 + 1 AS ni, o_totalprice / 1000 AS p FROM orders),
e AS (SELECT *, unnest(range(0, greatest(nq, ni))) AS i FROM o WHERE place < 5),
v AS (SELECT *, CASE WHEN nq = 1 THEN p WHEN i < nq THEN p + i END AS q, CASE WHEN ni = 1 THEN p WHEN i < ni THEN CASE WHEN i = 1 THEN -p ELSE p END END AS c FROM e)
SELECT entity, CAST(place AS DOUBLE) AS cycle_index, CASE WHEN c < 0 THEN 'discharge' WHEN c > 0 THEN 'charge' ELSE '' END AS step_type, count(*) AS n, {r('sum(q)', 'q')}, {r('sum(c)', 'i')}, {r('sum(25)', 't')} FROM v GROUP BY ALL""",
    "ragged_leaves": """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN concat_ws('|', 2 * o_custkey, '-', '-', 2 * o_orderkey) ELSE concat_ws('|', 2 * o_custkey, CASE WHEN o_totalprice > 150000 THEN 2 ELSE 0 END, 2 * (o_custkey + 1), -1) END AS doubled,
  concat_ws('|', o_custkey, CASE WHEN o_totalprice > 150000 THEN 'true' ELSE 'false' END, o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN (o_custkey + 1) || '|-0.5|' || lower(o_orderpriority) END) AS texts FROM orders""",
    "ragged_summary": f"""WITH o AS (SELECT o_custkey AS entity, o_orderkey, o_totalprice / 1000 AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY -o_orderkey) AS j FROM o WHERE i <= greatest(n - 1, 1))
SELECT entity, {r('-o_orderkey', 'cycle_index')}, {r('p', 'discharge_capacity')}, {r('p * 2', 'charge_capacity')}, true AS no_ir FROM k WHERE j <= 3""",
    "struct_of_lists": f"SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS INTEGER) AS place, l_linenumber AS a, {r('l_quantity', 'b')}, 9 AS c FROM lineitem",
    "batch_labels": "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS batch, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, NULL::VARCHAR AS none FROM orders",
    "merged_batches": "SELECT s_suppkey AS k, s_name AS name, NULL::BIGINT AS nation FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey * 2 FROM customer) UNION ALL SELECT c_custkey * 2, c_name, c_nationkey FROM customer",
    "resolved_sources": """WITH s AS (SELECT *, CASE WHEN s_nationkey < 8 THEN '/old/store/raw/data/' || s_name || '.json' WHEN s_nationkey < 16 THEN 'rel/' || s_name END AS src, '/raw/data/b1/' AS b, 'CH' || s_suppkey AS c FROM supplier),
w AS (SELECT *, CASE WHEN s_nationkey < 4 OR s_nationkey BETWEEN 8 AND 11 THEN 'rebased' WHEN s_nationkey >= 12 THEN 'reconstructed' ELSE 'unresolved' END AS how FROM s),
t AS (SELECT *, CASE WHEN s_nationkey < 8 THEN src || ';/raw/data/' || s_name || '.json' WHEN s_nationkey < 16 THEN src || ';/raw/' || src ELSE '' END AS head, b || c || '.json;' || b || c || '_structure.json;' || b || 'b1_' || c || '.json' AS tail FROM w)
SELECT s_suppkey, CASE how WHEN 'rebased' THEN CASE WHEN s_nationkey < 4 THEN '/raw/data/' || s_name || '.json' ELSE '/raw/rel/' || s_name END WHEN 'reconstructed' THEN b || 'b1_' || c || '.json' END AS path, how, CASE WHEN src IS NOT NULL THEN 'source' END AS source_column, src AS source_path,
  CASE how WHEN 'rebased' THEN head ELSE CASE WHEN head = '' THEN tail ELSE head || ';' || tail END || CASE WHEN how = 'unresolved' THEN ';' || b || 'b1_' || c || '_structure.json' ELSE '' END END AS attempted FROM t""",
    "search_split_modes": _mode("c_mktsegment", 3, "batch", "batch") + " UNION ALL " + _mode("'p' || c_nationkey", 3, "protocol", "protocol")
    + " UNION ALL SELECT c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN 'validation' ELSE 'train' END, 'batch', count(*), 'leave_one_batch_out' FROM customer GROUP BY 1",
    "split_three_parts": f"""WITH c AS (SELECT c_custkey AS row_id, {_seeded('c_custkey', 4)} AS i, {_seeded('c_custkey', 5)} AS j, count(*) OVER () AS n FROM customer)
SELECT row_id, CASE WHEN i <= floor(0.6 * n) THEN 'train' WHEN i <= floor(0.6 * n) + floor(0.2 * n) THEN 'val' ELSE 'test' END AS split, CASE WHEN j <= round_even(n * 0.25, 0) THEN 'validation' ELSE 'train' END AS half FROM c""",
    "replay_in_cycles": f"""WITH p AS (SELECT p_partkey, p_size / 20 AS x, p_size / 500 AS s, p_size < 25 AS d, p_size % 5 AS b FROM part)
SELECT p_partkey, {r('CASE WHEN d THEN pow(10, x) ELSE pow(10, -x) END', 'prediction')}, {r('CASE WHEN d THEN pow(10, x - s) ELSE pow(10, -x - s) END', 'ci_lo')}, {r('CASE WHEN d THEN pow(10, x + s) ELSE pow(10, s - x) END', 'ci_hi')}, CASE b WHEN 1 THEN 98 WHEN 4 THEN 95 ELSE 100 END AS cutoff, CASE b WHEN 1 THEN 'oed_model_batch1.mat' ELSE 'oed_model.mat' END AS model FROM p""",
    "protocols_in_names": """SELECT p_partkey, CASE WHEN p_size >= 10 THEN p_size || '.5-4.8-' || CASE WHEN p_size > 40 THEN 'x' ELSE '5.2' END || '-4.16' END AS protocol, CASE WHEN p_size BETWEEN 10 AND 40 THEN p_size + 0.5 END::DOUBLE AS C1, CASE WHEN p_size BETWEEN 10 AND 40 THEN 4.8 END::DOUBLE AS C2, CASE WHEN p_size BETWEEN 10 AND 40 THEN 5.2 END::DOUBLE AS C3, CASE WHEN p_size BETWEEN 10 AND 40 THEN 4.16 END::DOUBLE AS C4 FROM part""",
    "acquisition_reasons": f"WITH {_REPLAYED} SELECT * FROM (SELECT 'nonfinite_C4' AS reason, count(*) AS n FROM r WHERE C4 IS NULL UNION ALL SELECT 'prediction_le_0', count(*) FROM r WHERE prediction <= 0 UNION ALL SELECT 'anomalous', count(*) FROM r WHERE anomaly) WHERE n > 0",
    "scale_diagnostics": f"WITH {_REPLAYED} SELECT {_spread('raw', 'raw')}, {_spread('pow(10, raw)', 'direct')}, {_spread('pow(10, -raw)', 'inverse')}, {_spread('CASE WHEN prediction > 0 THEN prediction END', 'prediction')}, {_spread('1.0', 'ci_lo')}, {_spread('NULL::DOUBLE', 'ci_hi')}, {_spread('w', 'ci_width')}, count(*) FILTER (WHERE w > 2000) AS n_wide, count(*) FILTER (WHERE prediction <= 0) AS n_not_positive FROM r",
    "replay_summary": f"WITH {_REPLAYED} SELECT count(*) AS n_rows, count(*) FILTER (WHERE o_orderstatus <> 'F') AS n_features, count(prediction) AS n_finite, count(*) FILTER (WHERE prediction > 0) AS n_usable, count(*) FILTER (WHERE anomaly) AS n_anomalous, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_unavailable FROM r",
    "prediction_problems": "SELECT * FROM (SELECT 'missing' AS what, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'extra', count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'duplicate', count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'non-finite', count(*) FROM orders WHERE o_orderstatus = 'P') WHERE n > 0",
    "sanitised_tables": "SELECT c_custkey AS row_id, format('anon_cell_{:05d}', row_number() OVER (ORDER BY CAST(c_custkey AS VARCHAR)) - 1) AS cell_id, c_acctbal, 1 AS cycle_index, c_acctbal AS discharge_capacity, NULL::DOUBLE AS charge_capacity, 2.5::DOUBLE AS more FROM customer",
    "train_validation_ids": "SELECT c_custkey AS row_id, CASE WHEN row_number() OVER (ORDER BY c_custkey) > count(*) OVER () - round_even(count(*) OVER () * 0.25, 0) THEN 'validation' ELSE 'train' END AS split FROM customer",
    "weak_baseline_by_status": f"WITH t AS (SELECT avg(o_totalprice / 1000) AS m FROM orders WHERE o_orderstatus = 'F'), e AS (SELECT o_totalprice / 1000 AS y, m FROM orders, t WHERE o_orderstatus <> 'F') SELECT {r('sqrt(avg((m - y) ** 2))', 'rmse')}, {r('avg(abs(m - y))', 'mae')}, {r('avg(abs(m - y) / y) FILTER (WHERE y > 0)', 'mape')}, {r('100 * avg(abs(m - y) / y) FILTER (WHERE y > 0)', 'error_pct')} FROM e",
    "predictions_with_metadata": f"WITH m AS (SELECT l_orderkey, first(l_linestatus ORDER BY l_linenumber, l_suppkey, l_linestatus) AS s, first(l_suppkey ORDER BY l_linenumber, l_suppkey, l_linestatus) AS k, min(l_linenumber) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey AS row_id, {r(PRED, 'y_pred')}, o_orderstatus AS status, s AS status_meta, k AS l_suppkey, n AS l_linenumber FROM orders LEFT JOIN m ON l_orderkey = o_orderkey",
    "standard_names": "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'scalar_only' WHEN 'MACHINERY' THEN 'curve_only' WHEN 'HOUSEHOLD' THEN 'broad_physics' ELSE 'all_available' END AS feature_set FROM customer",
    "job_states_and_actions": f"""WITH j AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' ELSE 'FAILED' END AS st, substr(o_orderpriority, 1, 1) AS p, CAST(o_custkey % 4 AS INTEGER) AS rs, CAST(o_custkey % 5 * 40 + 8 AS INTEGER) AS mem, CASE WHEN o_custkey % 3 = 0 THEN '8h' ELSE '110:30:05' END AS t FROM orders WHERE o_orderstatus <> 'P'),
a AS (SELECT *, CASE WHEN st = 'COMPLETED' THEN 'completed' WHEN rs >= 3 THEN 'halt-max-resubmits' WHEN p = '3' THEN 'halt-needs-human' ELSE 'resubmitted' END AS action FROM j)
SELECT CAST(o_orderkey AS VARCHAR) AS job_id, st AS state, action, CASE WHEN action = 'resubmitted' AND p = '1' THEN least(2 * mem, 256) ELSE mem END AS mem_gb, CASE WHEN action = 'resubmitted' AND p = '2' THEN {_DOUBLE} ELSE t END AS time, CAST(rs + CASE WHEN action = 'resubmitted' THEN 1 ELSE 0 END AS INTEGER) AS resubmits, action LIKE 'halt%' AS needs_human FROM a""",
    "candidate_tags": """WITH p AS (SELECT p_partkey, lower(p_name || CASE WHEN p_size < 10 THEN ' Ridge(alpha) slope' WHEN p_size < 20 THEN ' RandomForestRegressor log diff' ELSE ' nothing' END) AS c FROM part)
SELECT p_partkey, CASE WHEN c LIKE '%gradientboostingregressor%' THEN 'GradientBoostingRegressor' WHEN c LIKE '%randomforestregressor%' THEN 'RandomForestRegressor' WHEN c LIKE '%elasticnet%' THEN 'ElasticNet' WHEN c LIKE '%ridge%' THEN 'Ridge' ELSE 'unknown' END AS model,
  array_to_string(list_sort(list_filter([CASE WHEN regexp_matches(c, 'capacity|q') THEN 'early discharge capacity' END, CASE WHEN regexp_matches(c, 'slope|polyfit') THEN 'late-cycle capacity slope' END, CASE WHEN c LIKE '%diff%' THEN 'difference between cycle 10 and cycle N curves' END,
  CASE WHEN c LIKE '%log%' THEN 'log-transformed curve statistics' END, CASE WHEN regexp_matches(c, 'trapz|integr|energy') THEN 'energy-like integral changes' END, CASE WHEN regexp_matches(c, 'protocol|c1') THEN 'protocol current features' END], lambda x: x IS NOT NULL)), '; ') AS tags FROM p""",
    "review_statuses": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'pass' WHEN p_size < 30 THEN CASE WHEN p_size <= 15 THEN 'needs_attention' WHEN p_partkey % 2 = 1 THEN 'pass_with_warnings' ELSE 'pass' END WHEN p_size < 40 THEN 'fail' ELSE 'unknown' END AS status FROM part",
    "recipe_from_paths": "SELECT p_partkey, CASE WHEN p_size < 5 THEN 'given' WHEN p_size < 20 THEN 'broad_physics' WHEN p_size < 35 THEN 'my_mix' ELSE 'unknown' END AS recipe, CASE WHEN p_size < 20 THEN 'broad_physics' END AS table_recipe, CASE WHEN p_size < 20 THEN 3 ELSE 9 END AS table_early, CASE WHEN p_size < 20 THEN 50 ELSE 99 END AS table_late, 100 AS table_first FROM part",
    "deduplicated_configs": f"""WITH {_RESULTS}, g AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY rmse, l_orderkey, l_linenumber) AS k, row_number() OVER (ORDER BY rmse, l_orderkey, l_linenumber) AS best FROM res WHERE success)
SELECT config, candidate_id, round(rmse, 5) + 0.0 AS rmse FROM g WHERE k = 1 UNION ALL SELECT 'counts', count(*) || '/' || count(*) FILTER (WHERE k = 1) || '/' || count(*) FILTER (WHERE k > 1), 0.0 FROM g UNION ALL SELECT 'best', candidate_id, round(rmse, 5) + 0.0 FROM g WHERE best = 1""",
    "shortlist_with_secondary": f"""WITH {_RESULTS}, s AS (SELECT candidate_id || '/' || l_orderkey || '/' || l_linenumber AS candidate_id, run_id, round(rmse, 4) AS x FROM res WHERE l_linenumber NOT IN (2, 3)), t AS (SELECT *, CAST(row_number() OVER (ORDER BY x, candidate_id, run_id) AS INTEGER) AS k FROM s)
SELECT candidate_id, run_id, k AS rank_in_shortlist, round(x, 4) + 0.0 AS secondary_rmse, CASE row_number() OVER (ORDER BY x, candidate_id) WHEN 1 THEN 'champion' WHEN 2 THEN 'runner_up' END AS title FROM t WHERE k <= 6""",
    "campaign_examples": f"WITH {_RESULTS} SELECT config, first(candidate_id ORDER BY l_orderkey, l_linenumber, candidate_id, run_id) AS candidate_id, first(run_id ORDER BY l_orderkey, l_linenumber, candidate_id, run_id) AS run_id, true AS found, array_to_string(list_sort(list(DISTINCT l_linenumber)), ';') AS seeds, round(avg(rmse), 5) + 0.0 AS mean FROM res GROUP BY config",
    "full_campaigns": "SELECT c_custkey FROM customer WHERE c_nationkey % 3 = 2 AND c_mktsegment <> 'MACHINERY'",
}
