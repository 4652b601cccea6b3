"""Filter, join, split, profile and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import campaign as K
from ..operators import relational as R
from ..operators import splits as T
from ..sources import payload as L
from .tables import daily, r, rounded, table

RULES = [("licence", r"(?i)licen[cs]ed? under|all rights reserved"), ("mail", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]+"), ("number", r"[0-9]{4,}")]


def checks():
    return {"low_price": F.col("o_totalprice") < 20000, "urgent": F.col("o_orderpriority") == "1-URGENT", "open": F.col("o_orderstatus") == "O", "no_customer": F.col("o_custkey").isNull()}


def exclusion_reasons(spark, d):
    return R.with_reasons(table(spark, d, "orders"), checks()).select("o_orderkey", "reasons")


def exclusion_counts(spark, d):
    return R.reason_counts(R.split_by_reasons(table(spark, d, "orders"), checks())[1])


def identity_match_join(spark, d):
    left = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("/raw/"), "s_name", F.lit("_structure.json")).alias("file"))
    right = table(spark, d, "customer").select(F.regexp_replace("c_name", "Customer", "SUPPLIER").alias("name"), "c_custkey")
    hit, miss = R.matched(left, right, "file", "name", ["c_custkey"])
    both = hit.select("s_suppkey", "identity", "c_custkey").unionByName(miss.select("s_suppkey", "identity"), allowMissingColumns=True)
    return both.withColumn("c_custkey", F.coalesce("c_custkey", F.lit(-1)))


def path_resolution_cascade(spark, d):
    p = table(spark, d, "pages")
    listing = p.where("html LIKE '%a%'").select(F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    cand = {"direct": "url", "no_query": F.regexp_replace("url", r"[?#].*$", ""), "rebased": F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "^http:", "https:")}
    return R.resolved_path(cand, listing, p.select("page_id", "url"), "page_id")


def anonymised_keys(spark, d):
    return R.anonymised(table(spark, d, "customer"), "c_custkey")


def semi_anti_coverage(spark, d):
    return R.missing_and_extra(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select((F.col("doc_id") * 2).alias("doc_id")), "doc_id")


def union_by_name_offset(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return R.stacked(a, b, "row_id")


def dedupe_best_config(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey")
    return R.best_per(li, ["l_returnflag", "l_linestatus", "l_linenumber"], "l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey")


def upsert_summary(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = s.where("s_acctbal > 4500").select((F.col("s_suppkey") * 2).alias("s_suppkey"), F.lit("new").alias("s_name"), F.col("s_acctbal").alias("gain"))
    return R.upserted(s, new, "s_suppkey")


def dataset_profile(spark, d):
    return R.dataset_profile(table(spark, d, "events").select("event_id", "user_id", "event_type", "props"))


def failure_classifier(spark, d):
    return table(spark, d, "documents").groupBy(R.classified("text", RULES, "other").alias("class")).agg(F.count("*").alias("n"))


def batch_eda_rollup(spark, d):
    return rounded(R.batch_statistics(table(spark, d, "customer").withColumn("c_acctbal", F.col("c_acctbal") / 777), "c_mktsegment", "c_acctbal"), 5)


def field_availability(spark, d):
    e = table(spark, d, "events").withColumn("never", F.lit(None).cast("double")).withColumn("sometimes", F.when(F.col("event_id") % 7 == 0, F.col("value")))
    return R.availability(e, ["value", "never", "sometimes"])


def file_audit(spark, d):
    li = table(spark, d, "lineitem")
    return rounded(li.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.min("l_quantity").alias("least"), F.avg("l_quantity").alias("mean"), F.max("l_quantity").alias("most"), F.count_if(F.col("l_quantity") >= 25).alias("n_long"),
        F.array_join(F.array_sort(F.collect_set("l_linestatus")), ",").alias("statuses"),
    ))


def split_hash_groups(spark, d):
    return T.group_split(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), "c_nationkey", 0.25, 3)


def split_random_rows(spark, d):
    return T.group_split(table(spark, d, "customer").select("c_custkey"), F.concat(F.lit("row:"), F.col("c_custkey").cast("string")), 0.2, 5)


def _dated(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").cast("string").alias("batch"), (F.col("o_totalprice") / 1000).alias("life"))


def split_canonical(spark, d):
    return T.canonical_split(_dated(spark, d), "o_orderkey", "batch", "2001", ["1998", "1999"]).select("o_orderkey", "batch", "split")


def split_positional(spark, d):
    return T.positional_split(_dated(spark, d), "batch").groupBy("batch", "split").agg(F.count("*").alias("n"))


def split_balance(spark, d):
    return rounded(T.balance(T.canonical_split(_dated(spark, d), "o_orderkey", "batch", "2001", ["1998", "1999"]), "split", "life", 2.0))


def split_leaks(spark, d):
    rows = T.group_split(table(spark, d, "customer"), "c_nationkey", 0.25, 3)
    return T.leaks(rows, "split", "c_nationkey").withColumn("by", F.lit("group")).withColumnRenamed("c_nationkey", "key").unionByName(
        T.leaks(rows, "split", "c_mktsegment").withColumn("by", F.lit("segment")).select(F.lit(-1).alias("key"), "splits", "by")
    )


def stratified_sample(spark, d):
    return T.stratified_sample(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey", "s_acctbal", 5, 1)


def protocol_keys(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("  "), "p_name")).otherwise("").alias("name"), F.col("p_size").cast("double").alias("a"), F.when(F.col("p_size") > 20, F.col("p_size") / 8).alias("b"))
    return p.select("p_partkey", T.protocol_key("name", ["a", "b"]).alias("protocol"))


def payload_explode(spark, d):
    e = daily(spark, d).groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("event_id", "step", "kind", "value"))).alias("r"))
    doc = F.to_json(F.struct(F.struct(F.transform("r", lambda x: x["step"]).alias("cycle_index"), F.transform("r", lambda x: F.upper(x["kind"])).alias("step_type"), F.transform("r", lambda x: x["value"]).alias("voltage"), F.slice(F.transform("r", lambda x: x["event_id"]), F.lit(1), F.size("r") - 1).alias("IR")).alias("cycles")))
    held = e.select("entity", F.lit("").alias("path"), F.try_parse_json(doc).alias("payload"))
    out = L.exploded(held, "cycles", ["voltage", "internal_resistance", "temperature"])
    return rounded(out.groupBy("entity", "kind").agg(F.count("*").alias("n"), F.sum("voltage").alias("voltage"), F.sum("internal_resistance").alias("ids"), F.count("temperature").alias("n_temperature"), F.max("step").alias("last_step")))


def trace_latest(spark, d):
    return L.latest(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


def feedback_window(spark, d):
    return K.last_rows(table(spark, d, "events").select("event_id", "event_type"), "event_id")


def head_tail_per_batch(spark, d):
    return K.head_and_tail(table(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_acctbal"), "c_mktsegment", "c_acctbal", 5, "c_custkey")


QUERIES = {f.__name__: f for f in (
    exclusion_reasons, exclusion_counts, identity_match_join, path_resolution_cascade, anonymised_keys, semi_anti_coverage, union_by_name_offset, dedupe_best_config, upsert_summary, dataset_profile,
    failure_classifier, batch_eda_rollup, field_availability, file_audit, split_hash_groups, split_random_rows, split_canonical, split_positional, split_balance, split_leaks, stratified_sample, protocol_keys,
    payload_explode, trace_latest, feedback_window, head_tail_per_batch,
)}

_REASONS = "concat_ws(';', CASE WHEN o_totalprice < 20000 THEN 'low_price' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END, CASE WHEN o_orderstatus = 'O' THEN 'open' END, CASE WHEN o_custkey IS NULL THEN 'no_customer' END)"
_DATED = "dated AS (SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS batch, o_totalprice / 1000 AS life FROM orders)"
_CANON = _DATED + """, pool AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|0'), o_orderkey) AS i, count(*) OVER () AS n FROM dated WHERE batch IN ('1998', '1999')),
canon AS (SELECT dated.*, CASE WHEN batch = '2001' THEN 'secondary_test' WHEN coalesce(i <= round_even(n * 0.488, 0), false) THEN 'train' ELSE 'primary_test' END AS split FROM dated LEFT JOIN pool USING (o_orderkey))"""


def _split_sql(group, share, seed):
    return f"""g AS (SELECT DISTINCT {group} AS g FROM customer), h AS (SELECT g, row_number() OVER (ORDER BY md5(CAST(g AS VARCHAR) || '|{seed}'), g) AS i, count(*) OVER () AS n FROM g),
split AS (SELECT c.*, CASE WHEN i <= greatest(1, least(n - 1, round_even(n * {share}, 0))) THEN 'validation' ELSE 'train' END AS split FROM customer c JOIN h ON h.g = {group})"""


_norm = lambda x: f"regexp_replace(lower(regexp_replace(regexp_replace({x}, '.*/', ''), '(\\.json|\\.gz|\\.csv|\\.h5|\\.hdf5|\\.mat)+$', '')), '_structure$', '')"
_prof = lambda c: f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS largest FROM events"
_eda = lambda c: f"count(a) AS n, {', '.join(f'round({e}, 5) + 0.0 AS {n}' for e, n in (('max(a)', 'max'), ('min(a)', 'min'), ('avg(a)', 'mean'), ('median(a)', 'median'), ('stddev_samp(a)', 'std')))}"
_clean = "regexp_replace(url, '[?#].*$', '')"

ORACLE_SQL = {
    "exclusion_reasons": f"SELECT o_orderkey, {_REASONS} AS reasons FROM orders",
    "exclusion_counts": f"SELECT reason, count(*) AS n FROM (SELECT unnest(string_split({_REASONS}, ';')) AS reason FROM orders WHERE {_REASONS} <> '') GROUP BY reason",
    "identity_match_join": f"WITH l AS (SELECT s_suppkey, {_norm(chr(39) + '/raw/' + chr(39) + ' || s_name || ' + chr(39) + '_structure.json' + chr(39))} AS identity FROM supplier), c AS (SELECT c_custkey, {_norm(chr(39) + 'x/' + chr(39) + ' || replace(c_name, ' + chr(39) + 'Customer' + chr(39) + ', ' + chr(39) + 'SUPPLIER' + chr(39) + ')')} AS identity FROM customer) SELECT s_suppkey, identity, coalesce(c_custkey, -1) AS c_custkey FROM l LEFT JOIN c USING (identity)",
    "path_resolution_cascade": f"""WITH l AS (SELECT DISTINCT {_clean} AS path FROM pages WHERE html LIKE '%a%'), c AS (SELECT page_id, url AS a, {_clean} AS b, regexp_replace({_clean}, '^http:', 'https:') AS c FROM pages)
SELECT page_id, CASE WHEN a IN (SELECT path FROM l) THEN a WHEN b IN (SELECT path FROM l) THEN b WHEN c IN (SELECT path FROM l) THEN c END AS path,
  CASE WHEN a IN (SELECT path FROM l) THEN 'direct' WHEN b IN (SELECT path FROM l) THEN 'no_query' WHEN c IN (SELECT path FROM l) THEN 'rebased' ELSE 'unresolved' END AS how, CAST(3 AS BIGINT) AS tried FROM c""",
    "anonymised_keys": "SELECT c_custkey, format('anon_cell_{:05d}', dense_rank() OVER (ORDER BY CAST(c_custkey AS VARCHAR)) - 1) AS anon FROM customer WHERE c_custkey IS NOT NULL",
    "semi_anti_coverage": "WITH g AS (SELECT doc_id * 2 AS doc_id FROM labels) SELECT DISTINCT doc_id, 'missing' AS what FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM g) UNION ALL SELECT DISTINCT doc_id, 'extra' FROM g WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'duplicate' FROM g GROUP BY doc_id HAVING count(*) > 1",
    "union_by_name_offset": "SELECT s_suppkey AS row_id, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey + (SELECT max(s_suppkey) + 1 FROM supplier), c_name, NULL, c_mktsegment FROM customer",
    "dedupe_best_config": "SELECT l_returnflag, l_linestatus, l_linenumber, l_extendedprice, l_orderkey, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_linenumber ORDER BY l_extendedprice, l_orderkey, l_partkey, l_suppkey) = 1",
    "upsert_summary": "SELECT s_suppkey, s_name, s_acctbal, NULL::DOUBLE AS gain FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey * 2 FROM supplier WHERE s_acctbal > 4500) UNION ALL SELECT s_suppkey * 2, 'new', NULL, s_acctbal FROM supplier WHERE s_acctbal > 4500",
    "dataset_profile": " UNION ALL ".join(_prof(c) for c in ("event_id", "user_id", "event_type", "props")),
    "failure_classifier": "SELECT " + "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in RULES) + " ELSE 'other' END AS class, count(*) AS n FROM documents GROUP BY 1",
    "batch_eda_rollup": f"WITH c AS (SELECT c_mktsegment, c_acctbal / 777 AS a FROM customer) SELECT c_mktsegment, {_eda('a')}, false AS overall FROM c GROUP BY c_mktsegment UNION ALL SELECT NULL, {_eda('a')}, true FROM c",
    "field_availability": "SELECT 'value' AS field, count(value) > 0 AS available FROM events UNION ALL SELECT 'never', false UNION ALL SELECT 'sometimes', count(value) FILTER (WHERE event_id % 7 = 0) > 0 FROM events",
    "file_audit": f"SELECT l_returnflag, count(*) AS n, {r('min(l_quantity)', 'least')}, {r('avg(l_quantity)', 'mean')}, {r('max(l_quantity)', 'most')}, count(*) FILTER (WHERE l_quantity >= 25) AS n_long, array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS statuses FROM lineitem GROUP BY l_returnflag",
    "split_hash_groups": f"WITH {_split_sql('c_nationkey', 0.25, 3)} SELECT c_custkey, c_mktsegment, c_nationkey, split FROM split",
    "split_random_rows": f"WITH {_split_sql(chr(39) + 'row:' + chr(39) + ' || CAST(c_custkey AS VARCHAR)', 0.2, 5)} SELECT c_custkey, split FROM split",
    "split_canonical": f"WITH {_CANON} SELECT o_orderkey, batch, split FROM canon",
    "split_positional": f"WITH {_DATED}, p AS (SELECT *, dense_rank() OVER (ORDER BY batch) AS k FROM dated) SELECT batch, CASE k WHEN 1 THEN 'train' WHEN 2 THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM p GROUP BY 1, 2",
    "split_balance": f"WITH {_CANON}, e AS (SELECT split, count(*) AS n, avg(life) AS mean FROM canon GROUP BY split), t AS (SELECT mean AS tm FROM e WHERE split = 'train') SELECT split, n, {r('mean', 'mean')}, {r('abs(mean - tm)', 'delta')}, abs(mean - tm) <= 2.0 AS balanced FROM e, t",
    "split_leaks": f"WITH {_split_sql('c_nationkey', 0.25, 3)} SELECT c_nationkey AS key, count(DISTINCT split) AS splits, 'group' AS by FROM split GROUP BY c_nationkey HAVING count(DISTINCT split) > 1 UNION ALL SELECT -1, count(DISTINCT split), 'segment' FROM split GROUP BY c_mktsegment HAVING count(DISTINCT split) > 1",
    "stratified_sample": "WITH q AS (SELECT quantile_cont(s_acctbal, 0.33) AS a, quantile_cont(s_acctbal, 0.67) AS b FROM supplier), s AS (SELECT s_suppkey, s_acctbal, CASE WHEN s_acctbal <= a THEN 'low' WHEN s_acctbal <= b THEN 'mid' ELSE 'high' END AS stratum FROM supplier, q) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5(CAST(s_suppkey AS VARCHAR) || '|1'), s_suppkey) <= 5",
    "protocol_keys": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN trim(p_name) ELSE format('{:g}', CAST(p_size AS DOUBLE)) || '-' || CASE WHEN p_size > 20 THEN format('{:g}', p_size / 8) ELSE 'nan' END END AS protocol FROM part",
    "payload_explode": f"WITH e AS (SELECT user_id AS entity, event_type AS kind, value * 0.7310585786::DOUBLE AS v, event_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS step, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events) SELECT entity, kind, count(*) AS n, {r('sum(v)', 'voltage')}, {r('sum(event_id)', 'ids')}, CAST(0 AS BIGINT) AS n_temperature, {r('max(step)', 'last_step')} FROM e WHERE back > 1 GROUP BY entity, kind",
    "trace_latest": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "feedback_window": "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 10",
    "head_tail_per_batch": "SELECT c_mktsegment, c_custkey, c_acctbal, CASE WHEN u <= 5 THEN 'head' ELSE 'tail' END AS place FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS u, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey DESC) AS w FROM customer) WHERE u <= 5 OR w <= 5",
}
