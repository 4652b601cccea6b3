"""Stores, digests and held-out tables on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.digest import by_digest
from ..operators import evaluation as E
from ..operators.shared import shared_folder
from ..streaming.store import Store
from .tables import DAILY, daily, r, rounded, table


def store_latest(spark, d):
    """The events in batches by the day of the week, the last ones first and each put in twice: the latest of each user."""
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    store = Store(spark, shared_folder(spark), ["user_id"], ["ts", "event_id"], compact_after=5)
    for day in (7, 6, 5, 4, 3, 2, 1):
        for _ in range(2):
            store.put(rows.where(F.dayofweek("ts") == day), day)
    return rounded(store.read().select("user_id", "event_id", "event_type", "value"))


def settings_by_digest(spark, d):
    """Settings of line items, their names and numbers written in two ways: one digest for each that differ."""
    tax, n = F.col("l_tax").cast("string"), F.col("l_linenumber").cast("string")
    one = F.concat(F.lit('{"model": {"alpha": '), tax, F.lit(', "steps": ['), n, F.lit(', 2]}, "flag": true, "none": {}}'))
    two = F.concat(F.lit('{"none": {}, "flag": true, "model": {"steps": ['), n, F.lit('.0, 2e0], "alpha": '), tax, F.lit("0}}"))
    text = F.when(F.col("l_returnflag") == "N", one).otherwise(two)
    rows = table(spark, d, "lineitem").select(text.alias("settings"), F.col("l_linenumber").alias("line"), F.col("l_tax").cast("double").alias("tax"))
    ends = lambda of: [x for c in ("line", "tax") for x in (F.min(of(c, "")).alias(c), F.max(of(c, "last_")).alias(f"last_{c}"))]
    made = by_digest(rows, "settings", [F.count("*").alias("n"), *ends(lambda c, last: c)], [F.sum("n").alias("n"), *ends(lambda c, last: last + c)])
    made = made.select("digest", "n", "line", "last_line", "tax", "last_tax")
    return rounded(made.drop("digest"))


def locked_holdout(spark, d):
    """A locked segment's customers as a search must never see them: aliases, early steps, finite labels."""
    c = table(spark, d, "customer")
    meta = c.select(F.col("c_custkey").alias("row_id"), F.col("c_mktsegment").alias("batch"), (F.col("c_nationkey") / 4).alias("C1"))
    labels = c.select(F.col("c_custkey").alias("row_id"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).cast("double").alias("y"))
    steps = daily(spark, d).select(F.col("entity").alias("row_id"), F.col("step").alias("cycle_index"), F.col("value").alias("discharge_capacity"))
    out = c.where("c_nationkey = 3").select(F.col("c_custkey").alias("row_id"))
    held, early, known = E.holdout(meta, steps, labels, "batch", "BUILDING", 20, out)
    each = known.join(held.select("cell_id", "C1"), "cell_id").join(early.groupBy("cell_id").agg(F.count("*").alias("n"), F.sum("discharge_capacity").alias("q")), "cell_id", "left")
    return rounded(each.select("cell_id", "C1", "y", "n", "q"))


QUERIES = {f.__name__: f for f in (store_latest, settings_by_digest, locked_holdout)}

ORACLE_SQL = {
    "store_latest": f"SELECT user_id, event_id, event_type, {r('value', 'value')} FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "settings_by_digest": f"SELECT count(*) AS n, l_linenumber AS line, l_linenumber AS last_line, {r('l_tax', 'tax')}, {r('l_tax', 'last_tax')} FROM lineitem GROUP BY l_tax, l_linenumber",
    "locked_holdout": f"""WITH {DAILY}, m AS (SELECT c_custkey, c_nationkey / 4 AS C1, c_acctbal AS y, printf('anon_cell_%05d', row_number() OVER (ORDER BY CAST(c_custkey AS VARCHAR)) - 1) AS cell_id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey <> 3 AND c_acctbal > 0),
s AS (SELECT entity, count(*) AS n, sum(value) AS q FROM daily WHERE step BETWEEN 1 AND 20 GROUP BY entity) SELECT cell_id, {r('C1', 'C1')}, {r('y', 'y')}, n, {r('q', 'q')} FROM m LEFT JOIN s ON entity = c_custkey""",
}
