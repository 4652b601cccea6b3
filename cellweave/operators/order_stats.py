"""Exact order statistics of groups of any size, by narrowing ranges of values.

A group's values are never gathered. A bounded sketch proposes cuts; how many values lie between neighbouring cuts is
counted exactly, and only the range that holds a wanted rank is kept, until what is left of every group is few distinct
values. Those are ordered with their numbers. The sketch only steers: whatever it proposes, the counts are exact. Its cuts
are computed once a round, since a sketch depends on the order in which rows come to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import finite
from .shared import settled

#: Ranges that a group is cut into at once, the sketch's accuracy, and distinct values of a group that are ordered.
CUTS, ACCURACY, MOST = 64, 2000, 2000
#: Groups up to which their cuts and chosen ranges go to all tasks, and the values stay where they are.
FEW_GROUPS = 4096


def _found(values: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, k, v) of rows (keys, k, v, c): of each group the value whose rank, among values each taken ``c`` times, is k."""
    order = Window.partitionBy(*keys, "k").orderBy("v")
    return values.withColumn("upto", F.sum("c").over(order)).where("upto > k").groupBy(*keys, "k").agg(F.min("v").alias("v"))


def ranked_values(values: DataFrame, keys: list[str], ranks: DataFrame, most: int = MOST) -> DataFrame:
    """(keys, k, v): the values at the ranks, counted from zero, that ``ranks`` (keys, k) names; ``values``: (keys, v) without
    nulls. A group has fewer than 2^63 values."""
    wanted = ranks.select(*keys, "k", F.col("k").alias("_at"))
    rows, by = values.withColumn("c", F.lit(1).cast("long")), keys
    held: list[DataFrame] = []
    while True:
        largest, groups = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n"), F.count("*")).first()
        if not largest or largest <= most:
            break
        near = F.broadcast if groups <= FEW_GROUPS else lambda few: few
        share = F.percentile_approx("v", [i / CUTS for i in range(1, CUTS)], ACCURACY)
        # a sketch made twice may differ, and counts hold for the cuts they were made with only
        cuts = settled(rows.groupBy(*by).agg(F.array_distinct(share).alias("cuts")))
        at = F.size(F.filter("cuts", lambda x: x < F.col("v")))
        placed = rows.join(near(cuts), by).withColumn("b", at).drop("cuts")
        counts = placed.groupBy(*by, "b").agg(F.sum("c").alias("n"))  # at most CUTS a group
        upto = F.sum("n").over(Window.partitionBy(*by).orderBy("b"))
        ranges = counts.withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("n"))
        joined = ranges.join(wanted, by).where("_at >= lo AND _at < hi")
        chosen = joined.select(*by, "b", *(["k"] if "k" not in by else []), "_at", "lo")
        new_by = keys + ["k"]
        rows = placed.join(near(chosen.select(*by, "b", *(["k"] if "k" not in by else []))), [*by, "b"]).groupBy(*new_by, "v").agg(F.sum("c").alias("c")).persist()
        wanted = chosen.select(*new_by, (F.col("_at") - F.col("lo")).alias("_at")).persist()
        held += [rows, wanted]
        by = new_by
    left = rows.join(wanted, by)
    if by == keys:
        left = left.groupBy(*keys, "k", "_at", "v").agg(F.sum("c").alias("c"))
    found = _found(left.select(*keys, F.col("k").alias("_k"), F.col("_at").alias("k"), "v", "c"), [*keys, "_k"], most)
    return found.select(*keys, F.col("_k").alias("k"), "v")


def quantiles(rows: DataFrame, keys: list[str], columns: dict[str, str | Column], shares: list[float], most: int = MOST) -> DataFrame:
    """(keys, <name>_<i>, ...): for each named column the quantiles at ``shares``, straight between neighbouring values, of
    its finite values in each group; null in a group without any. Without keys there is one row."""
    names = list(columns)
    own = [f"_key{i}" for i in range(len(keys))] or ["_key0"]
    # nulls are a group as any other: keys are compared as structs, which are not null
    named = [F.struct(F.col(k)).alias(o) for k, o in zip(keys, own)] or [F.lit(0).alias("_key0")]
    wide = rows.select(*named, *[finite(c).alias(n) for n, c in columns.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("column"), F.col(n).alias("v")) for i, n in enumerate(names)]))
    values = wide.select(*own, pairs.alias("p")).select(*own, "p.column", "p.v").where("v IS NOT NULL")
    by = [*own, "column"]
    sizes = values.groupBy(*by).agg(F.count("*").alias("n"))
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("share"), (F.lit(float(s)) * (F.col("n") - 1)).alias("at")) for i, s in enumerate(shares)]))
    targets = sizes.select(*by, asked.alias("a")).select(*by, "a.share", F.floor("a.at").alias("k"), (F.col("a.at") - F.floor("a.at")).alias("rest"))
    ends = targets.select(*by, F.explode(F.when(F.col("rest") > 0, F.array(F.col("k"), F.col("k") + 1)).otherwise(F.array("k"))).alias("k")).distinct()
    found = ranked_values(values, by, ends, most)
    low = targets.join(found, [*by, "k"])
    high = found.select(*by, (F.col("k") - 1).alias("k"), F.col("v").alias("v2"))
    value = F.when((F.col("rest") > 0) & F.col("v2").isNotNull(), F.col("v") + (F.col("v2") - F.col("v")) * F.col("rest")).otherwise(F.col("v"))
    made = low.join(high, [*by, "k"], "left").withColumn("value", value)
    out = made.groupBy(*own).agg(*[F.max(F.when((F.col("column") == i) & (F.col("share") == j), F.col("value"))).alias(f"{n}_{j}") for i, n in enumerate(names) for j in range(len(shares))])
    every = wide.select(*own).distinct() if keys else rows.sparkSession.range(1).select(F.lit(0).alias("_key0"))
    out = every.join(out, own, "left")
    return out.select(*[F.col(f"{o}.{k}").alias(k) for k, o in zip(keys, own)], *[f"{n}_{j}" for n in names for j in range(len(shares))])


def medians(rows: DataFrame, keys: list[str], columns: dict[str, str | Column], most: int = MOST) -> DataFrame:
    """(keys, names): the exact median of each named column's finite values in each group."""
    made = quantiles(rows, keys, columns, [0.5], most)
    return made.select(*keys, *[F.col(f"{n}_0").alias(n) for n in columns])
