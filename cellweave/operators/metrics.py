"""Regression metrics, rank correlations, diagnostics and protocol rankings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import text_key
from .order_stats import medians
from .relational import ranked


def guarded_corr(a: str, b: str) -> Column:
    """Pearson correlation, null where either hardly varies."""
    return F.when((F.var_pop(a) > 0) & (F.var_pop(b) > 0), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def error_metrics(y: str = "y", p: str = "y_pred") -> list[Column]:
    """Aggregates: count, rmse, mae, r2 (null for one row), mape over positive targets, error percentage, pearson."""
    d = F.col(p) - F.col(y)
    mape = F.avg(F.when(F.col(y) > 0, F.abs(d) / F.col(y)))
    r2 = F.when((F.count("*") > 1) & (F.var_pop(y) > 0), 1 - F.sum(d * d) / (F.var_pop(y) * F.count("*")))
    return [F.count("*").alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), r2.alias("r2"), mape.alias("mape"), (mape * 100).alias("error_pct"), guarded_corr(y, p).alias("pearson")]


#: Points that one task counts on average, and the most ranges that either value is cut into.
RANGE_POINTS, MOST_RANGES = 50_000, 1024


def rank_correlations(rows: DataFrame, y: str = "y", p: str = "y_pred") -> tuple[float | None, float | None]:
    """Spearman's rho and Kendall's tau-b of the rows, None where either value does not vary; no pairs are formed.

    Equal points are counted once with their number. Both values are cut into ranges, whose number follows from the rows;
    each cut, and each value so common that it is several quantiles, is a range of its own, whose points are all tied.
    Pairs in different ranges of both values are read from the table of range counts, the others are counted inside the
    ranges: first along y, which also gives each point its rank in y, then along p, which sums the products of the ranks.
    """
    steps = [i / MOST_RANGES for i in range(1, MOST_RANGES)]
    one = rows.agg(F.count("*").alias("n"), *[F.percentile_approx(c, steps, 100_000).alias(k) for c, k in ((y, "a"), (p, "b"))]).first()
    if not one.n:
        return None, None
    each = max(1, MOST_RANGES // max(1, min(MOST_RANGES, one.n // RANGE_POINTS)))
    cuts = {k: sorted({x for x, z in zip(one[k], one[k][1:]) if x == z} | set(one[k][each - 1 :: each])) for k in ("a", "b")}

    def place(k: str) -> Column:  # even between cuts, odd on one
        edges = F.array(*[F.lit(float(c)) for c in cuts[k]]) if cuts[k] else F.array().cast("array<double>")
        return 2 * F.size(F.filter(edges, lambda c: c < F.col(k))) + F.array_contains(edges, F.col(k)).cast("int")

    points = rows.groupBy(F.col(y).cast("double").alias("a"), F.col(p).cast("double").alias("b")).agg(F.count("*").cast("double").alias("n"))
    points = points.withColumn("i", place("a")).withColumn("j", place("b"))
    cells = np.zeros((2 * len(cuts["a"]) + 1, 2 * len(cuts["b"]) + 1))
    for r in points.groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # at most a row a pair of ranges
        cells[r.i, r.j] = r.n
    score = _apart(cells) - _apart(cells[:, ::-1])
    in_a, in_b = cells.sum(axis=1), cells.sum(axis=0)
    before_a, before_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    middle = (one.n + 1) / 2
    held = lambda x: F.array(*[F.lit(float(v)) for v in x])

    def along_a(f: pd.DataFrame) -> pd.DataFrame:
        rank, ties = _ranks(f["a"].to_numpy(), f["n"].to_numpy())
        out = f[["i", "j", "b", "n"]].assign(ra=rank + before_a[int(f["i"].iloc[0])] - middle, s=0.0, t=0.0)
        out.iloc[0, out.columns.get_indexer(["s", "t"])] = concordance(f["a"].to_numpy(), f["b"].to_numpy(), f["n"].to_numpy()), ties
        return out

    tied = F.get(held(before_a + (in_a + 1) / 2 - middle), F.col("i"))
    ranked = points.where("i % 2 = 0").groupBy("i").applyInPandas(along_a, "i int, j int, b double, n double, ra double, s double, t double")
    ranked = ranked.unionByName(points.where("i % 2 = 1").select("i", "j", "b", "n", tied.alias("ra"), F.lit(0.0).alias("s"), F.lit(0.0).alias("t")))

    def along_b(f: pd.DataFrame) -> pd.DataFrame:
        n, ra = f["n"].to_numpy(), f["ra"].to_numpy()
        rank, ties = _ranks(f["b"].to_numpy(), n)
        rb = rank + before_b[int(f["j"].iloc[0])] - middle
        s = concordance(f["i"].to_numpy(), f["b"].to_numpy(), n) + f["s"].sum()
        return pd.DataFrame({"s": [s], "ta": [f["t"].sum()], "tb": [ties], "ab": [(n * ra * rb).sum()], "aa": [(n * ra * ra).sum()], "bb": [(n * rb * rb).sum()]})

    names = "s double, ta double, tb double, ab double, aa double, bb double"
    rb = F.get(held(before_b + (in_b + 1) / 2 - middle), F.col("j"))
    rest = ranked.where("j % 2 = 1").withColumn("rb", rb).agg(
        F.sum("s").alias("s"), F.sum("t").alias("ta"), F.lit(0.0).alias("tb"), F.sum(F.col("n") * F.col("ra") * F.col("rb")).alias("ab"),
        F.sum(F.col("n") * F.col("ra") * F.col("ra")).alias("aa"), F.sum(F.col("n") * F.col("rb") * F.col("rb")).alias("bb"),
    )
    near = ranked.where("j % 2 = 0").groupBy("j").applyInPandas(along_b, names)
    sums = near.unionByName(rest).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("s", "ta", "tb", "ab", "aa", "bb")]).first()
    every = one.n * (one.n - 1) / 2
    pairs = lambda x: float((x[1::2] * (x[1::2] - 1) / 2).sum())
    left_a, left_b = every - sums.ta - pairs(in_a), every - sums.tb - pairs(in_b)
    varies = left_a > 0 and left_b > 0
    return (sums.ab / (sums.aa * sums.bb) ** 0.5, (score + sums.s) / (left_a * left_b) ** 0.5) if varies else (None, None)


def _apart(cells: np.ndarray) -> float:
    """Pairs of which one lies in a later row and column."""
    later = np.cumsum(np.cumsum(cells[::-1, ::-1], axis=0), axis=1)[::-1, ::-1]
    return float((cells[:-1, :-1] * later[1:, 1:]).sum())


def _ranks(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Average ranks of weighted values, and the number of tied pairs."""
    _, at = np.unique(values, return_inverse=True)
    size = np.bincount(at, weights=n)
    return (np.cumsum(size) - size + (size + 1) / 2)[at], float((size * (size - 1) / 2).sum())


def concordance(u: np.ndarray, v: np.ndarray, n: np.ndarray) -> float:
    """Concordant less discordant pairs of weighted points; pairs equal in either value count nothing.

    Counted by merging halves of twice the width on each level; pairs with one u, which lie in order of v, are taken off.
    """
    u, v = np.unique(u, return_inverse=True)[1], np.unique(v, return_inverse=True)[1]
    order = np.lexsort((v, u))
    u, v, n = u[order], v[order], np.asarray(n, float)[order]
    m, total, width, place = len(v), 0.0, 1, np.arange(len(v))
    while width < m:
        block, right = place // (2 * width), (place // width) % 2 == 1
        left = np.where(right, 0.0, n)
        whole = np.bincount(block, weights=left)
        start = np.cumsum(whole) - whole
        key = (block * (m + 1) + v) * 2
        for after in (True, False):  # left ones of the same v behind and before the right one
            o = np.argsort(key + (right if not after else ~right), kind="stable")
            o, upto = o[right[o]], np.cumsum(left[o])[right[o]]
            total += float((n[o] * (upto - start[block[o]])).sum())
        total -= float((n * whole[block])[right].sum())
        width *= 2
    _, of = np.unique(u * (m + 1) + v, return_inverse=True)
    in_u, in_both = np.bincount(u, weights=n), np.bincount(of, weights=n)
    return total - float(((in_u**2).sum() - (in_both**2).sum()) / 2)


def spearman(rows: DataFrame, y: str = "y", p: str = "y_pred") -> DataFrame:
    """One row: the correlation of average ranks."""
    return rows.sparkSession.createDataFrame([(rank_correlations(rows, y, p)[0],)], "spearman double")


def kendall(rows: DataFrame, y: str = "y", p: str = "y_pred") -> DataFrame:
    """One row: Kendall's tau-b."""
    return rows.sparkSession.createDataFrame([(rank_correlations(rows, y, p)[1],)], "kendall double")


def regression_metrics(rows: DataFrame, y: str = "y", p: str = "y_pred") -> DataFrame:
    """One row with all metrics of the rows whose target and prediction are not null."""
    ok = rows.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    rho, tau = rank_correlations(ok, y, p)
    return ok.agg(*error_metrics(y, p)).withColumn("spearman", F.lit(rho).cast("double")).withColumn("kendall", F.lit(tau).cast("double"))


def diagnostics(y: str = "y", p: str = "y_pred") -> list[Column]:
    d = F.col(p) - F.col(y)
    return [
        F.avg(y).alias("y_mean"), F.min(y).alias("y_min"), F.max(y).alias("y_max"), F.avg(p).alias("pred_mean"), F.min(p).alias("pred_min"), F.max(p).alias("pred_max"),
        F.avg(d).alias("residual_mean"), F.stddev_pop(d).alias("residual_std"), F.count_if(F.col(p) < 0).alias("n_negative"), F.count_if(F.col(p).isNull()).alias("n_missing"),
    ]


def gain_recovered(weak: Column, candidate: Column, strong: Column) -> Column:
    """The share of the gap between a weak and a strong score that a candidate closes; null without a gap."""
    return F.try_divide(weak - candidate, weak - strong)


def protocol_ranking(observed: DataFrame, early: DataFrame, posterior: DataFrame, keys: list[str]) -> DataFrame:
    """Observed protocols by falling mean life with early prediction and posterior beside them, matched by text key."""
    k = text_key(keys).alias("key")
    o = observed.select(k, "life").groupBy("key").agg(F.count("life").alias("n"), F.avg("life").alias("mean"))
    o = o.join(medians(observed.select(k, "life"), ["key"], {"median": "life"}), "key")
    e = early.select(k, "prediction").groupBy("key").agg(F.avg("prediction").alias("early"))
    q = posterior.select(k, "posterior").groupBy("key").agg(F.max("posterior").alias("posterior"))
    both = o.join(e, "key", "left").join(q, "key", "left")
    for c, out in (("mean", "observed_rank"), ("early", "early_rank")):
        both = numbered(both, c, "key", out)
    return both.withColumn("residual", F.col("early") - F.col("mean"))


def numbered(rows: DataFrame, value: str, tie: str, out: str) -> DataFrame:
    """``rows`` with their place by falling ``value`` and ``tie``, which is unique; null where the value is."""
    named = ranked(rows.where(F.col(value).isNotNull()).select((-F.col(value)).alias("_v"), tie), ["_v", tie], out, start=1)
    return rows.join(named.select(tie, F.col(out).cast("int").alias(out)), tie, "left")

