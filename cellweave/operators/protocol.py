"""Row-level features: protocol columns, arrays of a response, and a linear predictor replayed on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import biased_skew, finite, slope
from .order_stats import medians


def protocol_features(rows: DataFrame, key: str, columns: list[str], products: bool = False) -> DataFrame:
    """The columns that exist, and mean, largest and population variance of their finite values; products of neighbours."""
    names = [c for c in columns if c in rows.columns]
    got = F.filter(F.array(*[finite(c) for c in names]), lambda v: v.isNotNull())
    n = F.size(got)
    mean = F.aggregate(got, F.lit(0.0), lambda s, v: s + v) / F.nullif(n, F.lit(0))
    var = F.aggregate(F.transform(got, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda s, v: s + v) / F.nullif(n, F.lit(0))
    pairs = [(finite(a) * finite(b)).alias(f"{a}_x_{b}") for a, b in zip(names, names[1:])] if products else []
    return rows.select(key, *[finite(c).alias(f"protocol_{c}") for c in names], mean.alias("protocol_mean"), F.array_max(got).alias("protocol_max"), var.alias("protocol_var"), *pairs)


def numbers_of(c: str | Column) -> Column:
    """A list written as text, ``[a, b]`` or ``a,b``, as doubles; what is no number is null."""
    x = F.col(c) if isinstance(c, str) else c
    return F.transform(F.split(F.regexp_replace(x, r"[\[\]\s]", ""), ","), lambda v: finite(v.try_cast("double")))


def array_difference(rows: DataFrame, key: str, early: str, late: str) -> DataFrame:
    """Statistics of the late array less the early one, place by place; null where the lengths differ."""
    d = F.when(F.size(early) == F.size(late), F.zip_with(early, late, lambda a, b: b.cast("double") - a.cast("double")))
    flat = rows.select(key, F.explode(d).alias("d")).where("d IS NOT NULL")
    stats = flat.groupBy(key).agg(
        F.avg("d").alias("d_mean"), log10_abs_agg(F.min("d")).alias("log_min"), F.abs(F.avg("d")).alias("abs_mean"), F.var_pop("d").alias("abs_var"),
        F.abs(F.coalesce(biased_skew("d"), F.lit(0.0))).alias("abs_skew"), F.sum(F.abs("d")).alias("sum_abs"), F.sum(F.col("d") * F.col("d")).alias("sum_sq"),
    )
    return rows.select(key).join(stats, key, "left")


def log10_abs_agg(c: Column) -> Column:
    return F.when(F.abs(c) > 0, F.log10(F.abs(c)))


def vector_features(series: DataFrame, arrays: DataFrame, key: str, step: str, signal: str, q_early: str, q_late: str, axis: str, cutoff: int, late: int) -> DataFrame:
    """The fifteen features of a series and two response arrays: values, range, two line fits, difference statistics in
    log10 with the sample variance and the biased skewness, and the difference of the enclosed areas."""
    s = series.where(F.col(step) <= cutoff).select(key, step, finite(signal).alias("q")).where("q IS NOT NULL")
    window = lambda lo: F.when(F.col(step).between(lo, cutoff), F.col("q"))
    at = lambda c: F.avg(F.when(F.col(step) == c, F.col("q")))
    fits = s.groupBy(key).agg(
        at(2).alias("f1"), (F.max("q") - at(2)).alias("f2"), at(cutoff).alias("f3"),
        slope(window(2), step).alias("f4"), F.when(F.count(window(2)) >= 2, F.regr_intercept(window(2), F.col(step))).alias("f5"),
        slope(window(late), step).alias("f6"), F.when(F.count(window(late)) >= 2, F.regr_intercept(window(late), F.col(step))).alias("f7"),
    )
    n = F.least(F.size(q_early), F.size(q_late))
    a, b = F.slice(q_early, F.lit(1), n), F.slice(q_late, F.lit(1), n)
    d = F.zip_with(a, b, lambda x, y: y.cast("double") - x.cast("double"))
    area = lambda q: F.aggregate(F.sequence(F.lit(1), F.size(q) - 1), F.lit(0.0), lambda t, i: t + (F.get(axis, i).cast("double") + F.get(axis, i - 1).cast("double")) / 2 * (F.get(q, i).cast("double") - F.get(q, i - 1).cast("double")))
    flat = arrays.select(key, (area(F.col(q_early)) - area(F.col(q_late))).alias("area"), F.posexplode(d).alias("i", "d"))
    diff = flat.groupBy(key).agg(
        log10_abs_agg(F.min("d")).alias("f8"), log10_abs_agg(F.avg("d")).alias("f9"), log10_abs_agg(F.var_samp("d")).alias("f10"), log10_abs_agg(biased_skew("d")).alias("f11"),
        log10_abs_agg(F.max(F.when(F.col("i") == 0, F.col("d")))).alias("f12"), log10_abs_agg(F.sum(F.abs("d"))).alias("f13"), log10_abs_agg(F.sum(F.col("d") * F.col("d"))).alias("f14"),
        F.max("area").alias("area"),
    ).withColumn("f15", F.when(F.col("area") > 0, F.log10("area"))).drop("area")
    both = fits.join(diff, key, "full_outer")
    complete = F.lit(True)
    for i in range(1, 16):
        complete = complete & F.col(f"f{i}").isNotNull()
    return both.withColumn("available", complete)


def linear_replay(rows: DataFrame, key: str, features: str, mu: list[float], sigma: list[float], picked: list[int], beta: list[float], y_mu: float, mse: float, t_value: float, inverse: list[list[float]], widest: float = 2000.0) -> DataFrame:
    """A linear predictor on chosen standardised features with its confidence bounds; a prediction whose interval is wider
    than ``widest`` is an anomaly and reads -1. ``inverse``: of the design matrix, intercept first."""
    z = [(F.get(features, F.lit(i)).cast("double") - mu[i]) / sigma[i] for i in picked]
    raw = F.lit(float(y_mu))
    for b, x in zip(beta, z):
        raw = raw + b * x
    x1 = [F.lit(1.0), *z]
    form = F.lit(0.0)
    for i, a in enumerate(x1):
        for j, b in enumerate(x1):
            if inverse[i][j]:
                form = form + inverse[i][j] * a * b
    se = t_value * F.sqrt(F.lit(mse) + mse * form)
    out = rows.select(key, raw.alias("raw"), se.alias("se"))
    low, high, mid = F.pow(F.lit(10.0), F.col("raw") - F.col("se")), F.pow(F.lit(10.0), F.col("raw") + F.col("se")), F.pow(F.lit(10.0), F.col("raw"))
    out = out.withColumn("ci_lo", low).withColumn("ci_hi", high).withColumn("ci_width", high - low).withColumn("anomaly", F.coalesce(F.col("ci_width") > widest, F.lit(False)))
    return out.withColumn("prediction", F.when(F.col("anomaly"), -1.0).otherwise(mid)).drop("se")


def target_transform(raw: DataFrame, value: str, low: float = 100.0, high: float = 3000.0) -> DataFrame:
    """Whether a batch's raw outputs are log10 of the target or of its inverse, by the median of each reading."""
    m = medians(raw, [], {"direct_median": F.pow(F.lit(10.0), F.col(value)), "inverse_median": F.pow(F.lit(10.0), -F.col(value))})
    named = F.when(F.col("direct_median").between(low, high), "direct").when(F.col("inverse_median").between(low, high) & (F.col("direct_median") < 1), "inverse").otherwise("error")
    return m.withColumn("transform", named)

