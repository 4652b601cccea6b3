"""Column expressions with one rule throughout: NaN and infinities are missing, that is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """The number as a double, null where it is NaN or infinite."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def number(c: str | Column) -> Column:
    """A text as a finite double, null where it is none."""
    return finite(col(c).try_cast("double"))


def safe_log10(c: str | Column, eps: float) -> Column:
    return F.log10(F.abs(finite(c)) + F.lit(eps))


def log10_abs(c: str | Column) -> Column:
    """log10 of the magnitude; null for zero."""
    x = F.abs(finite(c))
    return F.when(x > 0, F.log10(x))


def g1_skew(c: str | Column) -> Column:
    """Adjusted Fisher-Pearson skewness as an aggregate; 0 for fewer than three values or values that hardly vary."""
    x = col(c)
    n = F.count(x)
    flat = F.lit(1e-12) + 1e-9 * F.greatest(F.lit(1.0), F.max(F.abs(x)))
    varies = (n >= 3) & (F.max(x) - F.min(x) > flat) & (F.stddev_pop(x) > flat)
    return F.when(n >= 1, F.when(varies, F.skewness(x) * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2, F.lit(0))).otherwise(0.0))


def biased_skew(c: str | Column) -> Column:
    return F.when(F.var_pop(col(c)) > 0, F.skewness(col(c)))


def slope(y: str | Column, x: str | Column) -> Column:
    return F.when((F.count(col(y)) >= 2) & (F.var_pop(F.when(col(y).isNotNull(), col(x))) > 0), F.regr_slope(col(y), col(x)))


def intercept(y: str | Column, x: str | Column) -> Column:
    return F.when((F.count(col(y)) >= 2) & (F.var_pop(F.when(col(y).isNotNull(), col(x))) > 0), F.regr_intercept(col(y), col(x)))


def r2(y: str | Column, x: str | Column) -> Column:
    """Share of variance that a line explains; null for a constant series."""
    return F.when((F.count(col(y)) >= 2) & (F.var_pop(col(y)) > 0), F.regr_r2(col(y), col(x)))


def first_by(value: str | Column, order: str | Column) -> Column:
    v = col(value)
    return F.min_by(v, F.when(v.isNotNull(), col(order)))


def last_by(value: str | Column, order: str | Column) -> Column:
    v = col(value)
    return F.max_by(v, F.when(v.isNotNull(), col(order)))


AGGREGATES = {
    "max": lambda v, o: F.max(v),
    "min": lambda v, o: F.min(v),
    "mean": lambda v, o: F.avg(v),
    "std": lambda v, o: F.stddev_pop(v),
    "var": lambda v, o: F.var_pop(v),
    "skew": lambda v, o: g1_skew(v),
}


def aggregate(name: str, value: str | Column, order: str | Column) -> Column:
    """An aggregate by name; an unknown name is the last value in order."""
    return AGGREGATES.get(name, lambda v, o: last_by(v, o))(col(value), col(order))


def delta(a: Column, b: Column, how: str, eps: float = 1e-12) -> Column:
    """b against a: difference, ratio, relative or log."""
    if how == "ratio":
        return F.try_divide(b, a + eps)
    if how == "relative":
        return F.try_divide(b - a, F.abs(a) + eps)
    return F.log10(F.abs(b - a) + eps) if how == "log" else b - a


def transformed(c: Column, how: str, eps: float = 1e-12) -> Column:
    """identity, abs or log_abs; an unknown name leaves the value."""
    return F.abs(c) if how == "abs" else safe_log10(c, eps) if how == "log_abs" else c


def text_key(cols: list[str | Column], digits: int = 3) -> Column:
    """Numbers rounded half to even and joined by a bar; a missing one prints nan."""
    return F.concat_ws("|", *[F.coalesce(F.bround(col(c).cast("double"), digits).cast("string"), F.lit("nan")) for c in cols])
