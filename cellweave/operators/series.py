"""Operators over per-entity series: rows of entity, integer step and signals."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import aggregate, finite, first_by, intercept, last_by, slope


@dataclass
class Derived:
    """Features by two steps of SQL text: ``moments``, aggregates by name, and ``columns`` made of them. Moments that many
    features use are computed and planned once, and a text costs the driver one call, however long it is."""

    moments: dict[str, str] = field(default_factory=dict)
    columns: dict[str, str] = field(default_factory=dict)

    def __or__(self, other: Derived) -> Derived:
        return Derived(self.moments | other.moments, self.columns | other.columns)

    def only(self, names) -> Derived:
        return Derived(self.moments, {n: c for n, c in self.columns.items() if n in names})

    def of(self, rows: DataFrame, entity: str) -> DataFrame:
        """(entity, columns): moments that no column uses are left out by the optimiser.

        The many moments of an entity are wide, its rows are narrow: the rows move, and one entity's moments are held at a
        time. A text among the aggregates has Spark aggregate along sorted rows in place of a table of all entities.
        """
        text = F.max(F.coalesce(F.col(entity).cast("string"), F.lit(""))).alias("_text")
        made = rows.repartition(entity).groupBy(entity).agg(text, *[F.expr(c).alias(n) for n, c in self.moments.items()]).where("_text IS NOT NULL")
        return made.select(entity, *[F.expr(c).alias(n) for n, c in self.columns.items()])


def _name(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _finite(c: str) -> str:
    x = f"CAST({_name(c)} AS DOUBLE)"
    return f"CASE WHEN NOT isnan({x}) AND abs({x}) < double('infinity') THEN {x} END"


def per_step_mean(rows: DataFrame, entity: str, step: str, signals: list[str]) -> DataFrame:
    """One row an entity and step: the mean of each signal's finite values; rows without a step are left out."""
    return rows.where(F.col(step).isNotNull()).groupBy(entity, step).agg(*[F.avg(finite(s)).alias(s) for s in signals])


def step_value(signal: str, step: str, at: int) -> tuple[str, str]:
    """The name and text of a moment: the mean of a signal at a step."""
    return f"_{signal}_at_{at}", f"avg(CASE WHEN {_name(step)} = {int(at)} THEN {_finite(signal)} END)"


def value_columns(signal: str, step: str, steps: list[int], aggs: list[str] = ["last"], fallback: str | None = None) -> Derived:
    """A signal's mean at each step, for the names ``last`` and ``mean``, which are the same there; the ``fallback`` column's
    where the signal has none at the step."""
    made = Derived()
    for c in dict.fromkeys(steps):
        found = dict(step_value(x, step, c) for x in ([signal, fallback] if fallback else [signal]))
        text = f"coalesce({', '.join(map(_name, found))})"
        made |= Derived(found, {f"{signal}{'' if a == 'last' else '_' + a}_step_{c}": text for a in aggs if a in ("last", "mean")})
    return made


def value_at_step(rows: DataFrame, entity: str, step: str, signals: list[str], steps: list[int], aggs: list[str] = ["last"], samples: DataFrame | None = None, order: str | None = None, kind: str | None = None, kind_value: str | None = None) -> DataFrame:
    """Each signal at chosen steps, one column a step and aggregate, in one pass over the rows.

    ``last`` and ``mean`` are the mean of the step's rows, and of the samples' where the rows lack the step. Any other
    aggregate is one of the samples (of the rows, without samples) of the step, by ``order`` and of one kind if asked for.
    """
    means = [a for a in aggs if a in ("last", "mean")]
    other = [a for a in aggs if a not in ("last", "mean")]
    made = Derived()
    for s in signals:
        made |= value_columns(s, step, steps, means)
    cols = list(made.columns)
    out = made.of(rows.where(F.col(step).isNotNull()), entity) if cols else None
    if samples is not None and cols:
        raw = made.of(samples.where(F.col(step).isin(*steps)), entity).select(entity, *[F.col(n).alias(f"raw_{n}") for n in cols])
        out = out.join(raw, entity, "full_outer").select(entity, *[F.coalesce(n, f"raw_{n}").alias(n) for n in cols])
    for s in signals if other else []:
        made = raw_aggregate(samples if samples is not None else rows, entity, step, order or step, s, steps, other, kind, kind_value)
        out = made if out is None else out.join(made, entity, "full_outer")
    return out


def value_with_fallback(summary: DataFrame, samples: DataFrame, entity: str, step: str, signal: str, steps: list[int]) -> DataFrame:
    """As ``value_at_step`` of the summary, and of the raw samples where the summary has no such step."""
    return value_at_step(summary, entity, step, [signal], steps, samples=samples)


def with_raw_series(series: DataFrame, samples: DataFrame, entity: str, step: str, signals: list[str], keep_raw: bool = False) -> DataFrame:
    """The per-step means of ``series``; a signal without any finite value for an entity takes the samples' means, which
    ``keep_raw`` keeps as raw_<signal>."""
    raw = per_step_mean(samples, entity, step, signals).select(entity, step, *[F.col(s).alias(f"raw_{s}") for s in signals])
    both = per_step_mean(series, entity, step, signals).join(raw, [entity, step], "full_outer")
    own = Window.partitionBy(entity)
    raws = [f"raw_{s}" for s in signals] if keep_raw else []
    return both.select(entity, step, *[F.when(F.count(s).over(own) > 0, F.col(s)).otherwise(F.col(f"raw_{s}")).alias(s) for s in signals], *raws)


def raw_aggregate(samples: DataFrame, entity: str, step: str, order: str, signal: str, steps: list[int], aggs: list[str], kind: str | None = None, kind_value: str | None = None) -> DataFrame:
    """Aggregates of the raw samples of chosen steps, of one step kind if asked for."""
    rows = samples.where(F.col(step).isin(*steps))
    if kind:
        rows = rows.where(F.lower(F.trim(F.col(kind))) == kind_value.lower())
    return rows.groupBy(entity).agg(*[c.alias(n) for n, c in pick_columns(signal, step, order, steps, aggs).items()])


def pick_columns(signal: str, step: str, order: str, steps: list[int], aggs: list[str], kind: str | None = None, kind_value: str | None = None) -> dict[str, Column]:
    """Named aggregates of the rows of single steps, of one kind if asked for."""
    of = (lambda c: (F.col(step) == c) & (F.lower(F.trim(F.col(kind))) == kind_value.lower())) if kind else (lambda c: F.col(step) == c)
    return {f"{signal}_{a}_step_{c}": aggregate(a, F.when(of(c), finite(signal)), order) for c in dict.fromkeys(steps) for a in aggs}


def window_columns(signal: str, step: str, lo: int, hi: int) -> Derived:
    """A signal's per-step means in an inclusive window: mean, population deviation, extremes, last less first, line fit and
    the leading coefficient of the quadratic fit.

    Steps are measured from the window's middle, so that the fits' moments need no second pass.
    """
    mid, x = (lo + hi) / 2, _name(step)
    there = f"{x} BETWEEN {int(lo)} AND {int(hi)} AND {_name(signal)} IS NOT NULL"
    v, t = f"CASE WHEN {there} THEN {_name(signal)} END", f"CASE WHEN {there} THEN {x} - {mid}D END"
    texts = {
        "n": f"count({v})", "mean": f"avg({v})", "std": f"stddev_pop({v})", "min": f"min({v})", "max": f"max({v})", "first": f"min_by({v}, {t})", "last": f"max_by({v}, {t})",
        "slope": f"regr_slope({v}, {t})", "at_mid": f"regr_intercept({v}, {t})", "r2": f"regr_r2({v}, {t})", "t": f"sum({t})", "v": f"sum({v})",
        **{f"t{k}": f"sum({' * '.join([f'({t})'] * k)})" for k in (2, 3, 4)}, "tv": f"sum(({t}) * ({v}))", "t2v": f"sum(({t}) * ({t}) * ({v}))",
    }
    key = lambda k: f"_{signal}_{k}_in_{lo}_{hi}"
    m = {k: _name(key(k)) for k in texts}
    # the sums about the mean of the steps, from those about the window's middle
    for k, text in {
        "s2": "{t2} - {t} * {t} / {n}", "s3": "{t3} - 3 * {t} / {n} * {t2} + 2 * {t} * {t} * {t} / ({n} * {n})",
        "s4": "{t4} - 4 * {t} / {n} * {t3} + 6 * {t} * {t} / ({n} * {n}) * {t2} - 3 * {t} * {t} * {t} * {t} / ({n} * {n} * {n})",
        "d1": "{tv} - {t} / {n} * {v}",
    }.items():
        m[k] = f"({text.format(**m)})"
    m["d2"] = f"({m['t2v']} - 2 * {m['t']} / {m['n']} * {m['tv']} + {m['t']} * {m['t']} / ({m['n']} * {m['n']}) * {m['v']} - {m['s2']} * {m['mean']})"
    below = f"({m['s2']} * ({m['s4']} - {m['s2']} * {m['s2']} / {m['n']}) - {m['s3']} * {m['s3']})"
    two = f"CASE WHEN {m['n']} >= 2 THEN"
    stats = {
        "mean": m["mean"], "std": m["std"], "min": m["min"], "max": m["max"], "delta": f"{two} {m['last']} - {m['first']} END", "slope": f"{two} {m['slope']} END",
        "intercept": f"{two} {m['at_mid']} - {m['slope']} * {mid}D END", "r2": f"CASE WHEN {m['n']} >= 2 AND {m['std']} > 0 THEN {m['r2']} END",
        "curvature": f"CASE WHEN {m['n']} >= 3 AND abs({below}) > 1e-9 THEN ({m['s2']} * {m['d2']} - {m['s3']} * {m['d1']}) / {below} END",
    }
    return Derived({key(k): c for k, c in texts.items()}, {f"{signal}_{k}_{lo}_{hi}": c for k, c in stats.items()})


def window_stats(rows: DataFrame, entity: str, step: str, signal: str, windows: list[tuple[int, int]], samples: DataFrame | None = None) -> DataFrame:
    """Mean, population deviation, extremes, last less first, line fit and curvature of the per-step means in each
    inclusive window, all windows in one pass. One row an entity; the curvature is the leading coefficient of the
    quadratic fit. An entity whose signal is missing throughout takes the samples' means, if there are samples."""
    series = per_step_mean(rows, entity, step, [signal]) if samples is None else with_raw_series(rows, samples, entity, step, [signal])
    made = Derived()
    for lo, hi in dict.fromkeys(map(tuple, windows)):
        made |= window_columns(signal, step, lo, hi)
    return made.of(series, entity)


def delta_columns(signal: str, step: str, pairs: list[tuple[int, int]], how: list[str], eps: float = 1e-12) -> Derived:
    """A later step's mean against an earlier one's: difference, ratio, relative or log; an unknown name is the difference."""
    made = Derived()
    for first, second in pairs:
        (na, ta), (nb, tb) = step_value(signal, step, first), step_value(signal, step, second)
        a, b, e = _name(na), _name(nb), f"{eps!r}D"
        texts = {"ratio": f"try_divide({b}, {a} + {e})", "relative": f"try_divide({b} - {a}, abs({a}) + {e})", "log": f"log10(abs({b} - {a}) + {e})"}
        made |= Derived({na: ta, nb: tb}, {f"{signal}_{h}_{first}_{second}": texts.get(h, f"{b} - {a}") for h in how})
    return made


def step_delta(rows: DataFrame, entity: str, step: str, signal: str, pairs: list[tuple[int, int]], how: list[str], eps: float = 1e-12) -> DataFrame:
    """The later step's value against the earlier one's; null if either is missing."""
    return delta_columns(signal, step, pairs, how, eps).of(rows.where(F.col(step).isNotNull()), entity)


def last_up_to(rows: DataFrame, entity: str, step: str, signal: str, upto: int) -> DataFrame:
    """(entity, value): the last finite per-step mean at or before a step."""
    series = per_step_mean(rows.where(F.col(step) <= upto), entity, step, [signal])
    return series.groupBy(entity).agg(last_by(signal, step).alias("value"))


def first_array(rows: DataFrame, keys: list[str], array: str, order: str) -> DataFrame:
    """(keys, array): the first array that is not null of each group, in ``order``."""
    return rows.groupBy(*keys).agg(F.min_by(array, F.when(F.col(array).isNotNull(), F.col(order))).alias(array))


def nth_value(rows: DataFrame, entity: str, order: str, signal: str, places: list[int]) -> DataFrame:
    """The values at zero-based places of an entity's rows in ``order``; null where the place is beyond them."""
    at = rows.withColumn("_i", F.row_number().over(Window.partitionBy(entity).orderBy(order)) - 1)
    return at.groupBy(entity).agg(*[F.max(F.when(F.col("_i") == k, F.col(signal))).alias(f"{signal}_{k}") for k in places])


def chosen_alias(rows: DataFrame, entity: str, names: list[str], out: str) -> DataFrame:
    """``rows`` with ``out``: per entity the first of ``names`` that has any finite value, else the first; and which."""
    own = Window.partitionBy(entity)
    value, which = finite(names[0]), F.lit(names[0])
    for n in reversed(names):
        has = F.count(finite(n)).over(own) > 0
        value, which = F.when(has, finite(n)).otherwise(value), F.when(has, F.lit(n)).otherwise(which)
    return rows.withColumn(out, value).withColumn(f"{out}_from", which)


def capacity_summary(rows: DataFrame, entity: str, step: str, signal: str, upto: int, at: list[int], early: int = 2, late: int = 91) -> DataFrame:
    """Values at chosen steps, range and fade of a signal up to a step, and line fits of its early and late rows.

    Where the last step is missing, the last one before it stands in for it.
    """
    part = rows.where(F.col(step) <= upto).select(entity, step, finite(signal).alias("v")).where("v IS NOT NULL")
    start = late if upto >= late else max(2, upto - 9)
    mean = lambda c: F.avg(F.when(F.col(step) == c, F.col("v")))
    within = lambda lo: F.when(F.col(step) >= lo, F.col("v"))
    last = F.avg(F.when(F.col(step) == F.col("last_step"), F.col("v")))
    firsts = [F.avg(F.when(F.col(step) == F.col("first_step"), F.col("v"))).alias("first"), last.alias("last")]
    own = Window.partitionBy(entity)
    part = part.withColumn("first_step", F.min(step).over(own)).withColumn("last_step", F.max(step).over(own))
    out = part.groupBy(entity).agg(
        *[mean(c).alias(f"at_{c}") for c in at],
        F.max("v").alias("max"), (F.max("v") - mean(2)).alias("max_less_2"), (F.coalesce(mean(upto), last) - mean(10)).alias("last_less_10"),
        slope(within(early), step).alias("early_slope"), intercept(within(early), step).alias("early_intercept"),
        slope(within(start), step).alias("late_slope"), intercept(within(start), step).alias("late_intercept"),
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), *firsts,
    )
    return out.withColumn("fade", F.col("first") - F.col("last")).withColumn("fade_share", F.try_divide(F.col("first") - F.col("last"), F.col("first")))


def first_crossing(rows: DataFrame, entity: str, step: str, signal: str, share: float = 0.8) -> DataFrame:
    """The 1-based position of the first value below ``share`` of the second one (of the only one), else the length."""
    own = Window.partitionBy(entity).orderBy(step)
    series = per_step_mean(rows, entity, step, [signal]).where(F.col(signal).isNotNull())
    placed = series.withColumn("i", F.row_number().over(own))
    every = Window.partitionBy(entity)
    base = F.coalesce(F.max(F.when(F.col("i") == 2, F.col(signal))).over(every), F.max(F.when(F.col("i") == 1, F.col(signal))).over(every))
    return placed.withColumn("base", base).groupBy(entity).agg(F.coalesce(F.min(F.when(F.col(signal) < share * F.col("base"), F.col("i"))), F.max("i")).cast("long").alias("life"))


def heuristic_features(rows: DataFrame, entity: str, step: str, signal: str) -> DataFrame:
    """First, second and last value, line slope, largest drop and rise between neighbours, mean, deviation, least."""
    series = per_step_mean(rows, entity, step, [signal]).where(F.col(signal).isNotNull())
    own = Window.partitionBy(entity).orderBy(step)
    gone = series.withColumn("i", F.row_number().over(own)).withColumn("d", F.col(signal) - F.lag(signal).over(own))
    zero = lambda c, n: F.coalesce(c, F.lit(0.0)).alias(n)
    return gone.groupBy(entity).agg(
        zero(first_by(signal, step), "q0"), zero(F.max(F.when(F.col("i") == 2, F.col(signal))), "q1"), zero(last_by(signal, step), "qn"), zero(slope(signal, step), "slope"),
        zero(F.max("d"), "max_diff"), zero(F.min("d"), "min_diff"), zero(F.avg(signal), "mean"), zero(F.stddev_pop(signal), "std"), zero(F.min(signal), "min"),
    )


def step_convention(rows: DataFrame, entity: str, step: str) -> DataFrame:
    """Whether an entity's steps count from zero or one."""
    lo = F.min(step)
    named = F.when(lo == 0, "raw_zero_based").when(lo == 1, "raw_one_based").otherwise("unknown")
    return rows.groupBy(entity).agg(named.alias("convention"), lo.alias("first_step"), F.max(step).alias("last_step"))

