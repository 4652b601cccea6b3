"""All early features of an entity in one table: capacity summary, response difference, protocol, ready feature tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import finite, g1_skew
from ..operators import protocol
from ..operators.protocol import log10_abs_agg, numbers_of
from .program import pruned

# Key columns by preference, steps of the capacity features, names that a column may have.
KEYS = ("row_id", "cell_id")
CAPACITY_STEPS = (1, 2, 10, 50, 95, 98, 100)
RESPONSES = ("Qdlin", "qdlin", "q_dlin", "discharge_capacity_curve")
AXES = ("Vdlin", "vdlin", "v_dlin", "voltage_curve")
CURRENTS = {"C1": ("C1", "cc1"), "C2": ("C2", "cc2"), "C3": ("C3", "cc3"), "C4": ("C4", "cc4")}


def key_column(columns: list[str]) -> str:
    """The first key column there is."""
    for c in KEYS:
        if c in columns:
            return c
    raise ValueError("a table needs row_id or cell_id")


def capacity_features(rows: DataFrame, upto: int = 100) -> DataFrame:
    """(key, capacity features) of (key, cycle_index, discharge_capacity) rows up to a step, in one pass.

    The last step falls back to the last one before it that has a value; a null key is an entity of its own.
    """
    key = key_column(rows.columns)
    step, v = finite("cycle_index"), finite("discharge_capacity")
    r = rows.select(key, step.alias("c"), v.alias("v")).where(f"c IS NOT NULL AND c <= {int(upto)}")
    means = r.groupBy(key, "c").agg(F.avg("v").alias("m"), F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.max("v").alias("hi"), F.min("v").alias("lo"))
    # a line through the raw rows is one through the steps' means, each counted as often as it has rows
    late = 91 if upto >= 91 else max(2, upto - 9)

    def fit(lo: int) -> tuple[Column, Column]:
        w = F.when(F.col("c") >= lo, F.col("n"))
        n, x, y = F.sum(w), F.sum(w * F.col("c")), F.sum(F.when(F.col("c") >= lo, F.col("s")))
        xx, xy = F.sum(w * F.col("c") * F.col("c")), F.sum(F.when(F.col("c") >= lo, F.col("c") * F.col("s")))
        below = n * xx - x * x
        k = F.when((n >= 2) & (below > 0), (n * xy - x * y) / below)
        return k, F.when(k.isNotNull(), (y - k * x) / n)

    at = lambda c: F.max(F.when(F.col("c") == c, F.col("m")))
    last, first = F.max_by("m", F.when(F.col("n") > 0, F.col("c"))), F.min_by("m", F.when(F.col("n") > 0, F.col("c")))
    n = F.sum("n")
    (k1, i1), (k2, i2) = fit(2), fit(late)
    mean = F.sum("s") / F.nullif(n, F.lit(0))
    out = means.groupBy(key).agg(
        *[at(c).alias(f"capacity_cycle_{c}") for c in CAPACITY_STEPS],
        F.max("hi").alias("capacity_max_first_n"), (F.max("hi") - at(2)).alias("capacity_max_minus_cycle_2"), (F.coalesce(at(upto), last) - at(10)).alias("capacity_cycle_n_minus_cycle_10"),
        k1.alias("capacity_slope_cycle_2_to_n"), i1.alias("capacity_intercept_cycle_2_to_n"), k2.alias("capacity_late_slope"), i2.alias("capacity_late_intercept"),
        mean.alias("capacity_mean_first_n"), F.sqrt(F.greatest(F.lit(0.0), F.sum("q") / F.nullif(n, F.lit(0)) - mean * mean)).alias("capacity_std_first_n"),
        F.min("lo").alias("capacity_min_first_n"), F.max("hi").alias("capacity_max_stat_first_n"), first.alias("capacity_first"), last.alias("capacity_last"),
    )
    gone = F.col("capacity_first") - F.col("capacity_last")
    out = out.withColumn("capacity_first_minus_last", gone).withColumn("capacity_fractional_fade", F.try_divide(gone, F.col("capacity_first")))
    return out


def difference_features(rows: DataFrame, upto: int = 100, early: int = 10, order: str | None = None) -> DataFrame:
    """(key, features of the response at the last step less that at an early one).

    Of several arrays of a step the first in ``order`` counts, without an order the least one.

    Arrays of equal length are compared place by place. Without them, or where they are missing for an entity, the
    difference of the per-step capacities stands in; its features carry ``approx_``.
    """
    key = key_column(rows.columns)
    q = next((c for c in RESPONSES if c in rows.columns), None)
    v = next((c for c in AXES if c in rows.columns), None)
    step = finite("cycle_index")
    names = ("qdiff_n_10", "log_abs_qdiff_min", "log_abs_qdiff_mean", "log_abs_qdiff_var", "log_abs_qdiff_skew", "log_sum_abs_qdiff", "log_sum_sq_qdiff", "log_abs_energy_diff")

    def stats(flat: DataFrame, prefix: str) -> DataFrame:
        d = F.col("d")
        made = [F.avg(d), log10_abs_agg(F.min(d)), log10_abs_agg(F.avg(d)), log10_abs_agg(F.var_pop(d)), log10_abs_agg(g1_skew("d")), log10_abs_agg(F.sum(F.abs(d))), log10_abs_agg(F.sum(d * d)), log10_abs_agg(F.max("e"))]
        return flat.where("d IS NOT NULL").groupBy(key).agg(*[c.alias(prefix + n) for c, n in zip(made, names)])

    series = rows.select(key, step.alias("c"), finite("discharge_capacity").alias("m")).where(f"c IS NOT NULL AND c <= {int(upto)}").groupBy(key, "c").agg(F.avg("m").alias("m"))
    a, z = F.max(F.when(F.col("c") == early, F.col("m"))), F.max(F.when(F.col("c") == upto, F.col("m")))
    last = F.max_by("m", F.when(F.col("m").isNotNull(), F.col("c")))
    scalar = series.groupBy(key).agg((F.coalesce(z, last) - a).alias("d")).withColumn("e", F.col("d"))
    if not q:
        return stats(scalar, "approx_")
    as_array = lambda c: F.transform(F.col(c), lambda x: x.cast("double")) if dict(rows.dtypes)[c].startswith("array") else numbers_of(c)
    some = rows.select(key, step.alias("c"), as_array(q).alias("q"), (as_array(v) if v else F.lit(None).cast("array<double>")).alias("v"), *([F.col(order).alias("order")] if order else [])).where(F.col("c").isin(float(early), float(upto)))
    place = (lambda c: F.struct("order", c)) if order else (lambda c: F.col(c))
    firsts = some.groupBy(key, "c").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), place(c))).alias(c) for c in ("q", "v")])
    pick = lambda c, n: F.max(F.when(F.col("c") == c, F.col(n)))
    both = firsts.groupBy(key).agg(pick(early, "q").alias("q1"), pick(upto, "q").alias("q2"), pick(early, "v").alias("v1"), pick(upto, "v").alias("v2"))
    both = both.where("size(q1) > 0 AND size(q1) = size(q2)")
    area = lambda y, x: F.aggregate(F.sequence(F.lit(1), F.size(y) - 1), F.lit(0.0), lambda t, i: t + (F.get(y, i) + F.get(y, i - 1)) / 2 * (F.get(x, i) - F.get(x, i - 1)))
    fits = (F.size("v1") == F.size("q1")) & (F.size("v2") == F.size("q2")) & (F.size("q1") > 1)
    energy = F.when(fits, area(F.col("q1"), F.col("v1")) - area(F.col("q2"), F.col("v2")))
    arrays = both.select(key, energy.alias("e"), F.explode(F.zip_with("q1", "q2", lambda x, y: y - x)).alias("d"))
    rest = scalar.join(both.select(key), key, "left_anti")
    return stats(arrays, "").join(stats(rest, "approx_"), key, "full_outer")


def protocol_columns(metadata: DataFrame, order: str | None = None) -> DataFrame:
    """(key, currents, their mean, most and variance, products of neighbours). Of several rows of a key the first in
    ``order`` counts, without an order the one with the least currents."""
    key = key_column(metadata.columns)
    names = {c: next((a for a in alias if a in metadata.columns), None) for c, alias in CURRENTS.items()}
    some = [(finite(a) if a else F.lit(None).cast("double")).alias(c) for c, a in names.items()]
    first = F.struct(*([F.col(order)] if order else []), *some)
    rows = metadata.groupBy(key).agg(F.min(first).alias("_r")).select(key, *[F.col(f"_r.{c}") for c in names])
    out = protocol.protocol_features(rows, key, list(CURRENTS), products=True)
    out = out.withColumnsRenamed({"protocol_mean": "protocol_current_mean", "protocol_max": "protocol_current_max", "protocol_var": "protocol_current_variance"})
    return out.withColumnsRenamed({f"{a}_x_{b}": f"protocol_{a.lower()}_{b.lower()}" for a, b in zip(list(CURRENTS), list(CURRENTS)[1:])})


@dataclass
class FeatureTable:
    """A ready feature table: its rows by key, what is known of its columns (feature, family), and its name."""

    name: str
    rows: DataFrame
    about: DataFrame | None = None


def selected_tables(tables: list[FeatureTable], families: list[str] | None = None) -> list[tuple[DataFrame, dict[str, str]]]:
    """Per table its key and chosen columns, and their families; a name that an earlier table has gets the table's name."""
    seen, out = set(), []
    for t in tables:
        key = key_column(t.rows.columns)
        known = {r.feature: r.family for r in t.about.select("feature", "family").distinct().collect()} if t.about is not None else {}  # a row a column
        names = [c for c in t.rows.columns if c not in KEYS and (not families or not known or known.get(c) in families)]
        new = {c: f"{t.name}_{c}" if c in seen else c for c in names}
        seen |= set(new.values())
        out.append((t.rows.select(key, *[finite(c).alias(n) for c, n in new.items()]), {n: known.get(c, "other") for c, n in new.items()}))
    return out


def all_features(metadata: DataFrame, cycles: DataFrame, upto: int = 100, with_protocol: bool = True, tables: list[FeatureTable] = [], families: list[str] | None = None, prune: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """(key, features) of every entity that any part has, outer-joined; and each feature's family.

    Of columns of one name the first part's is kept; columns without any value are dropped in one counting pass.
    """
    key = key_column(cycles.columns)
    difference = difference_features(cycles, upto)
    parts = [(capacity_features(cycles, upto), "capacity_summary"), (difference, "curve_difference_approximate")]
    if with_protocol:
        parts.append((protocol_columns(metadata), "protocol"))
    every = [(f, {c: family for c in f.columns if c != key}) for f, family in parts] + selected_tables(tables, families)
    out, about = None, {}
    for f, own in every:
        if key not in f.columns:
            raise ValueError(f"a feature table lacks the key {key}")
        new = [c for c in f.columns if c != key and c not in about]
        about |= {c: own[c] for c in new}
        f = f.select(key, *new)
        out = f if out is None else out.join(f, key, "full_outer")
    if prune:
        out = pruned(out, [key])
    return out, {c: about[c] for c in out.columns if c != key}
