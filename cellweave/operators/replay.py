"""Around a replayed linear predictor: batch settings, protocols in file names, outputs in cycles, checks of their scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import finite
from .order_stats import medians
from .relational import reason_counts, split_by_reasons

# The last step and the model file of a batch, by its name; all others have the defaults.
CUTOFFS, CUTOFF = {"oed1": 98, "oed4": 95}, 100
MODELS, MODEL = {"oed1": "oed_model_batch1.mat"}, "oed_model.mat"
CURRENTS = ("C1", "C2", "C3", "C4")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _by_name(name: str | Column, known: dict, default) -> Column:
    out = F.lit(default)
    for k, v in known.items():
        out = F.when(_col(name) == k, F.lit(v)).otherwise(out)
    return out


def cutoff(batch: str | Column) -> Column:
    return _by_name(batch, CUTOFFS, CUTOFF)


def model_file(batch: str | Column) -> Column:
    return _by_name(batch, MODELS, MODEL)


def batch_names(folders: list[str], given: list[str] | None = None) -> dict[str, str]:
    """Batch folders, in the order of their names, to oed1, oed2, ...; ``given`` has folder=name items that go before."""
    named = {f: f"oed{i + 1}" for i, f in enumerate(sorted(folders))}
    for item in given or []:
        if "=" not in item:
            raise ValueError(f"not a folder=name item: {item}")
        folder, name = item.split("=", 1)
        named[folder] = name
    return named


def validation_status(included: Column, folder: Column, archive: Column) -> Column:
    """What became of the locked batch: asked for or not, its folder and its archive there or not."""
    skipped = F.when(archive, "skipped_archive_present").when(folder, "skipped_by_default").otherwise("skipped_missing")
    return F.when(included & folder, "included").when(included, "failed").otherwise(skipped)


def protocol_of_path(path: str | Column) -> Column:
    """The four currents that a schedule file's name tells, joined by dashes; null without four."""
    stem = F.regexp_replace(F.element_at(F.split(_col(path), r"[/\\]"), -1), r"\.sdu$", "")
    stem = F.when(F.instr(stem, "-") > 0, F.substring(stem, F.instr(stem, "-") + 1, F.length(stem))).otherwise(stem)
    parts = F.split(F.regexp_replace(F.replace(stem, F.lit("pt"), F.lit(".")), "_", "-"), "-")
    return F.when(F.size(parts) >= 4, F.array_join(F.slice(parts, 1, 4), "-"))


def currents_of(protocol: str | Column) -> list[Column]:
    """C1 to C4 of a protocol's text; all null where any of the four is no number."""
    parts = F.transform(F.slice(F.split(_col(protocol), "-"), 1, 4), lambda x: x.try_cast("double"))
    whole = (F.size(parts) == 4) & F.forall(parts, lambda x: x.isNotNull())
    return [F.when(whole, F.get(parts, F.lit(i))).alias(c) for i, c in enumerate(CURRENTS)]


def in_cycles(raw: str | Column, se: str | Column, transform: str | Column) -> list[Column]:
    """Prediction and bounds in cycles; where the output is the logarithm of the inverse, the bounds change places."""
    x, s, t = _col(raw), _col(se), _col(transform)
    ten = lambda e: F.pow(F.lit(10.0), e)
    direct, inverse = t == "direct", t == "inverse"
    unknown = F.raise_error(F.concat(F.lit("no such transform: "), F.coalesce(t, F.lit("null")))).cast("double")
    pick = lambda a, b: F.when(direct, a).when(inverse, b).otherwise(unknown)
    return [pick(ten(x), ten(-x)).alias("prediction"), pick(ten(x - s), ten(-(x + s))).alias("ci_lo"), pick(ten(x + s), ten(-(x - s))).alias("ci_hi")]


def finite_stats(rows: DataFrame, columns: dict[str, str | Column]) -> DataFrame:
    """One row: least, median and largest of each named column's finite values."""
    ends = rows.agg(*[f(finite(c)).alias(f"{n}_{f.__name__}") for n, c in columns.items() for f in (F.min, F.max)])
    return ends.crossJoin(F.broadcast(medians(rows, [], {f"{n}_median": c for n, c in columns.items()})))  # one row


def scale_diagnostics(rows: DataFrame, widest: float = 2000.0) -> DataFrame:
    """One row: the spread of raw outputs, of both readings of them, of predictions and bounds, and two counts."""
    ten = F.pow(F.lit(10.0), finite("raw"))
    p, w = finite("prediction"), finite("ci_width")
    spread = finite_stats(rows, {"raw": "raw", "direct": ten, "inverse": F.try_divide(F.lit(1.0), ten), "prediction": F.when(p > 0, p), **{c: c for c in ("ci_lo", "ci_hi", "ci_width")}})
    return spread.crossJoin(rows.agg(F.count_if(w > widest).alias("n_wide"), F.count_if(p <= 0).alias("n_not_positive")))  # one row


def prediction_summary(rows: DataFrame, status: str = "status") -> DataFrame:
    """One row of counts: rows, whole features, finite, usable and anomalous predictions."""
    p = finite("prediction")
    return rows.agg(
        F.count("*").alias("n_rows"), F.count_if(F.coalesce(F.col(status), F.lit("")) != "unavailable").alias("n_features"), F.count_if(p.isNotNull()).alias("n_finite"),
        F.count_if(p > 0).alias("n_usable"), F.count_if(F.coalesce("anomaly", F.lit(False))).alias("n_anomalous"), F.count_if(F.col(status) == "unavailable").alias("n_unavailable"),
    )


def acquisition_input(rows: DataFrame, low: float = 100.0, high: float = 5000.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(C1..C4, prediction) of the usable rows, the others with their reasons, and how often each reason is met.

    A median prediction outside ``low`` to ``high`` is not in cycles and raises.
    """
    p = finite("prediction")
    checks = {f"nonfinite_{c}": finite(c).isNull() for c in CURRENTS} | {"nonfinite_prediction": p.isNull(), "prediction_le_0": p <= 0, "anomalous": F.coalesce(F.col("anomaly"), F.lit(False))}
    good, bad = split_by_reasons(rows, checks)
    median = medians(good, [], {"m": "prediction"}).first().m
    if median is not None and not low < median < high:
        raise ValueError(f"the median prediction {median:g} is not in cycles")
    return good.select(*CURRENTS, "prediction"), bad, reason_counts(bad)


def checked_model(mu, sigma, beta, picked, design) -> dict:
    """A linear predictor's parts with their shapes checked; ``picked`` counts from one and is returned from zero."""
    import numpy as np

    mu, sigma, beta, design = (np.asarray(x, float) for x in (mu, sigma, beta, design))
    picked = np.asarray(picked, int).ravel() - 1
    mu, sigma, beta = mu.ravel(), sigma.ravel(), beta.ravel()
    if len(mu) != len(sigma):
        raise ValueError("as many means as deviations are needed")
    if len(picked) != len(beta) or (len(picked) and (picked.min() < 0 or picked.max() >= len(mu))):
        raise ValueError("each coefficient needs a feature that there is")
    if design.ndim != 2 or design.shape[0] != design.shape[1] or design.shape[0] != len(picked) + 1:
        raise ValueError("the design matrix needs a row and column for each picked feature and the intercept")
    return {"mu": mu.tolist(), "sigma": sigma.tolist(), "beta": beta.tolist(), "picked": picked.tolist(), "inverse": np.linalg.inv(design).tolist()}


def author_metrics(ranking: DataFrame) -> DataFrame:
    """One row: the errors of early predictions against observed means, over protocols that have both."""
    both = ranking.select(finite("mean").alias("y"), finite("early").alias("p")).where("y IS NOT NULL AND p IS NOT NULL")
    return both.agg(F.count("*").alias("n"), F.sqrt(F.avg((F.col("p") - F.col("y")) ** 2)).alias("rmse"), F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae"))
