"""Evaluation of a candidate model: what it may see, whether its predictions are whole, and how they score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import finite
from .limits import limited
from .metrics import diagnostics, regression_metrics
from .relational import anonymised, missing_and_extra

# Columns that identify an entity or give its label away, those of the protocol, those of a step.
IDENTIFIERS = {
    "cell_id", "original_cell_id", "batch_id", "original_batch_id", "barcode", "source_path", "file_path", "filename", "path", "channel", "cycle_life", "Lifetime", "protocol_readable", "policy_readable",
}
PROTOCOL = {"cc1", "cc2", "cc3", "cc4", "C1", "C2", "C3", "C4"}
STEP_COLUMNS = ("cycle_index", "discharge_capacity", "charge_capacity")
LABELS = {"y", "label", "target"}
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMBERS or t.startswith("decimal")]


def aliases(*tables: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, cell_id): an alias for every id of the tables, numbered in the order of their texts."""
    ids = None
    for t in tables:
        one = t.select(key)
        ids = one if ids is None else ids.unionByName(one)
    return anonymised(ids, key, "cell_id")


def with_alias(df: DataFrame, names: DataFrame, key: str = "row_id") -> DataFrame:
    """``df`` with its alias in place of ``cell_id``; a row whose id has none raises when it is read."""
    lacking = F.raise_error(F.concat(F.lit(f"no alias for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    both = df.drop("cell_id").join(names.withColumnRenamed("cell_id", "_alias"), key, "left")
    rest = [c for c in both.columns if c not in (key, "_alias")]
    return both.select(key, F.coalesce("_alias", lacking.cast("string")).alias("cell_id"), *rest)


def sanitised_metadata(df: DataFrame, names: DataFrame, protocol: bool = False, key: str = "row_id") -> DataFrame:
    """The key, the alias and the numbers that give nothing away."""
    blocked = IDENTIFIERS | (set() if protocol else PROTOCOL)
    return with_alias(df.select(key, *[c for c in numeric(df) if c != key and c not in blocked]), names, key)


def sanitised_steps(df: DataFrame, names: DataFrame, key: str = "row_id") -> DataFrame:
    """The key, the alias, the step columns (null where missing) and other numbers that give nothing away."""
    blocked = IDENTIFIERS | LABELS | PROTOCOL
    own = [F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in STEP_COLUMNS]
    return with_alias(df.select(key, *own, *[c for c in numeric(df) if c not in {key, *STEP_COLUMNS} | blocked]), names, key)


def sanitised_labels(df: DataFrame, names: DataFrame, key: str = "row_id") -> DataFrame:
    return with_alias(df.select(key, "y"), names, key)


def finite_labels(df: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, y, ...): labels that are finite; ``cycle_life`` stands for y where that is missing."""
    named = df.withColumnRenamed("cycle_life", "y") if "y" not in df.columns else df
    return named.withColumn("y", finite(F.col("y").try_cast("double"))).where("y IS NOT NULL")


def label_sources(*tables: DataFrame) -> dict:
    """The distinct label sources of the tables and what they say of the labels."""
    found = set()
    for t in tables:
        if "label_source" in t.columns:
            found |= {r[0] for r in t.select(F.col("label_source").cast("string")).where("label_source IS NOT NULL").distinct().collect()}  # a few names
    return {"label_sources": sorted(found), "label_source": ",".join(sorted(found)), "measured": "true_measured_cycle_life" in found, "predicted": "author_model_prediction" in found}


def train_and_validation(labels: DataFrame, assignments: DataFrame | None = None, key: str = "row_id") -> DataFrame:
    """(key, split): the table's train and validation rows; without both, the last quarter of the sorted ids validates."""
    ids = labels.select(key).distinct()
    if assignments is not None:
        name = F.lower(F.col("split").cast("string"))
        own = assignments.join(ids, key, "left_semi").select(key, F.when(name == "train", "train").when(name.isin("val", "validation"), "validation").alias("split")).where("split IS NOT NULL")
        if own.select("split").distinct().count() == 2:
            return own
    n = ids.count()
    if n < 2:
        raise ValueError("at least two labelled rows are needed")
    from .relational import ranked

    n_val = max(1, round(n * 0.25))
    return ranked(ids, [key], "_i").select(key, F.when(F.col("_i") >= n - n_val, "validation").otherwise("train").alias("split"))


def prediction_problems(expected: DataFrame, got: DataFrame, key: str = "row_id", value: str = "y_pred") -> DataFrame:
    """(key, what): ids without a prediction, unknown ids, ids with several, and predictions that are not finite."""
    number = F.col(value).try_cast("double") if dict(got.dtypes)[value] == "string" else F.col(value)
    bad = got.where(finite(number).isNull()).select(key, F.lit("non-finite").alias("what"))
    return missing_and_extra(expected, got, key).unionByName(bad)


@dataclass
class Evaluation:
    """The outcome of a candidate: its metrics and predictions, or why it failed."""

    success: bool
    metrics: dict = field(default_factory=dict)
    predictions: DataFrame | None = None
    error_type: str | None = None
    reason: str | None = None


#: A candidate: (train metadata, steps, labels, test metadata, steps) -> (row_id or cell_id, y_pred).
Candidate = Callable[[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame], DataFrame]


def evaluated_candidate(candidate: Candidate, train: tuple[DataFrame, DataFrame, DataFrame], test: tuple[DataFrame, DataFrame, DataFrame], upto: int = 100, protocol: bool = False, weak: float | None = None, strong: float | None = None, key: str = "row_id", limit: float | None = None) -> Evaluation:
    """Run a candidate on sanitised tables and score its predictions against the hidden labels, within ``limit`` seconds.

    ``train`` and ``test``: metadata, steps, labels. The candidate sees aliases, steps up to ``upto`` and the training
    labels only. Predictions by alias are traced back; any that are missing, unknown, repeated or not finite fail it, as
    does a run that takes longer: its jobs are stopped.
    """
    try:
        return limited(train[0].sparkSession, lambda: _evaluated(candidate, train, test, upto, protocol, weak, strong, key), limit)
    except TimeoutError as e:
        return Evaluation(False, error_type="TimeoutError", reason=f"the candidate {e}")


def _evaluated(candidate: Candidate, train: tuple[DataFrame, DataFrame, DataFrame], test: tuple[DataFrame, DataFrame, DataFrame], upto: int, protocol: bool, weak: float | None, strong: float | None, key: str) -> Evaluation:
    early = lambda c: c.where(F.col("cycle_index") <= upto)
    tables = [train[0], early(train[1]), train[2], test[0], early(test[1]), test[2]]
    names = aliases(*tables, key=key).persist()  # read by every table; so are the predictions by every check
    held = [names]
    try:
        got = candidate(
            sanitised_metadata(tables[0], names, protocol, key), sanitised_steps(tables[1], names, key), sanitised_labels(tables[2], names, key),
            sanitised_metadata(tables[3], names, protocol, key), sanitised_steps(tables[4], names, key),
        )
        if "y_pred" not in got.columns:
            return Evaluation(False, error_type="PredictionValidationError", reason="predictions need y_pred")
        if key in got.columns:
            got = got.select(key, "y_pred")
        elif "cell_id" in got.columns:
            traced = got.select("cell_id", "y_pred").join(names, "cell_id", "left")
            if not traced.where(F.col(key).isNull()).isEmpty():
                return Evaluation(False, error_type="PredictionValidationError", reason="unknown cell_id")
            got = traced.select(key, "y_pred")
        else:
            return Evaluation(False, error_type="PredictionValidationError", reason=f"predictions need {key} or cell_id")
        got = got.persist()
        held.append(got)
        expected = finite_labels(tables[5], key).select(key, "y")
        problems = prediction_problems(expected, got, key)
        counts = {r.what: r.n for r in problems.groupBy("what").agg(F.count("*").alias("n")).collect()}  # at most four rows
        if counts:
            return Evaluation(False, error_type="PredictionValidationError", reason="; ".join(f"{n} {what}" for what, n in sorted(counts.items())))
        scored = expected.join(got.select(key, F.col("y_pred").cast("double").alias("y_pred")), key).persist()
        held.append(scored)
        row = regression_metrics(scored).crossJoin(scored.agg(*diagnostics())).first()  # single rows
    except Exception as e:
        return Evaluation(False, error_type=type(e).__name__, reason=str(e).splitlines()[0] if str(e) else type(e).__name__)
    finally:
        for h in held:
            h.unpersist()
    metrics = row.asDict()
    gain = None if weak is None or strong is None or weak == strong else (weak - metrics["rmse"]) / (weak - strong)
    return Evaluation(True, metrics | {"gain": gain}, scored)


@dataclass
class HiddenEvaluator:
    """Holds all tables and which ids train, validate and test; candidates are run on one split at a time."""

    metadata: DataFrame
    steps: DataFrame
    labels: DataFrame
    splits: DataFrame
    upto: int = 100
    protocol: bool = False
    weak: float | None = None
    strong: float | None = None
    key: str = "row_id"
    limit: float | None = None

    def part(self, split: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        ids = self.splits.where(F.col("split") == split).select(self.key)
        return tuple(t.join(ids, self.key, "left_semi") for t in (self.metadata, self.steps, self.labels))

    def evaluate(self, candidate: Candidate, split: str = "validation") -> Evaluation:
        return evaluated_candidate(candidate, self.part("train"), self.part(split), self.upto, self.protocol, self.weak, self.strong, self.key, self.limit)


def weak_baseline(train: DataFrame, test: DataFrame, y: str = "y") -> DataFrame:
    """One row: the metrics of predicting the training mean, over finite labels; null where either side has none."""
    mean = train.agg(F.avg(finite(y)).alias("_m"))
    both = test.select(finite(y).alias("y")).where("y IS NOT NULL").crossJoin(F.broadcast(mean))  # one row
    d = F.col("_m") - F.col("y")
    mape = F.avg(F.when(F.col("y") > 0, F.abs(d) / F.col("y")))
    return both.agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), mape.alias("mape"), (mape * 100).alias("error_pct"))


def with_metadata(predictions: DataFrame, metadata: DataFrame, order: Column | str, key: str = "row_id") -> DataFrame:
    """Predictions left-joined to the first metadata row of each id; columns that both have get the suffix ``_meta``."""
    first = metadata.groupBy(key).agg(F.min_by(F.struct(*[c for c in metadata.columns if c != key]), order).alias("m"))
    cols = [F.col(f"m.{c}").alias(f"{c}_meta" if c in predictions.columns else c) for c in metadata.columns if c != key]
    return predictions.join(first, key, "left").select(*predictions.columns, *cols)




def holdout(metadata: DataFrame, steps: DataFrame, labels: DataFrame, batch: str, locked: str, upto: int = 100, excluded: DataFrame | None = None, key: str = "row_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The locked batch's tables: finite labels only, steps 1 to ``upto``, without excluded ids, ids anonymised."""
    own = metadata.where(F.col(batch) == locked)
    if excluded is not None:
        own = own.join(excluded.select(key).distinct(), key, "left_anti")
    known = finite_labels(labels, key).join(own.select(key), key, "left_semi")
    own = own.join(known.select(key), key, "left_semi")
    early = steps.where(F.col("cycle_index").between(1, upto)).join(own.select(key), key, "left_semi")
    names = aliases(own, key=key)
    return sanitised_metadata(own, names, True, key), sanitised_steps(early, names, key), sanitised_labels(known, names, key)
