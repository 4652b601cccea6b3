"""Linear models from sufficient statistics: one pass over the rows sums products, and everything else follows from the sums.

For each fold the sums of all products of features and labels are added up, as centred partial sums of each partition. They
give any union of folds its means, deviations and covariances, so standardising, ridge, whole penalty paths of lasso and
elastic net, the errors on the folds left out, and validation scores take no further pass. Many specifications over the same
features share one set of sums: a part of the features is a part of the matrix, another label another row of it.

What reaches the driver are matrices of features by features, one a fold; they do not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import finite
from .order_stats import medians
from .relational import ranked

#: The fold of rows that are kept for validation.
VALIDATION = -1


@dataclass
class Sums:
    """Of some rows: how many, the means of all columns, and the sums of products of their deviations from the means."""

    n: float
    mean: np.ndarray
    cross: np.ndarray

    def __add__(self, other: Sums) -> Sums:
        n = self.n + other.n
        if not n:
            return self
        gap = other.mean - self.mean
        return Sums(n, self.mean + gap * (other.n / n), self.cross + other.cross + np.outer(gap, gap) * (self.n * other.n / n))

    def part(self, places: list[int]) -> Sums:
        return Sums(self.n, self.mean[places], self.cross[np.ix_(places, places)])

    def about(self, point: np.ndarray) -> np.ndarray:
        """Sums of products of the deviations from ``point``."""
        gap = self.mean - point
        return self.cross + self.n * np.outer(gap, gap)


def positional_folds(rows: DataFrame, order: str, cv: int, fold: str = "fold", keep: Column | None = None) -> DataFrame:
    """``rows`` with a fold by position: ``cv`` runs of neighbouring rows in ``order``, which is unique, the first ones longer
    by one where they cannot be equal. Rows for which ``keep`` does not hold are in no run and have the fold of validation."""
    inside = rows if keep is None else rows.where(keep)
    n = inside.count()
    each, more = divmod(n, cv)
    at = F.col("_place")
    long = (each + 1) * more  # rows in the longer runs
    place = F.when(at < long, F.floor(at / (each + 1))).otherwise(more + F.floor((at - long) / max(each, 1)))
    numbered = ranked(inside.select(order), [order], "_place").select(F.col(order).alias("_order"), place.cast("int").alias(fold))
    return rows.join(numbered, F.col(order) == F.col("_order"), "left").drop("_order").withColumn(fold, F.coalesce(fold, F.lit(VALIDATION)))


def gram(rows: DataFrame, columns: list[str], fold: str) -> DataFrame:
    """(fold, i, j, n, mean_i, mean_j, cross), i <= j, for each part of the rows: the sums of products of the columns'
    deviations from the part's means. Columns are numbers without nulls."""
    width = len(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, Sums] = {}
        for b in batches:
            values, of = b[columns].to_numpy(float), b["fold"].to_numpy()
            for k in np.unique(of):
                x = values[of == k]
                mean = x.mean(axis=0)
                x = x - mean
                made = Sums(float(len(x)), mean, x.T @ x)
                held[int(k)] = held[int(k)] + made if int(k) in held else made
        i, j = np.triu_indices(width)
        for k, s in held.items():
            yield pd.DataFrame({"fold": k, "i": i, "j": j, "n": s.n, "mean_i": s.mean[i], "mean_j": s.mean[j], "sum": s.cross[i, j]})

    return rows.select(F.col(fold).alias("fold"), *columns).mapInPandas(run, "fold int, i int, j int, n double, mean_i double, mean_j double, sum double")


def combined(parts: DataFrame) -> DataFrame:
    """(fold, i, j, n, mean_i, mean_j, sum): the parts of ``gram`` put together.

    The parts' means are measured from the least of them, so that nothing large is taken from something large.
    """
    base = parts.groupBy("fold", "i", "j").agg(F.min("mean_i").alias("a"), F.min("mean_j").alias("b"))
    d = parts.join(base, ["fold", "i", "j"]).withColumn("di", F.col("mean_i") - F.col("a")).withColumn("dj", F.col("mean_j") - F.col("b"))
    n, si, sj = F.sum("n"), F.sum(F.col("n") * F.col("di")), F.sum(F.col("n") * F.col("dj"))
    cross = F.sum("sum") + F.sum(F.col("n") * F.col("di") * F.col("dj")) - si * sj / n
    return d.groupBy("fold", "i", "j").agg(n.alias("n"), (F.first("a") + si / n).alias("mean_i"), (F.first("b") + sj / n).alias("mean_j"), cross.alias("sum"))


def sums_by_fold(rows: DataFrame, columns: list[str], fold: str = "fold") -> dict[int, Sums]:
    """The sums of each fold, on the driver: features by features numbers a fold."""
    found, width = {}, len(columns)
    for r in combined(gram(rows, columns, fold)).collect():
        s = found.setdefault(r.fold, Sums(r.n, np.zeros(width), np.zeros((width, width))))
        s.mean[r.i], s.mean[r.j] = r.mean_i, r.mean_j
        s.cross[r.i, r.j] = s.cross[r.j, r.i] = r.sum
    return found


@dataclass
class Line:
    """A fitted line over features as they are: those that are missing take their medians. ``chosen``: the penalty."""

    features: list[str]
    medians: list[float]
    weights: np.ndarray
    intercept: float
    chosen: dict = field(default_factory=dict)

    def prediction(self) -> Column:
        terms = [F.coalesce(finite(f), F.lit(float(m))) * float(w) for f, m, w in zip(self.features, self.medians, self.weights) if w]
        return sum(terms, F.lit(float(self.intercept)))


@dataclass
class Scaled:
    """Sums of features scaled by the mean and population deviation of all rows of training, and of the label."""

    mean: np.ndarray
    deviation: np.ndarray

    @classmethod
    def of(cls, s: Sums) -> Scaled:
        deviation = np.sqrt(np.maximum(np.diag(s.cross)[:-1] / max(s.n, 1), 0))
        flat = deviation <= 10 * np.finfo(float).eps * np.maximum(np.abs(s.mean[:-1]), 1e-300)
        return cls(s.mean[:-1], np.where(flat, 1.0, deviation))

    def __call__(self, s: Sums) -> Sums:
        by = np.append(self.deviation, 1.0)
        return Sums(s.n, np.append((s.mean[:-1] - self.mean) / self.deviation, s.mean[-1]), s.cross / np.outer(by, by))

    def unscaled(self, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        w = w / self.deviation
        return w, b - float(w @ self.mean)


def _centred(s: Sums, intercept: bool) -> tuple[np.ndarray, np.ndarray]:
    m = s.cross if intercept else s.about(np.zeros(len(s.mean)))
    return m[:-1, :-1], m[:-1, -1]


def _with_intercept(s: Sums, w: np.ndarray, intercept: bool) -> float:
    return float(s.mean[-1] - s.mean[:-1] @ w) if intercept else 0.0


def ridge(s: Sums, alpha: float, intercept: bool = True) -> np.ndarray:
    """The weights with the least squared error plus ``alpha`` times their squares."""
    m, c = _centred(s, intercept)
    return np.linalg.lstsq(m + alpha * np.eye(len(c)), c, rcond=None)[0] if len(c) else c


def descent(m: np.ndarray, c: np.ndarray, l1: float, l2: float, w: np.ndarray, tolerance: float = 1e-11, rounds: int = 10_000) -> np.ndarray:
    """Coordinate descent on covariances from the weights ``w``: least w'Mw/2 - c'w + l1 |w| + l2 w'w/2.

    Once a round through all features leaves the signs of the weights as they were, the weights with these signs are solved
    for; where the signs hold, that is the answer, and the next round finds nothing to change.
    """
    w, left, size = w.copy(), c - m @ w, np.diag(m)
    live = np.flatnonzero(size > 1e-14 * max(float(size.max(initial=0.0)), 1e-300))
    enough = tolerance * max(float(np.abs(c).max(initial=0.0)), 1e-300)
    tried = None
    for _ in range(rounds):
        most, before = 0.0, np.sign(w)
        for j in live:
            rho = left[j] + size[j] * w[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (size[j] + l2)
            if new != w[j]:
                most = max(most, abs(new - w[j]) * size[j])
                left -= m[:, j] * (new - w[j])
                w[j] = new
        if most <= enough:
            break
        sign = np.sign(w)
        if (sign == before).all() and (tried is None or (sign != tried).any()):
            on, tried = np.flatnonzero(sign), sign
            solved = np.linalg.lstsq(m[np.ix_(on, on)] + l2 * np.eye(len(on)), c[on] - l1 * sign[on], rcond=None)[0]
            if (np.sign(solved) == sign[on]).all():
                w[on] = solved
                left = c - m @ w
    return w


def penalties(s: Sums, ratio: float, n: int, eps: float, intercept: bool = True) -> np.ndarray:
    """``n`` penalties from the least one that leaves no weight down to its ``eps``-fold."""
    top = float(np.abs(_centred(s, intercept)[1]).max(initial=0.0)) / (s.n * ratio) if s.n else 0.0
    return np.geomspace(top, top * eps, n) if top > 0 else np.array([0.0])


def path(s: Sums, alphas: np.ndarray, ratio: float, intercept: bool = True) -> list[np.ndarray]:
    """The weights at each falling penalty, each found from the one before."""
    m, c = _centred(s, intercept)
    w, found = np.zeros(len(c)), []
    for a in alphas:
        w = descent(m / s.n, c / s.n, a * ratio, a * (1 - ratio), w)
        found.append(w)
    return found


def squared_error(s: Sums, w: np.ndarray, b: float) -> float:
    """The sum of squared errors of a line on the rows of the sums."""
    by = np.append(-w, 1.0)
    return float(by @ s.cross @ by + s.n * (s.mean @ by - b) ** 2)


def fitted(folds: dict[int, Sums], family: str, settings: dict) -> tuple[np.ndarray, float, dict]:
    """(weights, intercept, chosen) in the features' own scale, from the sums of each fold of training; the last column is
    the label. Ridge has its ``alpha``; lasso and elastic net take the penalty, and of several ratios the one, with the least
    mean over the folds of the squared error on the fold that is left out."""
    parts = [s for k, s in sorted(folds.items()) if k != VALIDATION]
    total = sum(parts[1:], parts[0])
    scaled, intercept = Scaled.of(total), bool(settings.get("fit_intercept", True))
    every, parts = scaled(total), [scaled(s) for s in parts]
    if family == "Ridge":
        w = ridge(every, float(settings.get("alpha", 1.0)), intercept)
        return *scaled.unscaled(w, _with_intercept(every, w, intercept)), {}
    ratios = 1.0 if family == "LassoCV" else settings.get("l1_ratio", 0.5)
    best = None
    for ratio in ratios if isinstance(ratios, (list, tuple)) else [ratios]:
        alphas = np.array(sorted(settings["alphas"], reverse=True)) if settings.get("alphas") else penalties(every, ratio, int(settings.get("n_alphas", 100)), float(settings.get("eps", 1e-3)), intercept)
        errors = np.zeros(len(alphas))
        for k, left in enumerate(parts):
            rest = [s for i, s in enumerate(parts) if i != k]
            if not rest:
                continue
            train = sum(rest[1:], rest[0])
            errors += [squared_error(left, w, _with_intercept(train, w, intercept)) / left.n / len(parts) for w in path(train, alphas, ratio, intercept)]
        at = int(np.argmin(errors))
        if best is None or errors[at] < best[0]:
            best = errors[at], float(alphas[at]), ratio, path(every, alphas[: at + 1], ratio, intercept)[-1]
    error, alpha, ratio, w = best
    return *scaled.unscaled(w, _with_intercept(every, w, intercept)), {"alpha": alpha, "l1_ratio": ratio, "fold_error": error}


@dataclass(frozen=True)
class Linear:
    """A linear candidate: which features, whether the label is its logarithm, the family and its settings."""

    name: str
    family: str
    features: tuple[str, ...]
    log_target: bool = False
    settings: tuple[tuple[str, object], ...] = ()


def filled(rows: DataFrame, features: list[str], train: Column | None = None) -> tuple[DataFrame, list[float]]:
    """``rows`` with the finite features, the training rows' exact medians where they are missing, and the medians; a
    feature without any value is 0."""
    found = medians(rows if train is None else rows.where(train), [], {f: f for f in features}).first() if features else None
    middle = [float(found[f]) if found[f] is not None else 0.0 for f in features]
    return rows.withColumns({f: F.coalesce(finite(f), F.lit(m)) for f, m in zip(features, middle)}), middle


def fit_many(rows: DataFrame, label: str, order: str, wanted: list[Linear], train: Column | None = None, cv: int = 3) -> tuple[dict[str, Line], dict[str, dict]]:
    """The lines of all candidates, and their scores on the rows that are not ``train``: how many, rmse and mean error.

    All share the medians, one placing into folds by ``order`` and one pass for the sums. A logarithmic label needs positive
    ones; such a candidate's scores are those of the logarithms.
    """
    features = list(dict.fromkeys(f for c in wanted for f in c.features))
    ready, middle = filled(rows, features, train)
    labels = {False: "_label"} | ({True: "_label_log"} if any(c.log_target for c in wanted) else {})
    y = finite(label)
    ready = ready.withColumn("_label", y).where("_label IS NOT NULL")
    if True in labels:
        ready = ready.withColumn("_label_log", F.log10(F.when(y > 0, y).otherwise(F.raise_error(F.lit("a logarithmic target needs positive labels")).cast("double"))))
    folded = positional_folds(ready, order, cv, keep=train)
    columns = [*features, *labels.values()]
    folds = sums_by_fold(folded, columns)
    lines, scores = {}, {}
    for c in wanted:
        places = [*[features.index(f) for f in c.features], columns.index(labels[c.log_target])]
        own = {k: s.part(places) for k, s in folds.items()}
        w, b, chosen = fitted(own, c.family, dict(c.settings))
        lines[c.name] = Line(list(c.features), [middle[features.index(f)] for f in c.features], w, b, chosen)
        if VALIDATION in own:
            s = own[VALIDATION]
            scores[c.name] = {"n": int(s.n), "rmse": float(np.sqrt(max(squared_error(s, w, b), 0.0) / s.n)), "bias": float(s.mean[:-1] @ w + b - s.mean[-1])}
    return lines, scores
