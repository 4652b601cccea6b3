"""Policy space, a Bayesian best-arm loop in kernel form, and candidates of all families fitted and applied."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import finite
from . import penalty, trees

# The charging steps' currents.
C1 = [3.6, 4.0, 4.4, 4.8, 5.2, 5.6, 6.0, 7.0, 8.0]
C2 = [3.6, 4.0, 4.4, 4.8, 5.2, 5.6, 6.0, 7.0]
C3 = [3.6, 4.0, 4.4, 4.8, 5.2, 5.6]


def policy_space(spark: SparkSession) -> DataFrame:
    """All protocols whose last current, which follows from the others and the charging time, is allowed: 224 rows."""
    grid = spark.range(1)
    for name, values in (("C1", C1), ("C2", C2), ("C3", C3)):  # 432 literals
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    last = 0.2 / (F.lit(1 / 6) - 0.2 / F.col("C1") - 0.2 / F.col("C2") - 0.2 / F.col("C3"))
    same = (F.col("C1") == 4.8) & (F.col("C2") == 4.8) & (F.col("C3") == 4.8)
    return grid.withColumn("C4", last).where(F.col("C4").between(0.1, 4.81) & ~same).select("C1", "C2", "C3", F.bround("C4", 3).alias("C4"))


# The best protocols that were published, best first.
PUBLISHED = ((4.8, 5.2, 5.2, 4.160), (5.2, 5.2, 4.8, 4.160), (4.4, 5.6, 5.2, 4.252))


class BestArm:
    """Bounds of every arm's mean from its observations, with a squared-exponential kernel; runs on the driver, since the
    arms are a fixed few hundred."""

    # The defaults of the settings.
    def __init__(self, arms: np.ndarray, gamma: float = 1.0, prior: float = 164.0, noise: float = 164.0, mean: float = 947.0, beta: float = 5.0, decay: float = 0.5, seed: int = 0, batch: int = 48):
        self.arms = arms[np.random.default_rng(seed).permutation(len(arms))]
        gap = ((self.arms[:, None, :3] - self.arms[None, :, :3]) ** 2).sum(axis=2)
        self.kernel = prior**2 * np.exp(-gamma * gap)
        self.noise, self.mean, self.beta0, self.decay, self.size = noise**2, mean, beta, decay, batch

    def beta(self, turn: int) -> float:
        """The width of the bounds in a round: each decays from the one before, to four digits."""
        now = self.beta0
        for _ in range(turn):
            now = float(np.around(now * self.decay, 4))
        return now

    def arm_of(self, values: np.ndarray, tolerance: float = 1e-3) -> int:
        """The first arm whose currents are the values but for the tolerance."""
        hit = np.flatnonzero((np.abs(np.round(self.arms[:, :3], 3) - np.round(values[:3], 3)) <= tolerance + 1e-9).all(axis=1))
        if not len(hit):
            raise ValueError(f"no arm has the values {values.tolist()}")
        return int(hit[0])

    def bounds(self, arms: list[int], values: list[float], turn: int) -> tuple[np.ndarray, np.ndarray]:
        beta = self.beta(turn)
        mean, var = np.zeros(len(self.arms)), np.diag(self.kernel).copy()
        if arms:  # observations of one arm count as their mean with less noise
            seen, n = np.unique(arms, return_counts=True)
            total = np.array([sum(v for a, v in zip(arms, values) if a == s) for s in seen])
            k = self.kernel[:, seen]
            inverse = inverted(self.kernel[np.ix_(seen, seen)] + np.diag(self.noise / n))
            mean = (k * (inverse * (total / n - self.mean)).sum(axis=1)).sum(axis=1)
            var = var - (np.einsum("ij,jk->ik", k, inverse) * k).sum(axis=1)
        half = beta * np.sqrt(np.maximum(var, 0))
        return np.round(mean - half, 4) + self.mean, np.round(mean + half, 4) + self.mean

    def batch(self, low: np.ndarray, high: np.ndarray, size: int) -> tuple[list[int], int]:
        """The arms to try next, and the proposal: again and again, of the arm with the least gap to its best rival, rivals
        that are taken included, and the best other arm that is left, the less certain one."""
        top = np.sort(high)[::-1][:2]
        rival = np.where(np.arange(len(high)) == int(np.argmax(high)), top[-1], top[0])
        left, chosen, proposal = list(range(len(low))), [], -1
        while left and len(chosen) < size:
            one = min(left, key=lambda k: (rival[k] - low[k], k))
            other = max((k for k in left if k != one), key=lambda k: (high[k], -k), default=one)
            proposal = one if not chosen else proposal
            pick = one if high[one] - low[one] >= high[other] - low[other] else other
            chosen.append(pick)
            left.remove(pick)
        return chosen, proposal


def inverted(a: np.ndarray) -> np.ndarray:
    """Inverse of a small positive definite matrix by elimination, a row at a time: no threads of a linear algebra library
    compete with the executors'."""
    a, out = a.astype(float), np.eye(len(a))
    for i in range(len(a)):
        out[i] /= a[i, i]
        a[i] = a[i] / a[i, i]
        rest = a[:, i].copy()
        rest[i] = 0
        out -= rest[:, None] * out[i]
        a -= rest[:, None] * a[i]
    return out


def loop_rounds(arms: DataFrame, rounds: list[DataFrame], **settings) -> tuple[BestArm, list[dict]]:
    """The rounds of the loop: one without observations, then one for each of ``rounds`` (C1, C2, C3, prediction).

    Each gives the bounds, the batch to try next, its proposal, the gap of the round before's proposal, and the best arm
    so far: the proposal with the least gap.
    """
    names = ["C1", "C2", "C3", "C4"]
    space = np.array([tuple(r) for r in arms.select(*names).orderBy(*names).collect()])
    best, seen, values, made = BestArm(space, **settings), [], [], []
    for turn in range(len(rounds) + 1):
        n = 0
        if turn:
            for r in rounds[turn - 1].select("C1", "C2", "C3", "prediction").where("prediction IS NOT NULL").orderBy("C1", "C2", "C3", "prediction").collect():
                seen.append(best.arm_of(np.array([r.C1, r.C2, r.C3])))
                values.append(r.prediction)
                n += 1
        low, high = best.bounds(seen, values, turn)
        chosen, proposal = best.batch(low, high, best.size)
        gap, winner = None, None
        if turn:
            before = made[-1]["proposal"]
            gap = float(np.delete(high, before).max() - low[before])
            gaps = [r["gap"] for r in made[1:]] + [gap]
            winner = made[int(np.argmin(gaps))]["proposal"]
        made.append({"round": turn, "observations": n, "low": low, "high": high, "batch": chosen, "proposal": proposal, "gap": gap, "winner": winner})
    return best, made


def closed_loop(spark: SparkSession, arms: DataFrame, rounds: list[DataFrame], **settings) -> DataFrame:
    """(rank, C1..C4, mean, low, high, half_width) after taking in each round's (C1, C2, C3, prediction) rows."""
    best, made = loop_rounds(arms, rounds, **settings)
    low, high = made[-1]["low"], made[-1]["high"]
    mean = (low + high) / 2
    order = sorted(range(len(mean)), key=lambda k: (-mean[k], *best.arms[k]))
    rows = [(i + 1, *map(float, best.arms[k]), float(mean[k]), float(low[k]), float(high[k]), float((high[k] - low[k]) / 2)) for i, k in enumerate(order)]
    return spark.createDataFrame(rows, "rank int, C1 double, C2 double, C3 double, C4 double, mean double, low double, high double, half_width double")


def next_batches(spark: SparkSession, arms: DataFrame, rounds: list[DataFrame], **settings) -> DataFrame:
    """(round, place, C1..C4, proposal): the protocols that each round wants tried, in order."""
    best, made = loop_rounds(arms, rounds, **settings)
    rows = [(r["round"], i, *map(float, best.arms[k]), k == r["proposal"]) for r in made for i, k in enumerate(r["batch"])]
    return spark.createDataFrame(rows, "round int, place int, C1 double, C2 double, C3 double, C4 double, proposal boolean")


def published_check(ranking: DataFrame, published=PUBLISHED, tolerance: float = 1e-3) -> DataFrame:
    """(C1..C4, found, rank, mean, half_width, same_top): where the published best protocols stand in a ranking, and
    whether its first ones are these in order; a protocol that the ranking lacks has nulls."""
    spark = ranking.sparkSession
    names = ["C1", "C2", "C3", "C4"]
    wanted = spark.createDataFrame([(i + 1, *map(float, p)) for i, p in enumerate(published)], "place int, C1 double, C2 double, C3 double, C4 double")
    rows = ranking.select("rank", "mean", "half_width", *[F.col(c).alias(f"_{c}") for c in names], *[F.bround(c, 3).alias(f"_k{c}") for c in names])
    near = [F.abs(F.col(c) - F.col(f"_{c}")) <= tolerance + 1e-9 for c in names]
    both = F.broadcast(wanted).join(rows, near[0] & near[1] & near[2] & near[3], "left")  # a few published rows
    first = both.groupBy("place", *names).agg(F.min_by(F.struct("rank", "mean", "half_width"), "rank").alias("r"))
    same = first.agg((F.count_if(F.col("r.rank") == F.col("place")) == len(published)).alias("same_top"))
    return first.crossJoin(F.broadcast(same)).select(*names, F.col("r.rank").isNotNull().alias("found"), "r.rank", "r.mean", "r.half_width", "same_top")  # one row


LINEAR = {"ridge": "Ridge", "lasso": "LassoCV", "lassocv": "LassoCV", "elasticnet": "ElasticNetCV", "elasticnetcv": "ElasticNetCV"}
FOREST = ("randomforest", "randomforestregressor", "forest", "rf")
BOOSTED = ("gradientboosting", "gradientboostingregressor", "gbr", "gbt")
# The sizes of the ready candidates' ensembles.
FOREST_SIZES = {"trees": 160, "least": 2, "seed": 19}
BOOSTED_SIZES = {"trees": 120, "depth": 2, "rate": 0.05, "seed": 23}


def evaluated(train: DataFrame, test: DataFrame, features: list[str], label: str, family: str, key: str, log_target: bool = False, cv: int = 3, **settings) -> DataFrame:
    """The rows of ``test`` with ``y``, if they have the label, and ``y_pred``: fitted on ``train``, whose exact medians take
    the place of missing values, with a label as it is or its logarithm. Unknown families are ridge.

    ``key`` is unique in each table and orders the rows; the folds of lasso and elastic net are runs of neighbours in it.
    ``settings`` are those of the family: see ``penalty.fitted``, ``trees.forest`` and ``trees.boosted``.
    """
    name = family.lower().replace("_", "").replace(" ", "")
    back = lambda c: F.pow(F.lit(10.0), c) if log_target else c
    kept = test.withColumn("y", F.col(label)) if label in test.columns else test
    train = train.select(key, *features, label).persist()  # a fit reads it several times
    if name not in FOREST + BOOSTED:
        one = penalty.Linear("one", LINEAR.get(name, "Ridge"), tuple(features), log_target, tuple(settings.items()))
        line = penalty.fit_many(train, label, key, [one], cv=cv)[0]["one"]
        train.unpersist()
        return kept.withColumn("y_pred", back(line.prediction()))
    ready, middle = penalty.filled(train, features)
    goal = finite(label)
    if log_target:
        goal = F.log10(F.when(goal > 0, goal).otherwise(F.raise_error(F.lit("a logarithmic target needs positive labels")).cast("double")))
    rows = ready.select(F.col(key).alias("id"), F.array(*features).alias("x"), goal.alias("y")).where("y IS NOT NULL")
    x = F.array(*[F.coalesce(finite(f), F.lit(m)) for f, m in zip(features, middle)])
    if name in BOOSTED:
        model = trees.boosted(rows, len(features), **BOOSTED_SIZES | settings)
        train.unpersist()
        return kept.withColumn("x", x).withColumn("y_pred", back(model.prediction())).drop("x")
    made = trees.forest(rows, test.select(F.col(key).alias("id"), x.alias("x")), len(features), **FOREST_SIZES | settings)
    return kept.join(made.withColumnRenamed("id", key), key, "left").withColumn("y_pred", back(F.col("prediction"))).drop("prediction")
