"""Candidate models from a specification: names made standard, features chosen, an estimator fitted and applied."""

from __future__ import annotations

import json
import math
import re
from dataclasses import asdict, dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import model as models
from .entity_features import FeatureTable, all_features, key_column

# Model families and the names they go by.
MODELS = {
    "Ridge": ("ridge", "ridgeregression", "linearregularized", "regularizedregression"),
    "ElasticNetCV": ("elasticnet", "elasticnetcv"),
    "LassoCV": ("lasso", "lassocv"),
    "RandomForestRegressor": ("randomforest", "randomforestregressor", "forest"),
    "GradientBoostingRegressor": ("gradientboosting", "gradientboostingregressor", "gbr"),
}
# Names of the logarithmic target; all others are the raw one.
LOG_TARGETS = {"log", "log10", "log_10", "log_target", "log10_target", "log10_cycle_life", "log10cyclelife", "log_cycle_life", "log_y", "log_transform", "logtransform", "log_transformed"}
# Feature sets and the names they go by; all others are all_available.
FEATURE_SETS = {
    "scalar_only": ("scalar", "scalars", "scalaronly", "scalar_features", "scalar_features_only", "summary", "summary_only"),
    "curve_only": ("curve", "curves", "curveonly", "curve_features", "curve_shape", "curve_shape_only"),
    "scalar_plus_curve": ("scalar_curve", "scalar_and_curve", "scalars_and_curves", "scalarpluscurve", "scalar_curves"),
    "broad_physics": ("broad", "broadphysics", "physics", "physics_aware", "physicsaware", "physics_based", "physics_features"),
    "protocol_only": ("protocol", "protocols", "protocol_features", "protocol_features_only"),
    "all_available": (),
}
# The settings a family takes, and those it has where they are not given.
SETTINGS = {
    "Ridge": {"alpha", "fit_intercept", "positive", "random_state"},
    "ElasticNetCV": {"l1_ratio", "eps", "n_alphas", "alphas", "fit_intercept", "max_iter", "cv", "random_state"},
    "LassoCV": {"eps", "n_alphas", "alphas", "fit_intercept", "max_iter", "cv", "random_state"},
    "RandomForestRegressor": {"n_estimators", "max_depth", "min_samples_leaf", "min_samples_split", "max_features", "random_state"},
    "GradientBoostingRegressor": {"n_estimators", "learning_rate", "max_depth", "min_samples_leaf", "subsample", "random_state"},
}
DEFAULTS = {
    "Ridge": {"alpha": 1.0},
    "ElasticNetCV": {"cv": 3, "max_iter": 10000, "random_state": 0},
    "LassoCV": {"cv": 3, "max_iter": 10000, "random_state": 0},
    "RandomForestRegressor": {"n_estimators": 100, "min_samples_leaf": 1, "random_state": 0},
    "GradientBoostingRegressor": {"n_estimators": 100, "learning_rate": 0.05, "max_depth": 2, "random_state": 0},
}
# The families of features that a feature set takes.
SCALARS = {"capacity_summary", "resistance_summary", "thermal_summary", "energy_summary", "capacity_summary_delta", "resistance_summary_delta", "thermal_summary_delta", "energy_summary_delta", "scalar_delta"}
CURVES = {"true_curve_shape", "true_curve_difference", "curve_difference_proxy", "curve_difference_approximate", "curve_shape_proxy", "curve_shape", "curve_delta"}
PLACEHOLDERS = {"learned_embedding_placeholder", "generic_timeseries_placeholder"}
# The grids that variants go through.
ALPHAS = [0.1, 0.3, 1.0, 3.0, 10.0, 30.0]
RATIOS = [[0.15, 0.5, 0.85], [0.25, 0.5, 0.75], [0.1, 0.3, 0.7, 0.9]]
N_ALPHAS, EPS, TREES, DEPTHS, LEAVES, STEPS, SHALLOW = [25, 50, 75], [1e-3, 3e-4, 1e-4], [80, 120, 180], [None, 4, 7], [1, 2, 4], [0.03, 0.05, 0.08], [1, 2, 3]


def model_family(name: str | None, estimator: str | None = None) -> str:
    """A family by any of its names; unknown ones, and Ridge itself, go by the estimator's name, else Ridge."""
    def known(text: str | None) -> str:
        low = re.sub(r"[^a-z0-9]+", "", (text or "").lower())
        return next((m for m, names in MODELS.items() if text == m or low in names), "Ridge")

    found = known(name)
    return known(estimator) if found == "Ridge" and estimator else found


def _plain(text: str | None) -> str:
    return re.sub(r"[\s\-]+", "_", (text or "").strip().lower())


def target_transform(name: str | None) -> str:
    return "log10" if _plain(name) in LOG_TARGETS else "raw"


def feature_set(name: str | None) -> str:
    low = _plain(name)
    return next((s for s, names in FEATURE_SETS.items() if low == s or low in names), "all_available")


def named(column: str | Column, names: dict[str, tuple[str, ...]], default: str) -> Column:
    """As the functions above, for a column: the standard name of each value."""
    x = F.regexp_replace(F.lower(F.trim(F.col(column) if isinstance(column, str) else column)), r"[\s\-]+", "_")
    out = F.lit(default)
    for s, other in names.items():
        out = F.when(x.isin(s.lower(), *other), F.lit(s)).otherwise(out)
    return out


def clean_settings(family: str, given: dict | None) -> dict:
    """The settings that the family takes and that are plain values, and its defaults."""
    kept = {k: v for k, v in (given or {}).items() if k in SETTINGS[family] and (v is None or isinstance(v, (str, int, float, bool, list, tuple)))}
    return DEFAULTS[family] | kept


def variant_settings(family: str, iteration: int, variant: int) -> dict:
    """The settings of a variant: each grid is gone through by iteration and variant."""
    k, seed = iteration + variant, 1009 * iteration + 37 * variant  # fixed values: the seed's two factors
    at = lambda grid: grid[k % len(grid)]
    by_folds = {"n_alphas": at(N_ALPHAS), "eps": at(EPS), "cv": 3, "max_iter": 10000, "random_state": seed}
    return {
        "Ridge": {"alpha": at(ALPHAS)},
        "ElasticNetCV": {"l1_ratio": at(RATIOS)} | by_folds,
        "LassoCV": by_folds,
        "RandomForestRegressor": {"n_estimators": at(TREES), "max_depth": at(DEPTHS), "min_samples_leaf": at(LEAVES), "random_state": seed},
        "GradientBoostingRegressor": {"n_estimators": at(TREES), "learning_rate": at(STEPS), "max_depth": at(SHALLOW), "min_samples_leaf": at(LEAVES), "random_state": seed},
    }.get(family, {})


@dataclass
class Candidate:
    """A declarative candidate; ``tables``: names of ready feature tables it asks for."""

    name: str
    family: str = "Ridge"
    target: str = "raw"
    features: str = "all_available"
    protocol: bool = False
    families: list[str] = field(default_factory=list)
    tables: list[str] = field(default_factory=list)
    settings: dict = field(default_factory=dict)

    def standard(self) -> Candidate:
        family = model_family(self.family)
        return Candidate(self.name, family, target_transform(self.target), feature_set(self.features), bool(self.protocol), sorted(self.families), sorted(self.tables), clean_settings(family, self.settings))

    def key(self) -> str:
        """A canonical text of everything but the name: equal candidates have equal ones."""
        made = asdict(self.standard())
        del made["name"]
        return json.dumps(made, sort_keys=True, separators=(",", ":"))


def from_plans(name: str, feature_plan: dict, model_plan: dict) -> Candidate:
    """A candidate of a feature plan (families, include_protocol, tables) and a model plan (family, estimator, target,
    feature_set, hyperparameters)."""
    family = model_family(model_plan.get("family"), model_plan.get("estimator"))
    return Candidate(
        name, family, target_transform(model_plan.get("target")), feature_set(model_plan.get("feature_set")), bool(feature_plan.get("include_protocol")),
        list(feature_plan.get("families", [])), list(feature_plan.get("tables", [])), clean_settings(family, model_plan.get("hyperparameters")),
    )


def variants(first: Candidate, iteration: int, n: int, protocol_allowed: bool = False) -> list[Candidate]:
    """Up to ``n`` different candidates of one iteration: preferred ones, rotated by the iteration, then the whole grid."""
    n = max(1, n)
    if n == 1:
        return [Candidate(f"iter_{iteration:03d}", first.family, first.target, first.features, first.protocol, first.families, first.tables, variant_settings(model_family(first.family), iteration, 0))]
    sets = ["scalar_only", "curve_only", "scalar_plus_curve", "broad_physics", "all_available"] if first.tables else ["all_available"]
    at = lambda k: sets[min(k, len(sets) - 1)]
    other = False if protocol_allowed else first.protocol
    preferred = [  # fixed values: families, targets and sets in this order
        ("Ridge", target_transform(first.target), first.protocol, at(0)), ("Ridge", "log10", first.protocol, at(1)), ("ElasticNetCV", "raw", first.protocol, at(2)),
        ("RandomForestRegressor", "raw", other, at(3)), ("GradientBoostingRegressor", "log10", first.protocol, at(4)), ("LassoCV", "log10", other, sets[-1]),
    ]
    turn = iteration % len(preferred)
    grid = [(f, t, p, s) for s, t, p, f in product(sets, ("raw", "log10"), (True, False) if protocol_allowed else (first.protocol,), MODELS)]
    keys = list(dict.fromkeys(preferred[turn:] + preferred[:turn] + grid))[:n]
    return [Candidate(f"iter_{iteration:03d}_variant_{k:02d}", f, t, s, p, first.families, first.tables, variant_settings(f, iteration, k)) for k, (f, t, p, s) in enumerate(keys)]


def wanted_families(of: str, protocol: bool, only: list[str] = []) -> set[str] | None:
    """The families that a feature set takes, or those of a filter; None: all that are allowed. A filter does not shut out the
    protocol's where they are allowed and the set is one that has them."""
    found = set(only) or {"scalar_only": SCALARS, "curve_only": CURVES, "scalar_plus_curve": SCALARS | CURVES, "broad_physics": SCALARS | CURVES | PLACEHOLDERS, "protocol_only": {"protocol"}}.get(of, set())
    if only and protocol and of in ("all_available", "protocol_only"):
        found |= {"protocol"}
    return (found if protocol else found - {"protocol"}) or None


def selected_columns(columns: list[str], about: dict[str, str], of: str, protocol: bool, only: list[str] = []) -> list[str]:
    """The columns of a feature set, by their families; by their names where no family is known."""
    if not about:
        curve = lambda c: "curve" in c or "qdiff" in c
        rule = {"protocol_only": lambda c: c.startswith("protocol_"), "curve_only": curve, "scalar_only": lambda c: not c.startswith("protocol_") and not curve(c)}.get(of, lambda c: True)
        return [c for c in columns if rule(c)]
    families = wanted_families(of, protocol, only)
    keep = (lambda f: f in families) if families is not None else (lambda f: protocol or f != "protocol")
    return [c for c in columns if c in about and keep(about[c])]


def feature_frame(metadata: DataFrame, cycles: DataFrame, c: Candidate, tables: list[FeatureTable] = [], upto: int = 100, columns: list[str] | None = None, protocol_allowed: bool = True) -> tuple[DataFrame, list[str]]:
    """(key, columns) of every id of the metadata, and the columns: those given, null where the tables lack them, or the
    feature set's that have any value. Without any there is a constant one."""
    key = key_column(metadata.columns)
    asked = [t for t in tables if t.name in c.tables]
    protocol = c.protocol and protocol_allowed
    made, about = all_features(metadata, cycles, upto, protocol, asked, c.families or None, prune=columns is None)
    if columns is None:
        columns = selected_columns([n for n in made.columns if n != key], about, c.features, protocol, c.families) or ["constant_feature"]
    have = [F.col(n) if n in made.columns else F.lit(1.0 if n == "constant_feature" else None).cast("double").alias(n) for n in columns]
    return metadata.select(key).distinct().join(made, key, "left").select(key, *have), columns


def fit_settings(family: str, settings: dict, width: int) -> tuple[str, dict]:
    """The name that ``model.evaluated`` knows a family by, and its settings under the names there."""
    s = dict(settings)
    if family == "RandomForestRegressor":
        share = s.get("max_features")
        tried = {"sqrt": width**0.5, "log2": math.log2(max(width, 2))}.get(share) if isinstance(share, str) else share * width if isinstance(share, float) else share
        made = {"trees": s["n_estimators"], "depth": s.get("max_depth"), "least": s["min_samples_leaf"], "fewest": s.get("min_samples_split", 2), "seed": s["random_state"], "tried": max(1, int(tried)) if tried else None}
        return "randomforest", {k: v if v is None else int(v) for k, v in made.items()}
    if family == "GradientBoostingRegressor":
        made = {"trees": int(s["n_estimators"]), "depth": int(s["max_depth"]), "least": int(s.get("min_samples_leaf", 1)), "seed": int(s["random_state"])}
        return "gbr", made | {"rate": float(s["learning_rate"]), "subsample": float(s.get("subsample", 1.0))}
    taken = {"Ridge": ("alpha", "fit_intercept"), "LassoCV": ("eps", "n_alphas", "alphas", "fit_intercept", "cv"), "ElasticNetCV": ("l1_ratio", "eps", "n_alphas", "alphas", "fit_intercept", "cv")}[family]
    return family, {k: v for k, v in s.items() if k in taken}


def runnable(c: Candidate, tables: list[FeatureTable] = [], upto: int = 100, protocol_allowed: bool = False):
    """The candidate as a function for ``evaluation.evaluated_candidate``: features of both sides, median imputing, a
    scaled linear model or an ensemble, predictions in the labels' scale."""
    c = c.standard()

    def run(meta: DataFrame, cycles: DataFrame, labels: DataFrame, test_meta: DataFrame, test_cycles: DataFrame) -> DataFrame:
        key = key_column(meta.columns)
        train, columns = feature_frame(meta, cycles, c, tables, upto, None, protocol_allowed)
        test, _ = feature_frame(test_meta, test_cycles, c, tables, upto, columns, protocol_allowed)
        family, settings = fit_settings(c.family, c.settings, len(columns))
        made = models.evaluated(train.join(labels.select(key, "y"), key), test, columns, "y", family, key, c.target == "log10", **settings)
        return made.select(key, "y_pred")

    return run
