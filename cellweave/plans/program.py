"""Declarative feature programs: a list of operator specifications, turned into one lazy plan over all entities.

A specification names a registered plan builder, a signal and parameters. Every builder gives a wide frame with one row an
entity; programs put them together long (entity, feature, value) or wide, where columns without any value are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curves, protocol, series


@dataclass
class Spec:
    operator: str
    signal: str
    params: dict = field(default_factory=dict)
    enabled: bool = True
    family: str = ""


@dataclass
class Program:
    """``first_steps``: how many steps the recipe was made for. It is kept with the program; the specifications' own steps and
    windows already follow from it."""

    name: str
    specs: list[Spec]
    include_protocol: bool = False
    first_steps: int = 100
    convention: str = "raw_zero_based"

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Program:
        made = json.loads(text)
        return cls(**made | {"specs": [Spec(**s) for s in made["specs"]]})


@dataclass
class Inputs:
    """series: entity, step, signals. samples: entity, step, kind, x, signals. metadata: entity, protocol columns."""

    series: DataFrame
    samples: DataFrame | None = None
    metadata: DataFrame | None = None


@dataclass
class Status:
    """What became of a specification: ok, warning, failed, disabled or skipped."""

    operator: str
    status: str
    n_features: int = 0
    warnings: list[str] = field(default_factory=list)


class Registry:
    """Plan builders by name. A builder may give, in place of a frame of its own, what a program computes together with all
    its other specifications: ``columns``, features of the per-step means; ``picks``, named aggregates of the
    samples' rows; ``curves``, wanted curves with the names of their statistics."""

    def __init__(self) -> None:
        self._built: dict[str, tuple[Callable, dict]] = {}

    def register(self, name: str, build: Callable[[Spec, Inputs], DataFrame | None], **about) -> None:
        self._built[name] = build, about

    def get(self, name: str) -> Callable:
        if name not in self._built:
            raise KeyError(f"no operator named {name}; known: {', '.join(self.available())}")
        return self._built[name][0]

    def available(self) -> list[str]:
        return sorted(self._built)

    def about(self, name: str) -> dict:
        return self._built[name][1] if name in self._built else {}


def _in_samples(s: Spec, i: Inputs) -> bool:
    return i.samples is not None and s.signal in i.samples.columns


def _value_columns(s: Spec, i: Inputs) -> series.Derived:
    """The means at single steps; of the samples where the series lack the step."""
    return series.value_columns(s.signal, "step", s.params["steps"], s.params.get("aggs", ["last"]), f"raw_{s.signal}" if _in_samples(s, i) else None)


def _value_picks(s: Spec, i: Inputs) -> dict[str, Column]:
    """The aggregates of single steps other than the mean, from the samples' rows, or the series' without samples."""
    aggs = [a for a in s.params.get("aggs", ["last"]) if a not in ("last", "mean")]
    kind = s.params.get("kind_value")
    return series.pick_columns(s.signal, "step", s.params.get("order", "step"), s.params["steps"], aggs, "kind" if kind else None, kind) if aggs else {}


def _window_columns(s: Spec, i: Inputs) -> series.Derived:
    made, wanted = series.Derived(), s.params.get("stats")
    for lo, hi in s.params["windows"]:
        one = series.window_columns(s.signal, "step", lo, hi)
        made |= one.only({f"{s.signal}_{t}_{lo}_{hi}" for t in wanted}) if wanted else one
    return made


def _delta_columns(s: Spec, i: Inputs) -> series.Derived:
    return series.delta_columns(s.signal, "step", [tuple(p) for p in s.params["pairs"]], s.params["how"])


def _window_of(s: Spec) -> tuple[float, float] | None:
    window = s.params.get("window")
    return (float(window[0]), float(window[1])) if window else None


def _shape(s: Spec, i: Inputs) -> tuple[curves.Curve, dict[str, tuple[int | None, str]]]:
    aggs, kind = tuple(s.params.get("aggs", curves.SHAPE)), s.params.get("kind_value")
    steps = tuple(dict.fromkeys(s.params["steps"]))
    named = {f"{s.signal}_{kind or 'all'}_{a}_at_{c}": (c, f"shape_{a}") for c in steps for a in aggs}
    return curves.Curve(s.signal, steps, False, kind, s.params.get("grid", 1000), _window_of(s)), named


def _curve_delta(s: Spec, i: Inputs) -> tuple[curves.Curve, dict[str, tuple[int | None, str]]]:
    kind, (a, b), only = s.params.get("kind_value"), s.params["pair"], s.params.get("aggs")
    named = {f"{s.signal}_{how}_{x}_{a}_{b}": (None, f"{how}_{x}") for how in s.params.get("transforms", ("identity",)) for x in curves.DIFFERENCE if not only or x in only}
    return curves.Curve(s.signal, (a, b), True, kind, s.params.get("grid", 1000), _window_of(s)), named


def _protocol(s: Spec, i: Inputs) -> DataFrame | None:
    return protocol.protocol_features(i.metadata, "entity", s.params["columns"]) if i.metadata is not None else None


registry = Registry()
registry.register("value_at_step", lambda s, i: None, reads="series", columns=_value_columns, picks=_value_picks)
registry.register("window_stats", lambda s, i: None, reads="series", columns=_window_columns)
registry.register("step_delta", lambda s, i: None, reads="series", columns=_delta_columns)
registry.register("curve_shape", lambda s, i: None, reads="samples", curves=_shape)
registry.register("curve_delta", lambda s, i: None, reads="samples", curves=_curve_delta)
registry.register("protocol", _protocol, reads="metadata")
registry.register("learned_embedding_placeholder", lambda s, i: None, reads="")
registry.register("generic_timeseries_placeholder", lambda s, i: None, reads="")


def requires_samples(program: Program) -> bool:
    """Whether an enabled operator reads the samples; otherwise their source is not scanned, not even for fallbacks."""
    return any(s.enabled and registry.about(s.operator).get("reads") == "samples" for s in program.specs)


def _resolved(signals: list[str], rows: DataFrame) -> dict[str, list[str]]:
    """The columns that stand for each signal: its known other names, as far as ``rows`` has them as plain values."""
    plain = [c for c, kind in rows.dtypes if not kind.startswith(("array", "map", "struct", "binary"))]
    known = {s: [c for c in [s, *SIGNAL_ALIASES.get(s, [])] if c in plain] for s in signals}
    lacking = [s for s, c in known.items() if not c]
    if lacking:
        raise KeyError(f"no column for the signals {', '.join(lacking)}")
    return known


def _means(i: Inputs, signals: list[str]) -> DataFrame:
    """The per-step means of the signals, each by the first of its names with any value for an entity. A signal that the
    samples have takes their means where it is missing for an entity, and has them as raw_<signal>, too."""
    names = _resolved(signals, i.series)
    rows = i.series
    for s, cols in names.items():
        if len(cols) > 1:
            rows = series.chosen_alias(rows, "entity", cols, "_chosen").drop("_chosen_from").withColumn(s, F.col("_chosen")).drop("_chosen")
        elif cols[0] != s:
            rows = rows.withColumn(s, F.col(cols[0]))
    have = [s for s in signals if i.samples is not None and s in i.samples.columns]
    if not have:
        return series.per_step_mean(rows, "entity", "step", signals)
    made = series.with_raw_series(rows, i.samples, "entity", "step", have, keep_raw=True)
    rest = [s for s in signals if s not in have]
    return made.join(series.per_step_mean(rows, "entity", "step", rest), ["entity", "step"], "full_outer") if rest else made


def _picked(rows: DataFrame, picks: dict[str, Column]) -> DataFrame:
    return rows.groupBy("entity").agg(*[c.alias(n) for n, c in picks.items()])


def _all_curves(samples: DataFrame, wanted: list[tuple[curves.Curve, dict[str, tuple[int | None, str]]]]) -> DataFrame:
    """(entity, columns): the named statistics of all wanted curves, by one pass over the samples."""
    distinct = list(dict.fromkeys(c for c, _ in wanted))
    used = [stat for _, named in wanted for _, stat in named.values()]
    aggs = tuple(u.removeprefix("shape_") for u in dict.fromkeys(used) if u.startswith("shape_"))
    hows = tuple(dict.fromkeys(u.removesuffix(f"_{x}") for u in used if not u.startswith("shape_") for x in curves.DIFFERENCE if u.endswith(f"_{x}") and u.removesuffix(f"_{x}") in curves.TRANSFORMS))
    made = curves.curve_stats(samples, "entity", "step", "x", distinct, "kind" if any(c.kind for c in distinct) else None, aggs, hows)
    out = {}
    for c, named in wanted:
        for name, (slot, stat) in named.items():
            holds = f"task = {distinct.index(c)}" + (f" AND slot = {int(slot)}" if slot is not None else "")
            out[name] = F.expr(f"max(CASE WHEN {holds} THEN {stat} END)")
    return made.groupBy("entity").agg(*[c.alias(n) for n, c in out.items()])


def parts(program: Program, inputs: Inputs, strict: bool = False) -> tuple[list[DataFrame], list[Status]]:
    """The frames of a program and each specification's status. All aggregates of the series are one frame, all picks from
    the samples' rows one, all curves one; of one name, the later frame's feature counts.

    A specification that cannot be planned (an unknown operator or column) is marked as failed; ``strict`` raises. That
    follows from the schemas: nothing is analysed for it.
    """
    i = inputs if requires_samples(program) else replace(inputs, samples=None)
    frames, status, cols, signals, wanted = [], [], series.Derived(), [], []
    picks: dict[str, dict[str, Column]] = {"samples": {}, "series": {}}
    for s in program.specs:
        if not s.enabled:
            status.append(Status(s.operator, "disabled"))
            continue
        if s.operator == "protocol" and not program.include_protocol:
            status.append(Status(s.operator, "skipped", 0, ["protocol columns are not included"]))
            continue
        try:
            build, about = registry.get(s.operator), registry.about(s.operator)
            made = build(s, i)
            named = series.Derived()
            if "columns" in about:
                _resolved([s.signal], i.series)
                named = about["columns"](s, i)
            picked = about["picks"](s, i) if "picks" in about else {}
            curve = None
            if "curves" in about:
                _resolved([s.signal], i.samples)
                curve = about["curves"](s, i)
            if named.columns:
                cols |= named
                signals.append(s.signal)
            picks["samples" if _in_samples(s, i) else "series"] |= picked
            if curve:
                wanted.append(curve)
            if made is not None:
                frames.append(made)
            n = len(named.columns | picked) + (len(curve[1]) if curve else 0) + (len(made.columns) - 1 if made is not None else 0)
            status.append(Status(s.operator, "ok" if n else "warning", n, [] if n else ["no feature"]))
        except Exception as e:
            if strict:
                raise
            status.append(Status(s.operator, "failed", 0, [f"{s.operator} failed: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"]))
    shared = []
    if cols.columns:
        shared.append(cols.of(_means(i, list(dict.fromkeys(signals))), "entity"))
    shared += [_picked(i.samples if where == "samples" else i.series, found) for where, found in picks.items() if found]
    if wanted:
        shared.append(_all_curves(i.samples, wanted))
    return shared + frames, status


def long_features(program: Program, inputs: Inputs, strict: bool = False) -> DataFrame:
    """(entity, feature, value) without nulls; of features of one name the later operator's is kept."""
    frames, _ = parts(program, inputs, strict)
    later, out = set(), None
    for f in reversed(frames):
        names = [c for c in f.columns if c != "entity" and c not in later]
        later.update(names)
        if names:
            pairs = ", ".join(f"'{c.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}', CAST(`{c.replace('`', '``')}` AS DOUBLE)" for c in names)
            one = f.select("entity", F.expr(f"stack({len(names)}, {pairs}) AS (feature, value)")).where("value IS NOT NULL")
            out = one if out is None else out.unionByName(one)
    return out


def joined(frames: list[DataFrame]) -> DataFrame:
    out = None
    for f in frames:
        out = f if out is None else out.drop(*[c for c in f.columns if c != "entity" and c in out.columns]).join(f, "entity", "full_outer")
    return out


def wide_features(program: Program, inputs: Inputs, prune: bool = True, strict: bool = False) -> DataFrame:
    """One row an entity with all features; columns without any value are dropped after one counting pass."""
    out = joined(parts(program, inputs, strict)[0])
    return pruned(out, ["entity"]) if prune else out


@dataclass
class Result:
    """A built table: ``features`` (entity and columns), ``metadata`` (a row a feature), ``exclusions`` (entity, reason),
    ``statuses`` a specification, ``pruned`` columns without any value, and the ``card`` of counts."""

    features: DataFrame
    metadata: DataFrame
    exclusions: DataFrame
    statuses: list[Status]
    pruned: list[str]
    card: dict


def status_counts(statuses: list[Status], most: int = 10) -> list[dict]:
    """Per operator: how often each status, how many warnings, and the first of them."""
    out = []
    for name in sorted({s.operator for s in statuses}):
        own = [s for s in statuses if s.operator == name]
        warnings = [w for s in own for w in s.warnings]
        out.append({"operator": name, "statuses": {k: sum(s.status == k for s in own) for k in sorted({s.status for s in own})}, "warnings": len(warnings), "preview": warnings[:most]})
    return out


def build_table(program: Program, inputs: Inputs, manifest: DataFrame, key: str = "entity", payload: str | None = None, strict: bool = False) -> Result:
    """The feature table of a manifest's entities, with what was left out and why.

    An entity that no input holds (with ``payload``: whose payload column is null) is an exclusion, not a row.
    """
    frames, statuses = parts(program, inputs, strict)
    spark = manifest.sparkSession
    wanted = manifest.select(F.col(key).alias("entity"), *([payload] if payload else [])).dropDuplicates(["entity"])
    made = joined(frames) if frames else spark.createDataFrame([], manifest.select(F.col(key).alias("entity")).schema)
    there = inputs.series.select("entity").distinct().withColumn("_there", F.lit(True))
    marked = wanted.join(there, "entity", "left")
    reason = F.when(F.col("_there").isNull(), "no input rows")
    if payload:
        reason = F.when(F.col(payload).isNull(), "no payload").otherwise(reason)
    marked = marked.withColumn("reason", reason)
    exclusions = marked.where("reason IS NOT NULL").select("entity", F.lit("feature_program").alias("stage"), "reason")
    rows = marked.where("reason IS NULL").select("entity").join(made, "entity", "left")
    names = [c for c in rows.columns if c != "entity"]
    seen = rows.agg(F.count("*").alias("|n"), *[F.count(c).alias(c) for c in names]).first()
    empty = [c for c in names if not seen[c]]
    rows = rows.drop(*empty)
    about = metadata(spark, program).where(F.col("feature").isin(*rows.columns))
    families = {r.family: r.n for r in about.groupBy("family").agg(F.count("*").alias("n")).collect()}  # a few rows
    n_out = exclusions.count()
    card = {
        "program": program.name, "entities_requested": seen["|n"] + n_out, "entities_featurized": seen["|n"], "entities_excluded": n_out, "pruned_features": len(empty),
        "pruned_preview": empty[:25], "families": families, "convention": program.convention, "operators": status_counts(statuses),
        "curve_features": any(f.startswith("curve") for f in families), "protocol_features": "protocol" in families,
    }
    return Result(rows, about, exclusions, statuses, empty, card)


def json_ready(value):
    """A value as JSON has it: no NaN or infinity, text keys, lists."""
    if isinstance(value, dict):
        return {str(k): json_ready(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [json_ready(v) for v in value]
    if hasattr(value, "item"):
        value = value.item()
    return None if isinstance(value, float) and (value != value or abs(value) == float("inf")) else value


def card_text(card: dict) -> str:
    """A dataset card as Markdown."""
    lines = [f"# {card['program']}", ""]
    lines += [f"- {k.replace('_', ' ')}: `{v}`" for k, v in card.items() if not isinstance(v, (dict, list)) and k != "program"]
    lines += ["", "## Features by family", ""] + ([f"- `{k}`: {v}" for k, v in sorted(card["families"].items())] or ["- none"])
    return "\n".join(lines) + "\n"


def write_result(result: Result, path: str, program: Program) -> None:
    """The table, its metadata and exclusions as Parquet under ``path``; program, card and its text beside them, written
    by Spark, so that any file system does."""
    spark = result.features.sparkSession
    for name, frame in (("features", result.features), ("metadata", result.metadata), ("exclusions", result.exclusions)):
        frame.write.mode("overwrite").parquet(f"{path}/{name}")
    texts = {"program": program.to_json(), "card": json.dumps(json_ready(result.card), sort_keys=True, indent=2), "card_text": card_text(result.card)}
    for name, text in texts.items():
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def safe_name(text: str) -> str:
    """A name for a column: minus, point and space written as letters and underscores."""
    return text.replace("-", "m").replace(".", "p").replace(" ", "_")


def pruned(df: DataFrame, keep: list[str]) -> DataFrame:
    """``df`` without columns that are null throughout."""
    rest = [c for c in df.columns if c not in keep]
    if not rest:
        return df
    seen = df.agg(*[F.count(c).alias(c) for c in rest]).first()
    return df.drop(*[c for c in rest if not seen[c]])


# The family of a signal's features by a part of its name.
FAMILIES = (("capacity", "capacity_summary"), ("resistance", "resistance_summary"), ("temp", "thermal_summary"), ("energy", "energy_summary"))


def family_of(signal: str, default: str) -> str:
    return next((family for word, family in FAMILIES if word in signal.lower()), default)


def feature_names(s: Spec) -> list[str]:
    p, g = s.params, s.signal
    if s.operator == "value_at_step":
        return [f"{g}{'' if a == 'last' else '_' + a}_step_{c}" for c in p["steps"] for a in p.get("aggs", ["last"])]
    if s.operator == "window_stats":
        return [f"{g}_{t}_{a}_{b}" for a, b in p["windows"] for t in p.get("stats", WINDOW_STATS)]
    if s.operator == "step_delta":
        return [f"{g}_{h}_{a}_{b}" for a, b in p["pairs"] for h in p["how"]]
    if s.operator == "curve_shape":
        return [f"{g}_{p['kind_value']}_{a}_at_{c}" for c in p["steps"] for a in p["aggs"]]
    if s.operator == "curve_delta":
        return [f"{g}_{t}_{x}_{p['pair'][0]}_{p['pair'][1]}" for t in p["transforms"] for x in p["aggs"]]
    return []


def metadata(spark: SparkSession, program: Program, prefix: str = "") -> DataFrame:
    """One row a feature with its provenance, made from the program alone; ``prefix`` goes before each name."""
    rows, seen = [], set()
    for s in program.specs:
        if s.enabled:
            family = s.family or family_of(s.signal, "other") + ("_delta" if s.operator == "step_delta" else "")
            for n in feature_names(s):
                if n not in seen:
                    seen.add(n)
                    rows.append((prefix + n, family, s.operator, s.signal, json.dumps(s.params, sort_keys=True), program.name, program.convention))
    return spark.createDataFrame(rows, "feature string, family string, operator string, signal string, params string, program string, convention string")


# Other names that a signal's column may have.
SIGNAL_ALIASES = {"internal_resistance": ["dc_internal_resistance"], "temperature": ["temperature_average"]}

# Fixed values of the recipes: signals, steps, windows and statistics.
SIGNALS = ["discharge_capacity", "charge_capacity", "internal_resistance", "temperature", "discharge_energy", "charge_energy"]
SCALAR_STEPS = [0, 1, 2, 4, 9, 10, 49, 99]
WINDOW_STATS = ["mean", "std", "min", "max", "delta", "slope", "intercept", "r2", "curvature"]
DELTA_AGGS = ["min", "max", "mean", "std", "var", "log_var", "skew", "sum_abs", "sum_sq", "area_abs", "area_signed"]
SHAPE_AGGS = ["min", "max", "mean", "std", "var", "area", "gradient"]
SHAPE_SIGNALS = ["discharge_capacity", "charge_capacity", "current", "temperature"]


def _scalars(first: int) -> list[Spec]:
    late = min(99, first - 1)
    out = []
    for s in SIGNALS:
        out += [
            Spec("value_at_step", s, {"steps": SCALAR_STEPS, "aggs": ["last", "mean"]}),
            Spec("window_stats", s, {"windows": [[0, 4], [0, 9], [0, 49], [0, late], [10, late]], "stats": WINDOW_STATS}),
            Spec("step_delta", s, {"pairs": [[0, 9], [1, late], [9, late]], "how": ["difference", "ratio", "relative", "log"]}),
        ]
    return out


def _difference(early: int, late: int, transforms: list[str], aggs: list[str], window=None) -> Spec:
    return Spec("curve_delta", "discharge_capacity", {"pair": [early, late], "kind_value": "discharge", "transforms": transforms, "aggs": aggs, "window": window}, family="curve_delta")


def recipe(name: str, first: int = 100, early: int = 9, late: int = 99, window=None) -> Program:
    """A ready program by name."""
    if name == "scalar_baseline":
        return Program(name, _scalars(first), first_steps=first)
    if name == "curve_delta":
        return Program(name, [_difference(early, late, ["identity", "abs", "log_abs"], DELTA_AGGS, window)], first_steps=max(late + 1, 100))
    if name == "literature":
        q = "discharge_capacity"
        return Program(name, [
            Spec("value_at_step", q, {"steps": [1, early, late], "aggs": ["last"]}),
            Spec("window_stats", q, {"windows": [[0, late], [max(0, late - 8), late]], "stats": ["max", "delta", "slope", "intercept"]}),
            _difference(early, late, ["identity", "log_abs"], ["min", "mean", "var", "log_var", "skew", "sum_abs", "sum_sq"]),
        ], first_steps=max(late + 1, 100))
    if name == "broad_physics":
        end = max(1, first - 1)
        shapes = [Spec("curve_shape", s, {"steps": [0, 1, 9, min(49, end), end], "kind_value": k, "aggs": SHAPE_AGGS, "window": window}, family="curve_shape") for k in ("discharge", "charge") for s in SHAPE_SIGNALS]
        return Program(name, [*_scalars(first), *shapes, _difference(9, end, ["identity", "abs", "log_abs"], DELTA_AGGS, window), Spec("learned_embedding_placeholder", "", enabled=False), Spec("generic_timeseries_placeholder", "", enabled=False)], first_steps=first)
    if name == "minimal_debug":
        q = "discharge_capacity"
        return Program(name, [Spec("value_at_step", q, {"steps": [0, 1, 9], "aggs": ["last"]}), Spec("step_delta", q, {"pairs": [[0, 9]], "how": ["difference", "log"]})], first_steps=10)
    raise KeyError(f"no recipe named {name}")


def recipes() -> list[str]:
    return sorted(["scalar_baseline", "curve_delta", "literature", "broad_physics", "minimal_debug"])
