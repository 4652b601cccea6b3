"""Seven calls over the operators, each timed, named by a hash of its arguments and written to a trace.

``Tools(spark, trace)`` has them as methods; each gives a ``Response`` and never raises.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import campaign, evaluation, relational
from .plans import candidates, entity_features, program
from .sources.payload import append_events

CALLS = ("profile_dataset", "build_battery_features", "list_feature_programs", "review_candidate", "evaluate_candidate", "compare_runs", "list_tools")


@dataclass
class Response:
    """``values``: small results by name; ``frames``: tables that are lazy plans."""

    tool: str
    success: bool
    values: dict = field(default_factory=dict)
    frames: dict[str, DataFrame] = field(default_factory=dict)
    error_type: str | None = None
    error: str | None = None
    request: str = ""
    milliseconds: float = 0.0


class Tools:
    """``trace``: a folder that each call is appended to as a line of JSON; None: no trace."""

    def __init__(self, spark: SparkSession, trace: str | None = None):
        self.spark, self.trace = spark, trace

    def _handled(self, tool: str, request: dict, run: Callable[[], tuple[dict, dict]]) -> Response:
        began = time.perf_counter()
        name = hashlib.sha256(json.dumps(program.json_ready(request), sort_keys=True, default=str).encode()).hexdigest()
        try:
            values, frames = run()
            out = Response(tool, True, program.json_ready(values), frames, request=name)
        except Exception as e:
            out = Response(tool, False, error_type=type(e).__name__, error=str(e).splitlines()[0] if str(e) else "", request=name)
        out.milliseconds = (time.perf_counter() - began) * 1000
        if self.trace:
            row = (tool, name, out.success, out.error_type, out.error, out.milliseconds)
            append_events(self.spark.createDataFrame([row], "tool string, request string, success boolean, error_type string, error string, milliseconds double").coalesce(1), self.trace)
        return out

    def profile_dataset(self, metadata: DataFrame, steps: DataFrame, labels: DataFrame) -> Response:
        """Rows, missing values and distinct values of the tables' columns, the steps' range, rows a batch."""

        def run():
            span = steps.agg(F.count("*").alias("n"), F.min("cycle_index").alias("lo"), F.max("cycle_index").alias("hi")).first()
            frames = {name: relational.dataset_profile(t) for name, t in (("metadata", metadata), ("steps", steps), ("labels", labels))}
            frames |= {f"{c}_counts": metadata.groupBy(c).agg(F.count("*").alias("n")) for c in ("batch_id", "protocol_readable") if c in metadata.columns}
            return {"step_rows": span.n, "first_step": span.lo, "last_step": span.hi, **evaluation.label_sources(metadata, labels)}, frames

        return self._handled("profile_dataset", {"columns": [metadata.columns, steps.columns, labels.columns]}, run)

    def build_battery_features(self, metadata: DataFrame, steps: DataFrame, upto: int = 100, with_protocol: bool = True, tables: list[entity_features.FeatureTable] = [], families: list[str] | None = None) -> Response:
        """All early features of every entity, with each column's family."""

        def run():
            made, about = entity_features.all_features(metadata, steps, upto, with_protocol, tables, families)
            counts = {f: sum(x == f for x in about.values()) for f in sorted(set(about.values()))}
            return {"n_features": len(about), "families": counts, "columns": list(about)}, {"features": made}

        return self._handled("build_battery_features", {"upto": upto, "with_protocol": with_protocol, "tables": [t.name for t in tables], "families": families}, run)

    def list_feature_programs(self) -> Response:
        return self._handled("list_feature_programs", {}, lambda: ({"recipes": program.recipes(), "operators": program.registry.available()}, {}))

    def review_candidate(self, candidate: candidates.Candidate | str, allowed: str | None = None) -> Response:
        """A specification's standard form, or the lines of a code that break a rule; and a verdict."""
        rules = {"identifier": r"\b(?:" + "|".join(sorted(evaluation.IDENTIFIERS)) + r")\b", "file access": r"\bopen\(|\bread_(?:csv|json|parquet)\(", "process": r"\bsubprocess\b|\bos\.system\b", "network": r"\brequests\b|\burllib\b|\bsocket\b"}

        def run():
            if isinstance(candidate, candidates.Candidate):
                c = candidate.standard()
                dropped = sorted(set(candidate.settings) - set(c.settings))
                return {"verdict": "needs_attention" if dropped else "pass", "issues": [f"unknown setting: {d}" for d in dropped], "key": c.key()}, {}
            lines = self.spark.createDataFrame([("code", i + 1, t) for i, t in enumerate(candidate.splitlines())] or [("code", 1, "")], "name string, line int, text string")
            found = campaign.code_problems(lines, "name", rules, allowed)
            n = found.count()
            issues = [f"line {r.line}: {r.rule}" for r in found.orderBy("line", "rule").limit(100).collect()]  # all are in the frame
            return {"verdict": "needs_attention" if n else "pass", "issues": issues, "n_issues": n, "model": lines.select(campaign.model_class(F.lit(candidate))).first()[0]}, {"problems": found}

        return self._handled("review_candidate", {"candidate": candidate if isinstance(candidate, str) else candidate.key()}, run)

    def evaluate_candidate(self, candidate: candidates.Candidate, metadata: DataFrame, steps: DataFrame, labels: DataFrame, assignments: DataFrame | None = None, tables: list[entity_features.FeatureTable] = [], upto: int = 100, protocol: bool = False, limit: float | None = None) -> Response:
        """Fit a candidate on the training rows and score it on the validation rows, both from the assignments, within
        ``limit`` seconds."""

        def run():
            known = evaluation.finite_labels(labels)
            splits = evaluation.train_and_validation(known, assignments)
            judge = evaluation.HiddenEvaluator(metadata, steps, known, splits, upto, protocol, limit=limit)
            got = judge.evaluate(candidates.runnable(candidate, tables, upto, protocol))
            if not got.success:
                raise RuntimeError(f"{got.error_type}: {got.reason}")
            return {"metrics": got.metrics}, {"predictions": got.predictions}

        return self._handled("evaluate_candidate", {"candidate": candidate.key(), "upto": upto, "protocol": protocol}, run)

    def compare_runs(self, summary: DataFrame, run_ids: list[str] = []) -> Response:
        """The rows of a run summary, of the given runs if any are."""
        chosen = summary.where(F.col("run_id").cast("string").isin([str(r) for r in run_ids])) if run_ids else summary
        return self._handled("compare_runs", {"run_ids": run_ids}, lambda: ({"n_runs": chosen.count()}, {"runs": chosen}))

    def list_tools(self) -> Response:
        return self._handled("list_tools", {}, lambda: ({"tools": list(CALLS)}, {}))
