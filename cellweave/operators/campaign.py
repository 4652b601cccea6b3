"""Aggregation and selection over the rows of an experiment campaign."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def config_aggregate(rows: DataFrame, key: list[str], metric: str, run: str, seed: str, others: list[str], examples: list[str] = [], order: list[str] = []) -> DataFrame:
    """Per configuration: evaluations, distinct runs and seeds, both sorted in one text, and the metric's statistics; the
    sample deviation of a single evaluation is 0. ``examples``: columns of its first row in ``order``."""
    first = [F.min_by(c, F.struct(*order)).alias(f"example_{c}") for c in examples]
    seeds, runs = F.collect_set(seed), F.collect_set(F.col(run).cast("string"))
    return rows.groupBy(*key).agg(
        *first, F.array_join(F.transform(F.array_sort(seeds), lambda x: x.cast("string")), ";").alias("seeds"),
        F.count("*").alias("n_evals"), F.size(runs).cast("long").alias("n_runs"), F.size(seeds).cast("long").alias("n_seeds"),
        F.array_join(F.array_sort(runs), ";").alias("runs"),
        F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("std"), F.min(metric).alias("min"), F.max(metric).alias("max"),
        *[F.avg(c).alias(f"mean_{c}") for c in others],
    )


def selection(aggregated: DataFrame, bias: str, least_evals: int = 2) -> DataFrame:
    """Eligible configurations with their selection score: mean, a quarter of the deviation, a tenth of the bias."""
    score = F.col("mean") + 0.25 * F.col("std") + 0.10 * F.abs(F.col(bias))
    return aggregated.withColumn("score", score).where(F.col("n_evals") >= least_evals)


def shortlist(scored: DataFrame, k: int, *ties: str) -> DataFrame:
    return scored.orderBy("score", "mean", "std", *ties).limit(k)


def leaderboard_best(rows: DataFrame, by: str, metric: str, *ties: str) -> DataFrame:
    """The best successful row for each value of ``by``."""
    order = Window.partitionBy(by).orderBy(F.col(metric).asc_nulls_last(), *ties)
    return rows.where("success").withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def failure_summary(rows: DataFrame, kind: str, reason: str, k: int = 10) -> DataFrame:
    """The most frequent failures; nulls are a kind of their own."""
    return rows.groupBy(kind, reason).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col(kind).asc_nulls_first(), F.col(reason).asc_nulls_first()).limit(k)


def bumped(memory: str, seconds: str, most_memory: int = 256, most_seconds: int = 7 * 86400 - 60) -> list[Column]:
    """Twice the resources, capped."""
    return [F.least(2 * F.col(memory), F.lit(most_memory)).alias(memory), F.least(2 * F.col(seconds), F.lit(most_seconds)).alias(seconds)]


def last_rows(rows: DataFrame, order: str, k: int = 10) -> DataFrame:
    return rows.orderBy(F.col(order).desc()).limit(k)


def head_and_tail(rows: DataFrame, by: str, order: str, k: int, *ties: str) -> DataFrame:
    """The first and last k rows of each group."""
    up = F.row_number().over(Window.partitionBy(by).orderBy(order, *ties))
    down = F.row_number().over(Window.partitionBy(by).orderBy(F.col(order).desc(), *[F.col(t).desc() for t in ties]))
    return rows.withColumn("_u", up).withColumn("_d", down).where((F.col("_u") <= k) | (F.col("_d") <= k)).withColumn("place", F.when(F.col("_u") <= k, "head").otherwise("tail")).drop("_u", "_d")


def review_status(verdict: str | Column, issues: str | Column, success: str | Column) -> Column:
    """The final word on a candidate: a doubtful verdict passes where the evaluation succeeded, with warnings if any."""
    v, i, ok = (F.col(x) if isinstance(x, str) else x for x in (verdict, issues, success))
    low = F.lower(F.coalesce(v, F.lit("unknown")))
    return F.when(low == "pass", "pass").when(F.coalesce(ok, F.lit(False)) & (low == "needs_attention"), F.when(F.size(i) > 0, "pass_with_warnings").otherwise("pass")).otherwise(low)


def metric_rows(candidates: DataFrame, reviews: DataFrame, evaluations: DataFrame, key: str = "candidate_id") -> DataFrame:
    """One row an evaluated candidate: its settings, its final review and its metrics."""
    both = evaluations.join(candidates, key).join(reviews.select(key, "verdict", "issues"), key, "left")
    return both.withColumn("review_status", review_status("verdict", F.coalesce("issues", F.array().cast("array<string>")), "success")).drop("issues")


def deduplicated(rows: DataFrame, config: str, metric: str, *ties: str) -> tuple[DataFrame, DataFrame]:
    """The best successful row of each configuration, best first by the metric, and one row of counts."""
    good = rows.where(F.col("success") & F.col(metric).isNotNull())
    best = good.withColumn("_k", F.row_number().over(Window.partitionBy(config).orderBy(metric, *ties)))
    counts = best.agg(F.count("*").alias("n_successful"), F.count_if(F.col("_k") == 1).alias("n_unique"), F.count_if(F.col("_k") > 1).alias("n_pruned"))
    return best.where("_k = 1").drop("_k"), counts


def best_successful(rows: DataFrame, metric: str, *ties: str) -> DataFrame:
    """One row: the successful one with the least metric; none without any."""
    return rows.where(F.col("success") & F.col(metric).isNotNull()).orderBy(metric, *ties).limit(1)


# Words in a candidate's code and what they tell of it, first match first.
MODEL_WORDS = (("GradientBoostingRegressor", "gradientboostingregressor"), ("RandomForestRegressor", "randomforestregressor"), ("ElasticNet", "elasticnet"), ("Ridge", "ridge"), ("LinearRegression", "linearregression"), ("CandidateModel", "candidatemodel"))
FEATURE_WORDS = (
    ("early discharge capacity", "capacity|q"), ("max early capacity change", "max_delta|nanmax"), ("late-cycle capacity slope", "slope|polyfit"),
    ("difference between cycle 10 and cycle N curves", "diff"), ("log-transformed curve statistics", "log"), ("energy-like integral changes", "trapz|integr|energy"), ("protocol current features", "protocol|c1"),
)


def model_class(code: str | Column) -> Column:
    """The estimator that a code names, else ``unknown``."""
    low = F.lower(F.col(code) if isinstance(code, str) else code)
    out = F.lit("unknown")
    for name, word in reversed(MODEL_WORDS):
        out = F.when(F.contains(low, F.lit(word)), F.lit(name)).otherwise(out)
    return out


def feature_tags(code: str | Column) -> Column:
    """The sorted kinds of features that a code's words tell of."""
    low = F.lower(F.col(code) if isinstance(code, str) else code)
    return F.array_sort(F.array_compact(F.array(*[F.when(low.rlike(word), F.lit(name)) for name, word in FEATURE_WORDS])))


def code_problems(lines: DataFrame, key: str, rules: dict[str, str], allowed: str | None = None) -> DataFrame:
    """(key, line, rule): the lines of code (key, line, text) that a rule's pattern is in, but for those that the pattern
    of allowed contexts is in."""
    rows = lines if allowed is None else lines.where(~F.lower("text").rlike(allowed))
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in rules.items()]))
    return rows.select(key, "line", F.explode(hits).alias("rule"))


# The recipes that a path may name, first match first.
RECIPES = ("minimal_debug", "scalar_baseline", "curve_delta", "broad_physics", "literature")


def run_recipe(recipe: str, *paths: str) -> Column:
    """A run's recipe: its field, else one that its paths name, else the part of a run's folder name, else ``unknown``."""
    text = F.concat_ws(" ", *[F.col(p) for p in paths])
    named = F.lit(None).cast("string")
    for r in reversed(RECIPES):
        named = F.when(F.contains(text, F.lit(r)), F.lit(r)).otherwise(named)
    folder = F.regexp_extract(F.col(paths[-1]), r"trackA_([^/]+?)_(?:random|batch|protocol|leave_one_batch_out)_", 1)
    return F.coalesce(F.nullif(F.col(recipe), F.lit("")), named, F.nullif(folder, F.lit("")), F.lit("unknown"))


def recipe_settings(path: str | Column, recipe: str | None = None, early: str | None = None, late: str | None = None) -> list[Column]:
    """Recipe and steps of a feature table's folder name ``<prefix>_<recipe>_idx<early>_<late>``; given columns go first."""
    x = F.regexp_replace(F.col(path) if isinstance(path, str) else path, r"/?(feature_table\.csv)?/?$", "")
    stem = F.element_at(F.split(x, "/"), -1)
    head = F.regexp_replace(F.regexp_replace(stem, r"_idx.*$", ""), r"^(oed|batch9|all)_", "")
    steps = [F.regexp_extract(stem, r"_idx(\d+)_(\d+)$", i).try_cast("int") for i in (1, 2)]
    given = lambda c, kind: F.nullif(F.col(c).cast("string"), F.lit("")).try_cast(kind) if c else F.lit(None).cast(kind)
    a, b = F.coalesce(given(early, "int"), steps[0], F.lit(9)), F.coalesce(given(late, "int"), steps[1], F.lit(99))
    named = F.coalesce(given(recipe, "string"), F.when(F.contains(stem, F.lit("_idx")), F.nullif(head, F.lit(""))))
    return [named.alias("recipe"), a.alias("early"), b.alias("late"), F.greatest(b + 1, F.lit(100)).alias("first_steps")]


def full_runs(runs: DataFrame, iterations: int = 8, candidates: int = 20) -> DataFrame:
    """The runs of full length whose locked test was not touched; a status that is missing means that."""
    have = [c for c in ("locked_secondary_test_status", "locked_batch9_status") if c in runs.columns]
    status = F.coalesce(*[F.col(c) for c in have], F.lit("not_run"))
    return runs.where((F.col("iterations") == iterations) & (F.col("candidates_per_iteration") == candidates) & (status == "not_run"))


def candidate_records(rows: DataFrame) -> DataFrame:
    """Candidates under one set of names, whichever of a metric's names a table has, without those that lack the metric."""
    known = set(rows.columns)
    either = lambda n: F.coalesce(*[F.col(c).cast("double") for c in (n, f"best_{n}") if c in known]) if known & {n, f"best_{n}"} else F.lit(None).cast("double")
    text = lambda n: F.coalesce(*[F.col(c).cast("string") for c in (n, f"best_{n}") if c in known], F.lit("")) if known & {n, f"best_{n}"} else F.lit("")
    keep = [c for c in ("candidate_id", "run_id", "recipe", "split_mode", "split_seed") if c in known]
    out = rows.select(*keep, *[text(n).alias(n) for n in ("model_family", "feature_set", "target_transform")], *[either(n).alias(f"surrogate_{n}") for n in ("rmse", "mae", "mape", "spearman", "kendall", "r2")])
    return out.where(F.col("surrogate_rmse").isNotNull() & ~F.isnan("surrogate_rmse"))


def example_rows(aggregated: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each aggregate with its example candidate's row: of the same run, else the first of that id by run."""
    own = candidates.select("candidate_id", "run_id", F.struct(*candidates.columns).alias("c"))
    exact = own.groupBy("candidate_id", "run_id").agg(F.min_by("c", "run_id").alias("exact"))
    first = own.groupBy("candidate_id").agg(F.min_by("c", "run_id").alias("any"))
    a = aggregated.withColumnsRenamed({"example_candidate_id": "candidate_id", "example_run_id": "run_id"})
    both = a.join(exact, ["candidate_id", "run_id"], "left").join(first, "candidate_id", "left")
    return both.withColumn("example", F.coalesce("exact", "any")).where("example IS NOT NULL").drop("exact", "any")


def campaign_summary(runs: DataFrame, candidates: DataFrame, aggregated: DataFrame, k: int = 40) -> dict[str, DataFrame]:
    """The campaign's tables: each run's best candidate by its metric, the best configurations with an example each, and
    how many runs each recipe has by split mode."""
    best = candidate_records(runs.withColumnRenamed("best_candidate_id", "candidate_id")).orderBy("surrogate_rmse", "run_id")
    eligible = example_rows(aggregated.orderBy("score", "example_candidate_id").limit(k), candidates)
    counts = runs.groupBy("split_mode", "recipe").agg(F.count("*").alias("n"))
    return {"per_run": best, "eligible": eligible, "recipes": counts}


def shortlist_entries(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` best entries that are whole: a name, a run, a seed and four metrics, numbers written as texts included."""
    number = lambda c: F.col(c).cast("string").try_cast("double")
    metrics = ["surrogate_rmse", "surrogate_mae", "surrogate_mape", "surrogate_spearman"]
    made = rows.withColumns({m: number(m) for m in metrics} | {"split_seed": number("split_seed").cast("int")})
    for c in ("candidate_id", "run_id"):
        made = made.where(F.trim(c) != "")
    for c in (*metrics, "split_seed"):
        made = made.where(F.col(c).isNotNull())
    order = ["surrogate_rmse", "candidate_id", "run_id"]
    top = made.orderBy(*order).limit(k)
    return top.withColumn("rank_in_shortlist", F.row_number().over(Window.orderBy(*order)))  # k rows


def with_secondary(shortlist: DataFrame, leaderboard: DataFrame, order: str) -> DataFrame:
    """The shortlist left-joined to a leaderboard's other columns; of rows with one id the last by ``order`` counts."""
    new = [c for c in leaderboard.columns if c not in shortlist.columns]
    last = leaderboard.groupBy("candidate_id").agg(F.max_by(F.struct(*new), order).alias("l"))
    return shortlist.join(last, "candidate_id", "left").select(*shortlist.columns, *[F.col(f"l.{c}").alias(c) for c in new])


def champions(shortlist: DataFrame, metric: str) -> DataFrame:
    """The champion and the runner-up of a shortlist by a metric."""
    top = shortlist.where(F.col(metric).isNotNull()).orderBy(metric, "candidate_id").limit(2)
    place = F.row_number().over(Window.orderBy(metric, "candidate_id"))  # two rows
    return top.withColumn("title", F.when(place == 1, "champion").otherwise("runner_up"))


def doubled_time(text: str | Column, most: int = 7 * 86400 - 60) -> Column:
    """Twice a time written H:MM:SS, capped; what is not of that form becomes 12:00:00."""
    x = F.col(text) if isinstance(text, str) else text
    p = F.transform(F.split(x, ":"), lambda v: v.try_cast("int"))
    total = F.least(2 * (F.get(p, F.lit(0)) * 3600 + F.get(p, F.lit(1)) * 60 + F.get(p, F.lit(2))), F.lit(most))
    made = F.format_string("%d:%02d:%02d", F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60)
    return F.when((F.size(p) == 3) & total.isNotNull(), made).otherwise("12:00:00")


def job_states(jobs: DataFrame, queue: DataFrame, accounting: DataFrame) -> DataFrame:
    """``jobs`` (job_id, ...) with ``state``: the queue's, else the accounting's of the whole job, else ``UNKNOWN``; and
    whether the job is over."""
    q = queue.groupBy("job_id").agg(F.max("state").alias("_q"))
    a = accounting.where(~F.contains("job_id", F.lit("."))).groupBy("job_id").agg(F.max("state").alias("_a"))
    both = jobs.join(q, "job_id", "left").join(a, "job_id", "left")
    return both.withColumn("state", F.coalesce("_q", "_a", F.lit("UNKNOWN"))).withColumn("over", F.col("_q").isNull() & F.col("_a").isNotNull()).drop("_q", "_a")


def job_actions(jobs: DataFrame, fixable: list[str] = ["OOM", "TIMEOUT", "DEADLINE", "NODE_FAIL", "TRANSIENT"]) -> DataFrame:
    """What becomes of jobs that are over (state, class, resubmits, max_resubmits, mem_gb, time): completed, halted for a
    person, or resubmitted, with more memory or time where that was lacking."""
    done = F.startswith(F.upper("state"), F.lit("COMPLETED"))
    spent = F.col("resubmits") >= F.col("max_resubmits")
    action = F.when(done, "completed").when(spent, "halt-max-resubmits").when(~F.col("class").isin(fixable), "halt-needs-human").otherwise("resubmitted")
    again = F.col("action") == "resubmitted"
    return (
        jobs.withColumn("action", action)
        .withColumn("mem_gb", F.when(again & (F.col("class") == "OOM"), F.least(2 * F.col("mem_gb"), F.lit(256))).otherwise(F.col("mem_gb")))
        .withColumn("time", F.when(again & F.col("class").isin("TIMEOUT", "DEADLINE"), doubled_time("time")).otherwise(F.col("time")))
        .withColumn("resubmits", F.col("resubmits") + F.when(again, 1).otherwise(0))
        .withColumn("needs_human", F.startswith("action", F.lit("halt")))
    )


def markdown(rows: DataFrame, columns: list[str], most: int = 1000) -> str:
    """A small table as Markdown: at most ``most`` rows, numbers of six digits, long texts cut."""
    def cell(v) -> str:
        text = "" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
        return text if len(text) <= 80 else text[:77] + "..."

    got = rows.select(*columns).limit(most).collect()
    lines = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in got]) if got else "No rows."
