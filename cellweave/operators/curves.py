"""Operators over response curves: y against x, per entity, step and step kind.

Curves are resampled by segments: each point covers the grid places up to the next point, so a resampled curve is one
explode of its own points, without a join or Python. All curves that are wanted at once, whatever their signals, kinds,
steps and windows, go through one scan and one exchange of the samples.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import finite, g1_skew, transformed

SHAPE = ("min", "max", "mean", "std", "var", "skew", "area", "gradient")
DIFFERENCE = ("min", "max", "mean", "std", "var", "skew", "sum_abs", "sum_sq", "log_var", "area_abs", "area_signed")
TRANSFORMS = ("identity", "abs", "log_abs")


@dataclass(frozen=True)
class Curve:
    """A signal's curves at ``steps``, of one ``kind`` if given. ``pair``: of two steps, the later curve less the earlier
    one, on a grid over the x that both have. A ``window`` of x clips the points and is the grid's range."""

    signal: str
    steps: tuple[int, ...]
    pair: bool = False
    kind: str | None = None
    grid: int = 1000
    window: tuple[float, float] | None = None


def _each(wanted: list[Curve], of) -> Column:
    """What ``of`` gives for the row's curve."""
    values = [of(c) for c in wanted]
    if len(set(values)) == 1:
        return F.lit(values[0])
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("task") + 1)


def _points(samples: DataFrame, entity: str, step: str, x: str, wanted: list[Curve], kind: str | None) -> DataFrame:
    """(entity, slot, task, step, x, y): the finite points of each curve, repeated x averaged. A slot holds what belongs
    together: one step, or the two steps of a pair; all its points are in one partition."""
    taken = []
    for k, c in enumerate(wanted):
        holds = F.col("step").isin(*c.steps)
        if c.kind:
            holds &= F.col("kind") == c.kind.lower()
        if c.window and c.window[1] > c.window[0]:
            holds &= F.col("x").between(*map(float, c.window))
        taken.append(F.when(holds, F.struct(F.lit(k).alias("task"), (F.lit(-1 - k) if c.pair else F.col("step")).cast("long").alias("slot"), F.col(f"_{c.signal}").alias("y"))))
    signals = dict.fromkeys(c.signal for c in wanted)
    steps = dict.fromkeys(s for c in wanted for s in c.steps)
    rows = samples.where(F.col(step).isin(*steps)).select(F.col(entity).alias("entity"), F.col(step).alias("step"), finite(x).alias("x"), *([F.lower(F.trim(F.col(kind))).alias("kind")] if kind else []), *[finite(s).alias(f"_{s}") for s in signals])
    rows = rows.where("x IS NOT NULL").select("entity", "step", "x", F.explode(F.filter(F.array(*taken), lambda t: t.isNotNull() & t["y"].isNotNull())).alias("t"))
    rows = rows.select("entity", "t.slot", "t.task", "step", "x", "t.y").repartition("entity", "slot")
    return rows.groupBy("entity", "slot", "task", "step", "x").agg(F.avg("y").alias("y"))


def resampled(points: DataFrame, wanted: list[Curve]) -> DataFrame:
    """(entity, slot, task, i, h, d): the curve at even places of its range, or both of a pair's, of which the earlier one is
    negative; the ends of a window wider than the curve keep its end values. A curve of one x, or a pair that lacks one, has
    a row without i."""
    keys = ["entity", "slot", "task"]
    every, whole = Window.partitionBy(*keys, "step"), Window.partitionBy(*keys)
    by_x = every.orderBy("x")
    pair, grid = _each(wanted, lambda c: c.pair), _each(wanted, lambda c: max(2, c.grid))
    clipped = lambda c: bool(c.window and c.window[1] > c.window[0])
    p = points.withColumn("lo", F.min("x").over(every)).withColumn("hi", F.max("x").over(every)).withColumn("points", F.count("*").over(every))
    p = p.withColumn("x2", F.lead("x").over(by_x)).withColumn("y2", F.lead("y").over(by_x)).withColumn("x0", F.lag("x").over(by_x))
    both = F.lit(True)
    if any(c.pair for c in wanted):
        least, most = F.max("lo").over(whole), F.min("hi").over(whole)
        p = p.withColumn("both", F.min("step").over(whole) < F.max("step").over(whole))
        p = p.withColumns({"lo": F.when(pair, least).otherwise(F.col("lo")), "hi": F.when(pair, most).otherwise(F.col("hi"))})
        both = ~pair | F.col("both")
    if any(map(clipped, wanted)):
        fixed, ends = _each(wanted, clipped), [_each(wanted, lambda c, k=k: float(c.window[k]) if clipped(c) else 0.0) for k in (0, 1)]
        p = p.withColumns({n: F.when(fixed, e).otherwise(F.col(n)) for n, e in zip(("lo", "hi"), ends)})
    p = p.withColumn("valid", (F.col("points") >= 2) & (F.col("hi") > F.col("lo")) & both).withColumn("h", (F.col("hi") - F.col("lo")) / (grid - 1))
    place = lambda c: F.ceil((F.col(c) - F.col("lo")) / F.col("h"))
    i0 = F.when(F.col("x0").isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(grid, place("x"))))
    i1 = F.when(F.col("x2").isNull(), grid - 1).otherwise(F.least(grid - 1, F.greatest(F.lit(-1), place("x2") - 1)))
    p = p.withColumn("i0", i0.cast("int")).withColumn("i1", i1.cast("int"))
    p = p.withColumn("i", F.explode_outer(F.when(F.col("valid") & (F.col("i0") <= F.col("i1")), F.sequence("i0", "i1")))).where("i IS NOT NULL OR NOT valid")
    q = F.when(F.col("i") == grid - 1, F.col("hi")).otherwise(F.col("lo") + F.col("i") * F.col("h"))
    inside = F.col("y") + (F.col("y2") - F.col("y")) * (q - F.col("x")) / (F.col("x2") - F.col("x"))
    v = F.when(F.col("x2").isNull() | (q <= F.col("x")), F.col("y")).otherwise(inside)
    early = pair & (F.col("step") == _each(wanted, lambda c: c.steps[0]))
    return p.select(*keys, "i", "h", F.when(F.col("i").isNotNull(), F.when(early, -v).otherwise(v)).alias("d"))


def _shape(grid: Column) -> dict[str, Column]:
    at = lambda i: F.max(F.when(F.col("i") == i, F.col("d")))
    h, n = F.max("h"), F.max(grid)
    a, b, y, z = at(F.lit(0)), at(F.lit(1)), at(grid - 2), at(grid - 1)
    return {
        "min": F.min("d"), "max": F.max("d"), "mean": F.avg("d"), "std": F.stddev_pop("d"), "var": F.var_pop("d"), "skew": g1_skew("d"),
        "area": h * (F.sum("d") - (a + z) / 2),
        "gradient": ((b - a) + (z - y) + (z + y - b - a) / 2) / (h * n),
    }


def _difference(how: str, grid: Column, eps: float) -> dict[str, Column]:
    v = transformed(F.col("d"), how, eps)
    half = F.when((F.col("i") == 0) | (F.col("i") == grid - 1), 0.5).otherwise(1.0)
    return {
        "min": F.min(v), "max": F.max(v), "mean": F.avg(v), "std": F.stddev_pop(v), "var": F.var_pop(v),
        "skew": g1_skew(v), "sum_abs": F.sum(F.abs(v)), "sum_sq": F.sum(v * v), "log_var": F.log10(F.var_pop(v) + 1e-30),
        "area_abs": F.sum(F.abs(v) * half) * F.max("h"), "area_signed": F.sum(v * half) * F.max("h"),
    }


def curve_stats(samples: DataFrame, entity: str, step: str, x: str, wanted: list[Curve], kind: str | None = None, aggs: tuple[str, ...] = SHAPE, transforms: tuple[str, ...] = ("identity",), eps: float = 1e-12) -> DataFrame:
    """(entity, slot, task, columns) of all wanted curves in one pass: ``task`` is the curve's place in ``wanted``, ``slot``
    its step. Single curves have ``shape_<agg>``, pairs ``<transform>_<agg>``."""
    grid, pair = _each(wanted, lambda c: max(2, c.grid)), _each(wanted, lambda c: c.pair)
    keys, shapes, out = ["entity", "slot", "task"], {}, []
    if any(not c.pair for c in wanted):
        of = _shape(grid)
        shapes = {f"shape_{a}": of[a] for a in dict.fromkeys(aggs)}
    made = resampled(_points(samples, entity, step, x, wanted, kind), wanted)
    if not any(c.pair for c in wanted):
        return made.groupBy(*keys).agg(*[c.alias(n) for n, c in shapes.items()]).withColumnRenamed("entity", entity)
    # the two curves of a pair meet at each place; a single curve is one group, whose statistics are ready then
    met = made.groupBy(*keys, F.when(pair, F.col("i")).alias("place")).agg(F.max("h").alias("h"), F.sum("d").alias("both"), F.count("d").alias("n"), *[c.alias(n) for n, c in shapes.items()])
    made = met.withColumn("d", F.when(pair & (F.col("n") == 2), F.col("both"))).withColumn("i", F.col("place"))
    out = [F.max(F.when(~pair, F.col(n))).alias(n) for n in shapes]
    out += [c.alias(f"{how}_{a}") for how in dict.fromkeys(transforms) for a, c in _difference(how, grid, eps).items()]
    return made.groupBy("entity", "slot", "task").agg(*out).withColumnRenamed("entity", entity)


def curve_shape(samples: DataFrame, entity: str, step: str, x: str, y: str, steps: list[int], kind: str | None = None, kind_value: str | None = None, grid: int = 1000, aggs: tuple[str, ...] = SHAPE, window: tuple[float, float] | None = None) -> DataFrame:
    """(entity, step, one column an aggregate) of the resampled curves at the chosen steps.

    An entity and step with points but fewer than two distinct x has nulls.
    """
    one = Curve(y, tuple(dict.fromkeys(steps)), False, kind_value if kind else None, grid, window)
    made = curve_stats(samples, entity, step, x, [one], kind, aggs)
    return made.select(entity, F.col("slot").cast(dict(samples.dtypes)[step]).alias(step), *[F.col(f"shape_{a}").alias(f"{y}_{a}") for a in aggs])


def curve_delta(samples: DataFrame, entity: str, step: str, x: str, y: str, pair: tuple[int, int], kind: str | None = None, kind_value: str | None = None, grid: int = 1000, window: tuple[float, float] | None = None, transforms: tuple[str, ...] = ("identity",), later_less_earlier: bool = True, eps: float = 1e-12) -> DataFrame:
    """(entity, one column a transform and aggregate): the two steps' curves on a common grid, one less the other.

    The grid spans the x that both curves have, or the window. Entities that lack a curve or common x have nulls.
    """
    a, b = pair if later_less_earlier else pair[::-1]
    one = Curve(y, (a, b), True, kind_value if kind else None, grid, window)
    return curve_stats(samples, entity, step, x, [one], kind, (), transforms, eps).drop("slot", "task")
