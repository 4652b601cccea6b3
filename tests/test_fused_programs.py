"""Programs plan once: all curves by one scan, features of the series by one pass, failures known from the schemas."""

import re
import time

from pyspark.sql import functions as F

from cellweave.catalogue import recipes
from cellweave.operators import curves
from cellweave.plans import program as G

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_curves_take_one_scan_of_the_samples(spark):
    i, p = recipes._inputs(spark, SF), G.recipe("broad_physics", first=8)
    only = G.Program("curves", [s for s in p.specs if s.operator.startswith("curve")])
    assert len(only.specs) == 9
    frames, status = G.parts(only, i)
    assert len(frames) == 1 and all(s.status == "ok" for s in status)
    text = plan(frames[0])
    assert len(re.findall(r"Scan parquet", text)) == 1
    assert text.count("Exchange") - text.count("AQEShuffleRead") <= 2  # the points, and the entities' rows


def test_broad_physics_is_planned_quickly(spark):
    i, p = recipes._inputs(spark, SF), G.recipe("broad_physics", first=8)
    G.long_features(p, i)
    began = time.time()
    G.long_features(p, i)
    assert time.time() - began < 25  # seconds; about 3 on an idle machine, 30 before curves and moments were planned together


def test_a_curve_with_its_own_grid_and_window(spark):
    """Curves of several grids and windows in one pass are those that each gives alone."""
    rows = [(e, c, k, float(x), float((x * (e + 2) + c) % 7)) for e in range(3) for c in (1, 2) for k in ("up", " UP ", "down") for x in range(9)]
    rows += [(7, 1, "up", 1.0, 2.0), (8, 1, "up", None, 2.0), (9, 2, "up", 1.0, float("nan"))]
    df = spark.createDataFrame(rows, "entity int, step int, kind string, x double, y double")
    wanted = [curves.Curve("y", (1, 2), False, "up", 50), curves.Curve("y", (2,), False, None, 11, (2.0, 6.0)), curves.Curve("y", (1, 2), True, "UP", 30), curves.Curve("y", (2, 1), True, None, 20, (-1.0, 20.0))]
    together = curves.curve_stats(df, "entity", "step", "x", wanted, "kind", ("mean", "area", "gradient"), ("identity", "log_abs"))
    made = {(r.entity, r.task, r.slot): r for r in together.collect()}
    n = 0
    for k, c in enumerate(wanted):
        alone = curves.curve_stats(df, "entity", "step", "x", [c], "kind", ("mean", "area", "gradient"), ("identity", "log_abs")).collect()
        for a in alone:
            n += 1
            b = made[(a.entity, k, -1 - k if c.pair else a.slot)]
            for name in set(a.__fields__) - {"entity", "task", "slot"}:
                assert a[name] == b[name] or abs(a[name] - b[name]) < 1e-9, (name, a, b)
    assert n == len(made)
    assert made[(7, 0, 1)].shape_mean is None and (8, 0, 1) not in made and (9, 0, 2) not in made


def test_unknown_signals_fail_without_an_analysis(spark):
    i = recipes._inputs(spark, SF)
    i.series = i.series.withColumn("odd", F.array(F.lit(1)))
    p = G.Program("p", [G.Spec("window_stats", "nothing", {"windows": [[0, 3]]}), G.Spec("window_stats", "odd", {"windows": [[0, 3]]}), G.Spec("curve_shape", "nothing", {"steps": [1]}), G.Spec("value_at_step", "temperature", {"steps": [1]})])
    frames, status = G.parts(p, i)
    assert [s.status for s in status] == ["failed", "failed", "failed", "ok"] and len(frames) == 1
