"""Exact quantiles against sorted lists: groups of all sizes, ties, nulls, narrow ranges, and what a task holds."""

import random

import pytest

from cellweave.operators import order_stats as O


def brute(values, share):
    v = sorted(x for x in values if x is not None and x == x and abs(x) != float("inf"))
    if not v:
        return None
    at = share * (len(v) - 1)
    k = int(at)
    return v[k] + (v[min(k + 1, len(v) - 1)] - v[k]) * (at - k)


@pytest.mark.parametrize("most", [3, 50, 2000])
def test_groups(spark, most):
    r = random.Random(1)
    rows = [("big", r.gauss(0, 1) * 10 ** r.randrange(-3, 6), r.random()) for _ in range(3000)]
    rows += [("ties", float(r.randrange(3)), 1.0) for _ in range(900)] + [("one", 4.0, None), ("none", None, float("nan")), (None, 2.0, float("inf")), (None, 5.0, 1.5)]
    rows += [("two", 1.0, 7.0), ("two", 2.0, 8.0)] + [("mixed", None if i % 3 else float(i), float(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(5)
    shares = [0.0, 0.25, 0.33, 0.5, 0.67, 1.0]
    got = {x.g: x for x in O.quantiles(df, ["g"], {"a": "a", "b": "b"}, shares, most).collect()}
    assert len(got) == 7
    for g, x in got.items():
        for c, i in (("a", 1), ("b", 2)):
            for j, s in enumerate(shares):
                want = brute([row[i] for row in rows if row[0] == g], s)
                assert x[f"{c}_{j}"] == want or abs(x[f"{c}_{j}"] - want) < 1e-12 * max(1, abs(want)), (g, c, s)


def test_without_keys_and_without_rows(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "a double")
    assert O.medians(df, [], {"a": "a", "twice": df.a * 2}).collect() == [(50.0, 100.0)]
    assert O.medians(df.where("a < 0"), [], {"a": "a"}).collect() == [(None,)]
    assert O.medians(df.where("a < 0").selectExpr("'x' AS g", "a"), ["g"], {"a": "a"}).count() == 0


def test_no_task_holds_more_than_a_range(spark, monkeypatch):
    """All-distinct values: what is ordered in one task is bounded, whatever the group's size."""
    seen, plain = [], O._found
    monkeypatch.setattr(O, "_found", lambda v, keys, most: (seen.append(v.groupBy(*keys, "k").count().agg({"count": "max"}).first()[0]), plain(v, keys, most))[1])
    df = spark.range(200_000).selectExpr("CAST(hash(id) AS DOUBLE) + id / 1e6 AS a")
    got = O.medians(df, [], {"a": "a"}, most=500).first().a
    v = sorted(x.a for x in df.collect())
    assert got == (v[99_999] + v[100_000]) / 2 and max(seen) <= 500


def test_medians_do_not_depend_on_the_order_of_rows(spark, monkeypatch):
    """Rows come in another order each time that they are read; a sketch of few places then has other cuts each time."""
    monkeypatch.setattr(O, "ACCURACY", 50)

    def dealt(frames):
        for f in frames:
            yield f.sample(frac=1, random_state=random.SystemRandom().randrange(2**32))

    monkeypatch.setattr(O, "CUTS", 8)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200000")
    try:
        rows = spark.range(0, 200_000, 1, 1).selectExpr("CAST(id * 7919 % 200003 AS DOUBLE) AS v").mapInPandas(dealt, "v double")
        assert O.medians(rows, [], {"m": "v"}, most=30_000).first().m == brute([float(i * 7919 % 200003) for i in range(200_000)], 0.5)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
