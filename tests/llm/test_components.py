"""Components of a graph that needs more rounds than usual ones."""

from cellweave.llm import minhash_dedup


def test_rounds_go_on_until_the_edges_settle(spark, monkeypatch):
    """Stands in for slow edges: the first 64 rounds give the path back, now and then with an edge more."""
    path = [(i + 1, i) for i in range(8)]
    held = [spark.createDataFrame(path + more, "a bigint, b bigint").cache() for more in ([], [(2, 0)])]
    real, calls = minhash_dedup.written, []

    def slow(df, what):
        calls.append(what)
        return held[len(calls) % 2] if len(calls) <= 64 else real(df, what)

    monkeypatch.setattr(minhash_dedup, "written", slow)
    got = minhash_dedup.components(held[0]).collect()
    assert len(calls) > 64
    assert {r.node: r.root for r in got} == {i: 0 for i in range(9)} and len(got) == 9


def test_hubs_are_dealt_in_parts(spark):
    """20,000 unlike texts behind one hub: no task of the join, and none of a star's rounds, has more than its parts."""
    import numpy as np
    from pyspark.sql import functions as F

    rng, n = np.random.default_rng(1), 20_000
    base = rng.integers(0, 256, minhash_dedup.MINIMA, np.uint8)
    rows = [(0, bytearray(base.tobytes()))] + [(i, bytearray((base if i % 10 == 0 else rng.integers(0, 256, minhash_dedup.MINIMA, np.uint8)).tobytes())) for i in range(1, n + 1)]
    sigs = spark.createDataFrame(rows, "key bigint, sig binary")
    pairs = spark.range(1, n + 1).select(F.col("id").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(n + 1).cast("bigint").alias("m"))
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = minhash_dedup.beside(pairs, sigs, "sig")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == n and max(sizes) < 6 * 250
        near = minhash_dedup.near_signatures(pairs, sigs)
        assert sorted(r.a for r in near.collect()) == list(range(10, n + 1, 10))
        assert {(r.node, r.root) for r in minhash_dedup.components(pairs.select("a", "b")).collect()} == {(i, 0) for i in range(n + 1)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_long_paths_and_stars(spark):
    edges = [(i + 1, i) for i in range(300)] + [(1000 + i, 999) for i in range(1, 700)] + [(2000, 1400), (7, 7)]
    got = {r.node: r.root for r in minhash_dedup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 999 for i in range(1, 700)}, 999: 999, 2000: 999} and len(got) == 301 + 701
