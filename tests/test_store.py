"""The store against last-write-wins over all rows: batches replayed, reordered, raced and streamed."""

import random

from pyspark.sql import functions as F

from cellweave.streaming.store import Manifest, Store

SCHEMA = "k int, at int, v string"


def batches(n=10, seed=2):
    r = random.Random(seed)
    return [[(r.randrange(15), r.randrange(40), r.choice("abc")) for _ in range(12)] for _ in range(n)]


def brute(all_rows):
    best = {}
    for k, at, v in all_rows:
        best[k] = max(best.get(k, (-1, "")), (at, v))
    return {(k, *b) for k, b in best.items()}


def put(spark, store, rows, batch, source="batches"):
    return store.put(spark.createDataFrame(rows, SCHEMA), batch, source)


def test_replayed_and_reordered_batches(spark, tmp_path):
    made = batches()
    want = brute(x for b in made for x in b)
    for name, order in (("a", range(10)), ("b", [3, 0, 9, 1, 2, 8, 7, 5, 6, 4])):
        store = Store(spark, str(tmp_path / name), ["k"], ["at"], compact_after=4)
        for i in order:
            assert put(spark, store, made[i], i)
            before = store.manifest()
            assert not put(spark, store, made[i], i) and store.manifest() == before
        assert {tuple(r) for r in store.read().collect()} == want
        assert store.manifest().applied == {"batches": [[0, 9]]} and len(store.manifest().tables) < 4
    assert Store(spark, str(tmp_path / "b"), ["k"], ["at"]).read().count() == len(want)  # opened again


def test_a_failed_batch_leaves_the_store_as_it_was(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), ["k"], ["at"])
    put(spark, store, [(1, 1, "a")], 0)
    before = store.manifest()
    try:
        store.put(spark.createDataFrame([(2, 2, "b")], SCHEMA).withColumn("v", F.raise_error(F.lit("broken")).cast("string")), 1)
    except Exception:
        pass
    assert store.manifest() == before and store.read().count() == 1 and put(spark, store, [(2, 2, "b")], 1)


def test_two_writers(spark, tmp_path):
    """A writer that decided on an older manifest does not take effect; sources count their own batches."""
    one, two = (Store(spark, str(tmp_path / "s"), ["k"], ["at"]) for _ in range(2))
    put(spark, one, [(1, 1, "a")], 0, "x")
    assert put(spark, two, [(1, 2, "b")], 0, "y")
    assert not one._switch(Manifest(2, [], {})) and one.read().collect() == [(1, 2, "b")]
    assert one.put(spark.createDataFrame([(3, 1, 7)], "k int, at int, extra int"), 1, "x")
    assert {(r.k, r.v, r.extra) for r in two.read().collect()} == {(1, "b", None), (3, None, 7)}


def test_stream(spark, tmp_path):
    made = batches(6, 5)
    store = Store(spark, str(tmp_path / "s"), ["k"], ["at"])
    for i, b in enumerate(made):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i in (2, 5):  # a stream that stops and goes on
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            query = store.follow(stream, str(tmp_path / "checkpoint"))
            query.processAllAvailable()
            query.stop()
    assert {tuple(r) for r in store.read().collect()} == brute(x for b in made for x in b)
    assert store.manifest().applied == {"stream": [[0, 5]]}
    assert Store(spark, str(tmp_path / "none"), ["k"], ["at"]).read() is None
