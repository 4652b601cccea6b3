"""Job actions as a stream: any micro-batches give what the batch operator gives; deadlines and escalation."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cellweave.operators import campaign as K
from cellweave.streaming import jobs as J

START = datetime(2024, 1, 1)


@pytest.fixture
def store(spark):
    before = {k: spark.conf.get(k, None) for k in J.SETTINGS}
    for k, v in J.SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def submitted(job, minute, resubmits=0, most=3, mem=64, time="4:00:00", seconds=None):
    return (job, START + timedelta(minutes=minute), "submitted", None, None, resubmits, most, mem, time, seconds)


def ended(job, minute, state, cls=None):
    return (job, START + timedelta(minutes=minute), "ended", state, cls, None, None, None, None, None)


def run(spark, tmp_path, batches, late="1 minute"):
    for i, b in enumerate(batches):
        spark.createDataFrame(b, J.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:03d}"))
    stream = spark.readStream.schema(J.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    made = J.job_actions_stream(stream, late)
    out = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    out.processAllAvailable()
    out.stop()
    return spark.read.schema(made.schema).parquet(str(tmp_path / "out"))


def test_any_batches_give_the_batch_result(spark, store, tmp_path):
    r = random.Random(3)
    rows = [(f"j{i}", r.choice(["COMPLETED", "FAILED", "OUT_OF_MEMORY", "TIMEOUT", "completed+"]), r.choice(["OOM", "TIMEOUT", "DEADLINE", "CODE", None, "TRANSIENT"]), r.randrange(3), 2, r.choice([16, 200]), r.choice(["4:00:00", "100:00:00", "bad"])) for i in range(60)]
    want = K.job_actions(spark.createDataFrame(rows, "job_id string, state string, class string, resubmits int, max_resubmits int, mem_gb int, time string").withColumn("class", F.coalesce("class", F.lit("none"))))
    want = {tuple(x) for x in want.select("job_id", "state", "action", "mem_gb", "time", "resubmits", "needs_human").collect()}
    events = [submitted(j, i, n, most, mem, t) for i, (j, _, _, n, most, mem, t) in enumerate(rows)] + [ended(j, 100 + i, s, c or "none") for i, (j, s, c, *_) in enumerate(rows)]
    for k, cuts in enumerate(([0, 120], [0, 30, 61, 64, 90, 120])):
        made = run(spark, tmp_path / str(k), [events[a:b] for a, b in zip(cuts, cuts[1:])])
        assert {tuple(x) for x in made.select("job_id", "state", "action", "mem_gb", "time", "resubmits", "needs_human").collect()} == want


def test_escalation_and_deadlines(spark, store, tmp_path):
    batches = [
        [submitted("a", 0, most=2, mem=100), submitted("b", 0, seconds=600), submitted("c", 0, seconds=600)],
        [ended("a", 1, "FAILED", "OOM"), ended("c", 5, "COMPLETED")],
        [ended("a", 2, "FAILED", "OOM"), ended("a", 3, "FAILED", "OOM"), ended("a", 4, "COMPLETED")],
        [submitted("x", 12)], [submitted("y", 13)], [submitted("z", 26)], [submitted("w", 27)],
    ]
    got = {}
    for x in run(spark, tmp_path, batches).collect():
        got.setdefault(x.job_id, []).append((x.action, x.mem_gb, x.time, x.resubmits))
    assert sorted(got["a"], key=lambda t: (t[3], t[0] != "resubmitted")) == [("resubmitted", 200, "4:00:00", 1), ("resubmitted", 256, "4:00:00", 2), ("halt-max-resubmits", 256, "4:00:00", 2)]
    assert got["c"] == [("completed", 64, "4:00:00", 0)]
    assert sorted(got["b"])[:2] == [("resubmitted", 64, "16:00:00", 2), ("resubmitted", 64, "8:00:00", 1)]  # two deadlines of ten minutes


def test_the_order_table_replayed(spark, store, tmp_path):
    """Every order is a job; the stream, cut into batches by chance, gives what the batch query gives."""
    from cellweave.catalogue import records

    sf = "/root/testdata/sf0.001"
    jobs = records._jobs(spark, sf)
    at = lambda offset: F.timestamp_seconds(F.lit(1_700_000_000 + offset) + F.pmod(F.xxhash64("job_id"), F.lit(500)))
    null = lambda kind: F.lit(None).cast(kind)
    one = jobs.select("job_id", at(0).alias("at"), F.lit("submitted").alias("kind"), null("string").alias("state"), null("string").alias("class"), "resubmits", "max_resubmits", "mem_gb", "time", null("long").alias("seconds"))
    two = jobs.where("o_orderstatus <> 'P'").select("job_id", at(1000).alias("at"), F.lit("ended").alias("kind"), F.col("was").alias("state"), "class", null("int").alias("resubmits"), null("int").alias("max_resubmits"), null("int").alias("mem_gb"), null("string").alias("time"), null("long").alias("seconds"))
    (one.unionByName(two).repartitionByRange(6, "at").write.parquet(str(tmp_path / "in")))
    stream = spark.readStream.schema(J.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = J.job_actions_stream(stream, "1 hour")
    out = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination()
    names = ["job_id", "state", "action", "mem_gb", "time", "resubmits", "needs_human"]
    got = sorted(map(tuple, spark.read.schema(made.schema).parquet(str(tmp_path / "out")).select(names).collect()))
    assert got == sorted(map(tuple, records.job_states_and_actions(spark, sf).select(names).collect())) and len(got) > 1000
